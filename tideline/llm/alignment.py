"""Cross-tokenizer alignment: token pairs that cover common bytes, and in how many documents each occurs.

A text is encoded twice: with a leading space by a byte-level BPE of the tokenizers library (A), and as it
is by a sentencepiece model that adds the space itself (B). Offsets where tokens of both end cut the
tokens into groups; an A and a B token whose byte ranges overlap are linked.

A pair's count is the number of documents that hold it linked, found by external spill counting:

1. A task gathers the (pair, document, occurrences) records of its documents, ``most`` at a time, sorts
   them by pair with A's id as the major side, and cuts them by A's id modulo ``parts`` (radix
   partitions) into *runs*: a zstd block of its pairs, each once with how many of the run's documents
   have it, and one of the documents themselves. Runs are rows of a table in the shared folder.
2. The pairs' blocks of one partition meet in a task, where a heap merges them by A's id. All pairs of an
   id are on top of the heap at once, so their counts and the id's largest are known when it has
   passed, and go back to each run as a block in the run's own order.
3. Each run's documents add up what their pairs' counts give.

A run has a pair once, however many documents hold it, so no pair makes a large group: what meets for an
id are runs, not documents. ``parts`` grows with the table.

Texts are encoded by units: a unit begins at a space or line end that follows a character which isn't
white space. A's pre-tokenizer always cuts there, and B has no piece that holds another character before a
space or line end, so both give the same tokens as for the whole text, and both end at a unit's end.
Letters and the marks after them are cut apart too where no piece of B joins them. Units are remembered.

Cases: texts that are null or empty, or whose tokens' bytes don't give back the text with its space (B
reads U+2581 as a space), have zeros and an empty digest; texts are read whole, some 256,000 characters
at a time; rows that repeat are documents of their own, and null ids are kept; of counts that tie for an
A id's highest all are best; an empty table gives no rows; columns other than doc_id and text, whatever
their names, are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from array import array
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Scratch
from tideline.llm.token_files import _Memory

#: Units that a worker process remembers, about 400 bytes each; characters of a text handled at a time.
REMEMBERED, PIECE = 250_000, 1 << 18
#: Records of a run.
MOST = 3_000_000
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_LETTERS_THEN_MARKS = re.compile(r"([ \n]?[^\W\d_]+)([^\w\s]+)")
_FIELD = 21  # bits of each of a unit's packed numbers: A tokens, B tokens, groups


class Aligner:
    """Tokens, groups and links of texts."""

    def __init__(self, a_path: str, b_path: str, remembered: int = REMEMBERED):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = dict(zip(printable, map(chr, printable))) | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.letters, as_byte = letters, {c: b for b, c in letters.items()}
        n_a, n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.a_bytes = [bytes(as_byte[c] for c in t) if all(c in as_byte for c in t) else t.encode() for t in map(self.a.id_to_token, range(n_a))]
        pieces = [self.b.id_to_piece(k) for k in range(n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_len, self.b_len = [len(x) for x in self.a_bytes], [len(x) for x in self.b_bytes]
        plain = [p for k, p in enumerate(pieces) if not self.b.is_byte(k) and not self.b.is_control(k) and not self.b.is_unknown(k)]
        self.joined = {p[i : i + 2] for p in plain for i in range(len(p) - 1)}
        if any("\n" in p or "▁" in p.lstrip("▁") for p in plain):
            raise ValueError("pieces that hold a space or line end within them can't be cut into units")
        self.shift = (n_b - 1).bit_length()
        if n_a.bit_length() + self.shift > 32:
            raise ValueError("the two vocabularies' pairs don't fit 32 bits")
        self.space, self.anchor = self.b.piece_to_id("▁"), self.b.encode("a")
        self.most, self.units, self.tails = remembered, _Memory(self._unit, {}), _Memory(self._tail, {})

    def _a_ids(self, text: str) -> list[int]:
        body = text[1:] if text[:1] == " " else text
        if body.isalpha():  # one token of the pre-tokenizer
            return [t.id for t in self.a.model.tokenize(text.encode().decode("latin1").translate(self.letters))]
        return self.a.encode(text, add_special_tokens=False).ids

    def _linked(self, text: str, a: list[int], b: list[int]):
        """(packed numbers, groups, pairs) of tokens of the same bytes; None where they aren't the text's."""
        whole = text.encode()
        if b"".join([self.a_bytes[i] for i in a]) != whole or b"".join([self.b_bytes[i] for i in b]) != whole:
            return None
        if len(whole) >> (_FIELD - 1):
            return self._linked_arrays(a, b)
        a_len, b_len, shift, b_rest = self.a_len, self.b_len, self.shift, iter(b)
        ahead, y, pairs, groups, first, second = 0, -1, [], [], [], []  # ahead: bytes by which B's token y ends after A's
        for x in a:
            ahead -= a_len[x]
            first.append(x)
            if y >= 0:
                pairs.append(x << shift | y)
            while ahead < 0:
                y = next(b_rest)
                ahead += b_len[y]
                second.append(y)
                pairs.append(x << shift | y)
            if not ahead:
                y = -1
                groups.append(f"{first[0]}|{second[0]}" if len(first) == len(second) == 1 else f"{','.join(map(str, first))}|{','.join(map(str, second))}")
                first, second = [], []
        return len(a) | len(b) << _FIELD | len(groups) << 2 * _FIELD, ";".join(groups).encode(), array("I", pairs).tobytes()

    def _linked_arrays(self, a: list[int], b: list[int]):
        """The same for a unit of megabytes: the ends of both, merged; its numbers are Python's own."""
        a, b = np.array(a), np.array(b)
        ends_a, ends_b = (np.cumsum([len(table[i]) for i in ids]) for table, ids in ((self.a_bytes, a), (self.b_bytes, b)))
        ends = np.union1d(ends_a, ends_b)  # between two ends both tokens stay the same
        pairs = a[np.searchsorted(ends_a, ends)] << self.shift | b[np.searchsorted(ends_b, ends)]
        cuts = np.intersect1d(ends_a, ends_b)
        at = zip(np.split(a, np.searchsorted(ends_a, cuts[:-1], side="right")), np.split(b, np.searchsorted(ends_b, cuts[:-1], side="right")))
        groups = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in at)
        return (len(a), len(b), len(cuts)), groups.encode(), pairs.astype("<u4").tobytes()

    def _unit(self, text: str):
        if len(text) < 1000 and (m := _LETTERS_THEN_MARKS.fullmatch(text)) and m[1][-1] + m[2][0] not in self.joined:
            first, second = self.units[m[1]], self.tails[m[2]]
            if first is None or second is None:
                return None
            return first[0] + second[0], first[1] + b";" + second[1], first[2] + second[2]
        if text == " ":  # a text's end
            b = [self.space]
        else:
            b = self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]
        return self._linked(text, self._a_ids(text), b)

    def _tail(self, marks: str):
        """Marks that follow a letter."""
        ids = self.b.encode("a" + marks)
        if ids[: len(self.anchor)] != self.anchor or "a" + marks[0] in self.joined:
            raise ValueError(f"{marks!r} can't be cut from a letter")
        return self._linked(marks, self.a.encode(marks, add_special_tokens=False).ids, ids[len(self.anchor) :])

    def align(self, text: str | None):
        """(A tokens, B tokens, groups, sha256 of the groups, pair codes of all links); zeros without tokens."""
        nothing = (0, 0, 0, "", np.zeros(0, np.uint32))
        if not text:
            return nothing
        n_a = n_b = n_groups = 0
        digest, pairs, text, at, field = hashlib.sha256(), [], f" {text}", 0, (1 << _FIELD) - 1
        while at < len(text):
            found = _CUT.search(text, at + PIECE) if at + PIECE < len(text) else None
            end = found.start() if found else len(text)
            if len(self.units) > self.most:
                self.units = _Memory(self._unit, dict(self.units))
            units = [self.units[u] for u in _CUT.split(text[at:end])]
            if None in units:
                return nothing
            if len(text) > PIECE // 2 and any(type(u[0]) is tuple for u in units):  # units of megabytes
                long = [u[0] for u in units if type(u[0]) is tuple]
                n_a, n_b, n_groups = (n + sum(k) for n, k in zip((n_a, n_b, n_groups), zip(*long)))
                total = sum(u[0] for u in units if type(u[0]) is int)
            else:
                total = sum(map(itemgetter(0), units))  # of a few hundred thousand characters at most, and a shorter unit
            n_a, n_b, n_groups = n_a + (total & field), n_b + (total >> _FIELD & field), n_groups + (total >> 2 * _FIELD)
            digest.update((b";" if at else b"") + b";".join(map(itemgetter(1), units)))
            pairs.append(b"".join(map(itemgetter(2), units)))
            at = end
        return n_a, n_b, n_groups, digest.hexdigest(), np.frombuffer(b"".join(pairs), "<u4")


@functools.lru_cache(1)
def _aligner(a_path: str, b_path: str, remembered: int) -> Aligner:
    """One a worker process, so that later tasks find its units."""
    return Aligner(a_path, b_path, remembered)


def _packed(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join([c.tobytes() for c in columns]))


def _unpacked(block: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    n, at, out = len(data) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += out[-1].nbytes
    return out


RUN = "run string, part int, doc int, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, docs binary"


def _runs(a_path: str, b_path: str, parts: int, most: int, remembered: int, schema: pa.Schema):
    """Rows of documents (part null), and of runs (doc null)."""

    def run(batches):
        aligner, task, n_runs = _aligner(a_path, b_path, remembered), TaskContext.get().partitionId(), 0
        rows, codes, times, docs, held, n_docs = [], [], [], [], 0, 0

        def made():
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        def spilled():
            code, doc, n = np.concatenate(codes), np.concatenate(docs), np.concatenate(times)
            order = np.lexsort((code, code >> aligner.shift & parts - 1))  # by partition, then pair
            code, doc, n = code[order], doc[order], n[order]
            part = code >> aligner.shift & parts - 1
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(code)]
            for s, e in zip(cuts, cuts[1:]):
                first = np.flatnonzero(np.diff(code[s:e], prepend=code[s] ^ 1))
                pair, size = code[s:e][first], np.diff(first, append=e - s).astype("<u4")
                yield {"run": f"{task}.{n_runs}", "part": int(part[s]), "pairs": _packed(np.diff(pair, prepend=np.uint32(0)), size), "docs": _packed(doc[s:e], n[s:e])}

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, batch.column("text")):
                n_a, n_b, n_groups, sha, pairs = aligner.align(text.as_py())
                rows.append({"run": f"{task}.{n_runs}", "doc": n_docs, "doc_id": doc_id, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": len(pairs), "groups_sha256": sha})
                code, n = np.unique(pairs, return_counts=True)
                codes.append(code)
                times.append(n.astype("<u4"))
                docs.append(np.full(len(code), n_docs, "<u4"))
                held, n_docs = held + len(code), n_docs + 1
                if len(rows) >= 4096:
                    yield made()
                    rows = []
                if held >= most:
                    for r in spilled():
                        rows.append(r)
                        if len(rows) >= 256:
                            yield made()
                            rows = []
                    codes, times, docs, held, n_docs, n_runs = [], [], [], 0, 0, n_runs + 1
        if held:
            rows.extend(spilled())
        yield made()

    return run


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]], shift: int) -> list[np.ndarray]:
    """For each run of (ascending pairs, their documents): each pair's count over all runs times 2, plus 1 where it is its A id's highest."""
    starts = [np.flatnonzero(np.diff(pair >> shift, prepend=(pair[:1] >> shift) ^ 1)).tolist() + [len(pair)] for pair, _ in runs]
    replies = [np.zeros(len(pair), np.int64) for pair, _ in runs]
    heap = [(int(pair[0]) >> shift, k, 0) for k, (pair, _) in enumerate(runs) if len(pair)]
    heapq.heapify(heap)
    while heap:
        a, spans = heap[0][0], []
        while heap and heap[0][0] == a:
            _, k, i = heap[0]
            s, e = starts[k][i], starts[k][i + 1]
            spans.append((k, s, e))
            if e < len(runs[k][0]):
                heapq.heapreplace(heap, (int(runs[k][0][e]) >> shift, k, i + 1))
            else:
                heapq.heappop(heap)
        pair = np.concatenate([runs[k][0][s:e] for k, s, e in spans])
        _, which = np.unique(pair, return_inverse=True)
        count = np.zeros(int(which.max()) + 1, np.int64)
        np.add.at(count, which, np.concatenate([runs[k][1][s:e] for k, s, e in spans]).astype(np.int64))
        reply, at = (count * 2 + (count == count.max()))[which], 0
        for k, s, e in spans:
            replies[k][s:e] = reply[at : at + e - s]
            at += e - s
    return replies


def _by_group(batches, key: str):
    """Lists of rows with the same value of ``key``, which come one after another."""
    held, last = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != last and held:
                yield last, held
                held = []
            last = row[key]
            held.append(row)
    if held:
        yield last, held


def _merge(shift: int):
    def run(batches):
        for part, rows in _by_group(batches, "part"):
            runs = []
            for r in rows:
                step, size = _unpacked(r["pairs"], "<u4", "<u4")
                runs.append((np.cumsum(step, dtype=np.uint32), size))
                r["pairs"] = None
            replies = merge_runs(runs, shift)
            for at in range(0, len(rows), 64):
                some = range(at, min(at + 64, len(rows)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows[k]["run"] for k in some]), pa.array([part] * len(some), pa.int32()), pa.array([_packed(replies[k]) for k in some], pa.binary())], names=["run", "part", "counts"]
                )

    return run


def _contribute(batches):
    """(run, doc, n_best, count_sum) of each document of a run with links."""

    def made(run, best, total, seen):
        docs = np.flatnonzero(seen)
        return pa.RecordBatch.from_arrays([pa.array([run] * len(docs), pa.string()), pa.array(docs, pa.int32()), pa.array(best[docs]), pa.array(total[docs])], names=["run", "doc", "n_best", "count_sum"])

    last, best, total, seen = None, None, None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["run"] != last:
                if last is not None:
                    yield made(last, best, total, seen)
                last, best, total, seen = row["run"], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
            _, size = _unpacked(row["pairs"], "<u4", "<u4")
            doc, n = _unpacked(row["docs"], "<u4", "<u4")
            (counts,) = _unpacked(row["counts"], "<i8")
            counts, more = np.repeat(counts, size), max(0, int(doc.max()) + 1 - len(best))
            best, total, seen = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (best, total, seen))
            np.add.at(best, doc, n * (counts & 1))
            np.add.at(total, doc, n * (counts >> 1))
            seen[doc] = True
    if last is not None:
        yield made(last, best, total, seen)


def align(docs: DataFrame, a_path: str, b_path: str, parts: int | None = None, most: int = MOST, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs(doc_id, text)``.

    parts: radix partitions, a power of two; without it 64 or more, by the partitions of docs.
    """
    scratch = Scratch(docs.sparkSession)
    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if parts is None:
        parts = 1 << max(6, min(15, (2 * given.rdd.getNumPartitions() - 1).bit_length()))
    if parts & parts - 1:
        raise ValueError("parts must be a power of two")
    schema = RUN.format(id=dict(given.dtypes)["doc_id"])
    fields = _arrow_schema(docs.sparkSession, schema)
    saved = scratch.saved(given.mapInArrow(_runs(a_path, b_path, parts, most, remembered, fields), schema), "runs", "none")
    runs = saved.where("part is not null")
    counts = runs.select("run", "part", "pairs").repartition(parts, "part").sortWithinPartitions("part", "run")
    counts = scratch.saved(counts.mapInArrow(_merge(_shift(b_path)), "run string, part int, counts binary"), "counts", "none")
    whole = runs.select("run", "part", "pairs", "docs").join(counts, ["run", "part"])
    given_back = whole.repartition("run").sortWithinPartitions("run", "part").mapInArrow(_contribute, "run string, doc int, n_best long, count_sum long")
    out = saved.where("part is null").select("run", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(given_back, ["run", "doc"], "left")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")


def _shift(b_path: str) -> int:
    import sentencepiece

    return (sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size() - 1).bit_length()


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))
