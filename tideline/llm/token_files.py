"""Token ids as flat unsigned integer files with 64-bit document offsets.

A written folder holds, for shard n = 0, 1, ..:

* ``n.ids``      the ids of its documents, back to back, little-endian, each document ending with
                 ``end_id``; 16 bits an id where the vocabulary allows, else 32
* ``n.offsets``  int64: where each document begins in ``n.ids``, in ids, and last their number
* ``n.docs``     int64: the doc_id of each document

and ``manifest.json`` with the id width and each shard's counts, how many of its first documents have no
doc_id, and its *base*: the ids in all shards before it, a prefix sum over the shard counts. Documents ascend by doc_id through all shards, nulls
first; rows that share a doc_id are ordered by a hash of their text. All files can be memory-mapped.

A task writes under a name of its own attempt and renames when complete, so a retried or duplicated
task leaves the same finished files. Only shard counts reach the driver.

Cases: a null or empty text is one document of just the end id; an empty table writes no shard; texts
of any length are encoded whole, one at a time; rows that repeat are documents of their own; columns
other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import shared_dir

_LETTERS_THEN_MARKS = re.compile(r"(\n?)([^\W\d_]+)([^\w\s]*)")


class _Irregular(Exception):
    pass


class _Memory(dict):
    """Values by key, made on demand; takes over from an older memory what is asked for again."""

    def __init__(self, make, old: dict):
        self.make, self.old = make, old

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them, with pieces remembered.

    With a byte-level pre-tokenizer a space before a non-space always begins a new token, so a text
    is encoded as its pieces between single spaces, each kept with its space (or line end). Texts
    with other white space, or with a special token's string, go to the library whole.
    """

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        described = json.loads(self.whole.to_str())
        before = described.get("pre_tokenizer") or {}
        self.by_piece = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not described.get("normalizer")
        self.specials = [t["content"] for t in described.get("added_tokens", [])]
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.model, self.most = self.whole.model, most
        self.packed = [np.array([k], self.dtype).tobytes() for k in range(self.whole.get_vocab_size())]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.pieces, self.marks = _Memory(self._piece, {}), {}

    def _library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _merges(self, text: str) -> bytes:
        """Ids of what is one token for the pre-tokenizer."""
        found = self.model.tokenize(text.encode().decode("latin1").translate(self.letters))
        return b"".join([self.packed[t.id] for t in found])

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha():
            return self._merges(f" {piece}")
        if (m := _LETTERS_THEN_MARKS.fullmatch(piece)) and m[2].isalpha():
            # a space or line end, letters, then marks that are neither letters nor digits
            if m[3] not in self.marks:
                self.marks[m[3]] = self._merges(m[3]) if m[3] else b""
            word = self._merges("\n") + self._merges(m[2]) if m[1] else self.pieces[m[2]]
            return word + self.marks[m[3]]
        body = piece[1:] if piece[:1] == "\n" else piece
        if body.split() != [body] or any(s in body for s in self.specials):
            raise _Irregular
        return self._library(piece if body is not piece else f" {piece}")

    def encode(self, text: str) -> bytes:
        if self.by_piece:
            if len(self.pieces) > self.most:
                self.pieces, self.marks = _Memory(self._piece, dict(self.pieces)), {}
            first, *rest = text.replace("\n", " \n").split(" ")
            try:
                if first.isalpha():
                    return self._merges(first) + b"".join(map(self.pieces.__getitem__, rest))
                if not first or first[:1] == "\n" or first.split() != [first] or any(s in first for s in self.specials):
                    raise _Irregular
                return self._library(first) + b"".join(map(self.pieces.__getitem__, rest))
            except _Irregular:
                pass
        return self._library(text)


@functools.lru_cache(1)
def _encoder(path: str, remembered: int) -> Encoder:
    """One encoder a worker process, so that later tasks find its pieces."""
    return Encoder(path, remembered)


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if urlparse(path).scheme else f"file://{path}")


def _write_shard(path: str, tokenizer: str, end_id: int, remembered: int):
    def run(batches):
        task = TaskContext.get()
        shard, own = task.partitionId(), f"{task.partitionId()}.{task.taskAttemptId()}"
        fs, root = _fs(path)
        encoder = _encoder(tokenizer, remembered)
        end = np.array([end_id], encoder.dtype).tobytes()
        offsets, docs = [np.zeros(1, np.int64)], []
        total, out, nulls = 0, None, 0
        for batch in batches:
            ids = []
            for text in batch.column("text"):
                ids.append(encoder.encode(text.as_py() or ""))
                ids.append(end)
                if len(ids) >= 4096:
                    out = out or fs.open_output_stream(f"{root}/_{own}.ids")
                    sizes = np.array([len(x) for x in ids], np.int64).reshape(-1, 2).sum(axis=1) // encoder.dtype.itemsize
                    offsets.append(total + np.cumsum(sizes))
                    total = int(offsets[-1][-1])
                    out.write(b"".join(ids))
                    ids = []
            if ids:
                out = out or fs.open_output_stream(f"{root}/_{own}.ids")
                sizes = np.array([len(x) for x in ids], np.int64).reshape(-1, 2).sum(axis=1) // encoder.dtype.itemsize
                offsets.append(total + np.cumsum(sizes))
                total = int(offsets[-1][-1])
                out.write(b"".join(ids))
            nulls += batch.column("doc_id").null_count
            docs.append(batch.column("doc_id").fill_null(0).to_numpy())
        n = sum(map(len, docs))
        if n:
            out.close()
            for name, parts in (("offsets", offsets), ("docs", docs)):
                with fs.open_output_stream(f"{root}/_{own}.{name}") as f:
                    f.write(np.concatenate(parts).astype("<i8").tobytes())
            for name in ("ids", "offsets", "docs"):
                try:
                    fs.move(f"{root}/_{own}.{name}", f"{root}/{shard}.{name}")
                except OSError:  # another attempt finished first, on a store that won't replace
                    if fs.get_file_info(f"{root}/{shard}.{name}").type == pafs.FileType.NotFound:
                        raise
                    fs.delete_file(f"{root}/_{own}.{name}")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "n_docs": pa.array([n], pa.int64()), "n_null": pa.array([nulls], pa.int64()), "n_tokens": pa.array([total], pa.int64()), "width": pa.array([encoder.dtype.itemsize], pa.int64())})

    return run


#: Pieces that a worker process remembers, 200 to 300 bytes each.
REMEMBERED = 250_000


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, remembered: int = REMEMBERED) -> list[dict]:
    """Encode ``docs(doc_id, text)`` into token files at ``path`` (a URI all executors can write to)."""
    fs, root = _fs(path)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = rows.mapInArrow(_write_shard(path, tokenizer, end_id, remembered), "shard long, n_docs long, n_null long, n_tokens long, width long").collect()
    base, shards = 0, []
    for r in sorted(found, key=lambda r: r["shard"]):
        shards.append({"shard": r["shard"], "base": base, "n_docs": r["n_docs"], "n_null": r["n_null"], "n_tokens": r["n_tokens"]})
        base += r["n_tokens"]
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"width": found[0]["width"] if found else 2, "end_id": end_id, "shards": shards}).encode())
    return shards


class TokenFiles:
    """The files at ``path``; mapped into memory where the store is local, read by range elsewhere."""

    def __init__(self, path: str):
        self.fs, self.root = _fs(path)
        with self.fs.open_input_stream(f"{self.root}/manifest.json") as f:
            manifest = json.loads(f.read())
        self.shards, self.dtype = manifest["shards"], np.dtype(f"<u{manifest['width']}")

    def _whole(self, shard: int, name: str) -> np.ndarray:
        with self.fs.open_input_stream(f"{self.root}/{shard}.{name}") as f:
            return np.frombuffer(f.read(), "<i8")

    def documents(self, k: int, most: int = 4 << 20):
        """(doc ids, starts over all shards, ends in ids, ids) of the k-th shard, some documents at a time."""
        info = self.shards[k]
        offsets, docs = self._whole(info["shard"], "offsets"), self._whole(info["shard"], "docs")
        name = f"{self.root}/{info['shard']}.ids"
        local = isinstance(self.fs, pafs.LocalFileSystem)
        ids = np.memmap(name, self.dtype, "r") if local else self.fs.open_input_file(name)
        at = 0
        while at < len(docs):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            a, b = int(offsets[at]), int(offsets[end])
            part = ids[a:b] if local else np.frombuffer(ids.read_at((b - a) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype)
            yield pa.array(docs[at:end], pa.int64(), mask=np.arange(at, end) < info["n_null"]), info["base"] + offsets[at:end], offsets[at + 1 : end + 1] - a, part
            at = end


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 of each document, one task a shard."""

    def run(batches):
        files = TokenFiles(path)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                for docs, starts, ends, ids in files.documents(k):
                    cuts = np.concatenate([[0], ends])
                    wide = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [docs, pa.array(starts, pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = len(TokenFiles(path).shards)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = 0, remembered: int = REMEMBERED) -> DataFrame:
    """Write the token files of docs to a new shared folder and return their digests."""
    path = shared_dir(docs.sparkSession)
    write(docs, path, tokenizer, end_id, remembered)
    return digests(docs.sparkSession, path)
