"""Phrase collocation mining by prefix-free parsing.

1. Texts are parsed into overlapping *chunks*: where the hash of ``OVERLAP`` consecutive words is 0 modulo
   ``every`` a chunk begins, and the one before it ends with these words. As the content decides, the
   copies of a passage are cut alike wherever they stand. Distinct chunks make the *dictionary*, with
   their frequencies in the parse.
2. Phrases are counted inside distinct chunks, weighted by frequency. A phrase counts in the chunk in
   which it begins before the overlap (or anywhere in a text's last chunk), and a phrase of
   ``OVERLAP + 1`` words that does lies inside that chunk, so each occurrence counts once.
3. Counting goes by length. A phrase occurs no more often than its parts, so one of ``n`` words is counted
   only where both its parts of ``n - 1`` words are frequent, by a bitmap of these (false positives are
   counted too, and dropped). All that scores need are counts of frequent phrases.
   Counts of a task go on as compressed blocks, one a range of hashes, and a task a range adds them up.
4. A phrase is keyed by 64-bit hashes of its two parts of ``n - 1`` words, so tables of one length join the
   next: words, and the counts of all first and last parts, come from there.

A phrase's score is the smallest ``floor(1000 a n / (l r))`` over its cuts, in decimals of 38 digits. A
candidate is dropped where a longer one that holds it has ``share`` percent of its count; of those that do,
one is a single word longer (counts fall with length), so tables of neighbouring lengths decide.

Cases: a null text is empty and a null lang is ``und``; a text without words has no chunk; texts are read
whole, in slices of a few megabytes and one text at least; repeated rows count as often as they are there;
ties go by count, then phrase in byte order; an empty table gives no rows; columns other than text and
lang, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import textwords
from tideline.llm.common import Scratch

#: Words that neighbouring chunks share, and the longest phrase; words of a chunk on average.
OVERLAP, LONGEST, EVERY = 4, 5, 32
#: Bytes of text and phrases handled at a time; bits of a bitmap at least and at most (32 MB).
SLICE, HELD, FEWEST_BITS, MOST_BITS = 2 << 20, 1_500_000, 1 << 16, 1 << 28
IS_BREAK = np.zeros(256, bool)
IS_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
IS_WORD = ~IS_BREAK
IS_WORD[[9, 32]] = False
_ONE, _TWO = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _two(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hashes of its first and last parts."""
    return textwords.mix(first * _ONE + second * _TWO)


def _tokens(column: pa.Array):
    """(bytes, starts, ends, hashes, row of each word, joined): joined where a word stands in one piece with the word before it."""
    data, _, starts, ends, hashes, first = textwords.words(column, IS_WORD)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    joined = np.zeros(len(starts), bool)
    if len(starts) > 1:
        breaks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(IS_BREAK[data], out=breaks[1:])
        joined[1:] = (breaks[starts[1:]] == breaks[ends[:-1]]) & (row[1:] == row[:-1])
    return data, starts, ends, hashes, row, joined


def _parse(every: int):
    """(lang, own, n, h1, h2, text) of the distinct chunks of some texts; own: words before the overlap."""
    from xxhash import xxh3_128_digest

    def run(batches):
        for batch in batches:
            for part in textwords.slices(batch, "text", SLICE):
                data, starts, ends, hashes, row, joined = _tokens(part.column("text"))
                if not len(starts):
                    continue
                begins = np.diff(row, prepend=-1) != 0
                if len(starts) >= OVERLAP:
                    window = textwords.window_hashes(hashes, OVERLAP)
                    inside = row[OVERLAP - 1 :] == row[: len(window)]
                    begins[: len(window)] |= inside & (window % np.uint64(every) == 0)
                a = np.flatnonzero(begins)
                b = np.append(a[1:], len(starts))  # its own words end
                last = np.append(row[a[1:]] != row[a[:-1]], True)
                stop = np.where(last, b, b + OVERLAP) - 1
                langs, raw = part.column("lang").to_pylist(), data.tobytes()
                found: dict[bytes, list] = {}
                for s, e, own, r in zip(starts[a].tolist(), ends[stop].tolist(), (b - a).tolist(), row[a].tolist()):
                    text, lang = raw[s:e], langs[r]
                    key = xxh3_128_digest(b"%d %b\0%b" % (own, lang.encode(), text))
                    if key in found:
                        found[key][2] += 1
                    else:
                        found[key] = [lang, own, 1, text]
                keys = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                lang, own, n, text = zip(*found.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang, pa.string()), pa.array(own, pa.int32()), pa.array(n, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(text, pa.binary()).cast(pa.string())],
                    names=["lang", "own", "n", "h1", "h2", "text"],
                )

    return run


def _chunk_words(part: pa.RecordBatch):
    """(bytes, starts, ends, hashes that tell languages apart, row, joined, whether a phrase that begins here counts) of dictionary chunks."""
    from xxhash import xxh3_64_intdigest

    data, starts, ends, hashes, row, joined = _tokens(part.column("text"))
    dictionary = part.column("lang").dictionary_encode()
    of_lang = np.array([xxh3_64_intdigest(x.encode()) for x in dictionary.dictionary.to_pylist()], np.uint64)
    hashes = _two(hashes, of_lang[dictionary.indices.to_numpy()][row])
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return data, starts, ends, hashes, row, joined, nth < part.column("own").to_numpy()[row]


class _Sums:
    """Weights summed by key: words by their hash, phrases by those of their two parts."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, *columns: np.ndarray):
        self.held.append(columns)
        self.size += len(columns[0])

    def compact(self):
        """Each key once: (g, keys, n) in order of g, the hash of the key."""
        *keys, n = (np.concatenate(c) for c in zip(*self.held))
        g = keys[0] if len(keys) == 1 else _two(*keys)
        order = np.argsort(g)
        new = lambda: np.append(True, np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0))
        first = new()
        if np.any(first[1:] & (g[order[1:]] == g[order[:-1]])):  # two keys share a hash
            order = np.lexsort((*keys[::-1], g))
            first = new()
        at = np.flatnonzero(first)
        n, keys = np.add.reduceat(n[order], at), [k[order[at]] for k in keys]
        self.held, self.size = [(*keys, n)], len(n)
        return g[order[at]], keys, n

    def blocks(self, parts: int, least: int = 1):
        """What is held, if it is much: a compressed block for each of ``parts`` ranges of hashes."""
        if self.size < least:
            return
        g, keys, n = self.compact()
        self.held, self.size = [], 0
        part = (g >> np.uint64(64 - parts.bit_length() + 1)).astype(np.int64) if parts > 1 else np.zeros(len(g), np.int64)
        cuts, pack = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(g)], zstandard.ZstdCompressor(level=1)
        packed = []
        for s, e in zip(cuts, cuts[1:]):
            order = s + np.argsort(keys[0][s:e])
            lead = keys[0][order]
            packed.append(pack.compress(b"".join([np.diff(lead, prepend=lead[:1] * 0).tobytes(), *(k[order].tobytes() for k in keys[1:]), n[order].tobytes()])))
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]], pa.int32()), pa.array(packed, pa.binary())], names=["part", "block"])


def _sum_blocks(n_keys: int, least: int):
    """(g, the keys where there are two, f) of the keys of a part that weigh ``least``."""

    def run(batches):
        sums, last, unpack = _Sums(), None, zstandard.ZstdDecompressor()

        def frequent():
            g, keys, n = sums.compact()
            keep = n >= least
            columns = [pa.array(k[keep].view(np.int64)) for k in ([g] if n_keys == 1 else [g, *keys])]
            return pa.RecordBatch.from_arrays([*columns, pa.array(n[keep])], names=[*"gps"[: len(columns)], "f"])

        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist()):
                if part != last and last is not None:
                    yield frequent()
                    sums = _Sums()
                last, data = part, np.frombuffer(unpack.decompress(block), np.uint64).reshape(n_keys + 1, -1)
                sums.add(np.cumsum(data[0]), *data[1:n_keys], data[n_keys].view(np.int64))
                if len(sums.held) > 1 and sums.size > 2 * len(sums.held[0][0]) + HELD:
                    sums.compact()
        if last is not None:
            yield frequent()

    return run


def _frequent(chunks: DataFrame, counter, n_keys: int, least: int, parts: int) -> DataFrame:
    """Keys that weigh ``least`` over all chunks. A task has a key once, so none makes a large group."""
    blocks = chunks.mapInArrow(counter, "part int, block binary").repartition(parts, "part").sortWithinPartitions("part")
    return blocks.mapInArrow(_sum_blocks(n_keys, least), "g long, f long" if n_keys == 1 else "g long, p long, s long, f long")


def _count_words(parts: int):
    def run(batches):
        sums = _Sums()
        for batch in batches:
            for part in textwords.slices(batch, "text", SLICE):
                *_, hashes, row, _, counts = _chunk_words(part)
                sums.add(hashes[counts], part.column("n").to_numpy()[row[counts]])
                yield from sums.blocks(parts, HELD)
        if sums.size:
            yield from sums.blocks(parts)

    return run


def _count_phrases(bitmaps: list, parts: int):
    """Counts of phrases a word longer than the last bitmap's, by their first and last part."""

    def run(batches):
        frequent = [np.frombuffer(b.value, np.uint8) for b in bitmaps]
        sums = _Sums()
        for batch in batches:
            for part in textwords.slices(batch, "text", SLICE):
                *_, hashes, row, joined, counts = _chunk_words(part)
                # at: places where a phrase of k words begins, g: its hash there
                at, g = np.arange(len(hashes)), hashes
                for k, bits in enumerate(frequent, 1):
                    bit = g & np.uint64(8 * len(bits) - 1)
                    known = (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    at, g = at[known], g[known]
                    follows = np.flatnonzero((at[1:] == at[:-1] + 1) & joined[at[1:]]) if k == 1 else np.flatnonzero(at[1:] == at[:-1] + 1)
                    p, s, at = g[follows], g[follows + 1], at[follows]
                    g = _two(p, s)
                own = counts[at]
                sums.add(p[own], s[own], part.column("n").to_numpy()[row[at[own]]])
                yield from sums.blocks(parts, HELD)
        if sums.size:
            yield from sums.blocks(parts)

    return run


def _spell(bitmap):
    """(g, lang, word) of the frequent words of a task."""

    def run(batches):
        bits, seen = np.frombuffer(bitmap.value, np.uint8), np.zeros(0, np.uint64)
        for batch in batches:
            for part in textwords.slices(batch, "text", SLICE):
                data, starts, ends, hashes, row, *_ = _chunk_words(part)
                g, at = np.unique(hashes, return_index=True)
                bit = g & np.uint64(8 * len(bits) - 1)
                new = ((bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0) & ~np.isin(g, seen)
                g, at = g[new], at[new]
                seen = np.union1d(seen, g) if len(seen) < HELD else g
                words, langs = [data[s:e].tobytes() for s, e in zip(starts[at], ends[at])], part.column("lang")
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), langs.take(pa.array(row[at])), pa.array(words, pa.binary()).cast(pa.string())], names=["g", "lang", "word"])

    return run


def bitmap_of(keys: DataFrame, count: int):
    """A broadcast bitmap of 64-bit keys ``g``, 16 bits a key within ``FEWEST_BITS`` and ``MOST_BITS``."""
    n_bits = max(FEWEST_BITS, min(MOST_BITS, 1 << (16 * count).bit_length()))
    bit = keys.select(F.pmod("g", F.lit(n_bits)).alias("b")).groupBy((F.col("b") / 32768).cast("long").alias("k"))
    out = bytearray(n_bits // 8)
    for r in bit.agg(F.bitmap_construct_agg(F.col("b") % 32768).alias("bits")).toLocalIterator():
        out[r["k"] * 4096 : (r["k"] + 1) * 4096] = r["bits"]
    return keys.sparkSession.sparkContext.broadcast(bytes(out))


def dictionary(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """(lang, own, n, text): the distinct chunks of ``docs(text, lang)`` and their frequencies."""
    given = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).where("text is not null")
    chunks = given.mapInArrow(_parse(every), "lang string, own int, n long, h1 long, h2 long, text string")
    return chunks.groupBy("h1", "h2").agg(F.first("lang").alias("lang"), F.first("own").alias("own"), F.sum("n").alias("n"), F.first("text").alias("text")).drop("h1", "h2")


def frequent_phrases(docs: DataFrame, least: int = 100, every: int = EVERY, scratch: Scratch | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each language (lang, n), and for 1 to ``LONGEST`` words the phrases that occur ``least`` times.

    Of each: g, p and s (null for words), lang, phrase, last (its last word), f (its count), and arrays
    ``firsts`` and ``lasts``: the counts of its first and of its last 1, 2, .. words.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    chunks = scratch.saved(dictionary(docs, every), "dictionary", "zstd")
    totals = chunks.groupBy("lang").agg(F.sum(F.col("n") * F.col("own")).alias("n"))
    parts = 1 << max(6, min(15, (2 * chunks.rdd.getNumPartitions() - 1).bit_length()))
    words = scratch.saved(_frequent(chunks, _count_words(parts), 1, least, parts), "words")
    bitmaps = [bitmap_of(words, words.count())]
    spelled = chunks.mapInArrow(_spell(bitmaps[0]), "g long, lang string, word string").groupBy("g").agg(F.first("lang").alias("lang"), F.first("word").alias("word"))
    one = F.array("f")
    nothing = F.lit(None).cast("long")
    words = words.join(spelled, "g").select("g", nothing.alias("p"), nothing.alias("s"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", one.alias("firsts"), one.alias("lasts"))
    tables = [scratch.saved(words, "phrases-1")]
    for size in range(2, LONGEST + 1):
        counted = scratch.saved(_frequent(chunks, _count_phrases(bitmaps, parts), 2, least, parts), f"counts-{size}")
        first = tables[-1].select(F.col("g").alias("p"), "lang", F.col("phrase").alias("before"), "firsts")
        second = tables[-1].select(F.col("g").alias("s"), "last", "lasts")
        grown = counted.join(first, "p").join(second, "s")
        grown = grown.select("g", "p", "s", "lang", F.concat_ws(" ", "before", "last").alias("phrase"), "last", "f", F.array_append("firsts", F.col("f")).alias("firsts"), F.array_append("lasts", F.col("f")).alias("lasts"))
        tables.append(scratch.saved(grown, f"phrases-{size}"))
        if size < LONGEST:
            bitmaps.append(bitmap_of(tables[-1].select("g"), tables[-1].count()))
    return totals, tables


def collocations(docs: DataFrame, least: int = 100, first: int = 2000, share: int = 100, every: int = EVERY) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases by score."""
    totals, tables = frequent_phrases(docs, least, every)
    out = None
    for size in range(2, LONGEST + 1):
        here = tables[size - 1]
        if size < LONGEST:
            longer = tables[size].select(F.explode(F.array("p", "s")).alias("g"), "f").groupBy("g").agg(F.max("f").alias("longer"))
            here = here.join(longer, "g", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f")))
        here = here.select("lang", "phrase", F.col("f").alias("a"), "firsts", "lasts", F.lit(size).alias("size"))
        out = here if out is None else out.union(here)
    big = lambda c: c.cast("decimal(19,0)")

    def cut(k):
        of_first, of_rest = F.element_at("firsts", k), F.element_at("lasts", F.col("size") - k)
        return F.struct(_floored(big(F.lit(1000)) * big(F.col("a")) * big(F.col("n")), big(of_first) * big(of_rest)).alias("score"), k.alias("k"), of_first.alias("l"), of_rest.alias("r"))

    out = out.join(totals, "lang").withColumn("best", F.array_min(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut)))
    out = out.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _floored(a, b):
    """a / b of two positive decimals without places, rounded down, as long."""
    return F.call_function("div", a, b)
