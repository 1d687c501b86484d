"""N-gram Jaccard join: MinHash bands propose pairs, a Bayesian test prunes them, sets verify them.

1. Texts become sets of 5-word shingles. Rows with the same word sequence form a *class*; from here
   on a class is one row, so copies never multiply.
2. 96 MinHash values a class, in 24 bands of 4; classes that share a band are candidates (a pair of
   Jaccard 0.8 shares none with probability 3e-6).
3. Within a band's bucket the MinHash values of two classes are compared eight at a time; a pair is
   dropped as soon as the posterior probability (uniform prior) that its Jaccard similarity reaches
   the threshold falls below ``tolerance``. Only what connects the survivors is kept (a star for each
   group of them), and its connected components say which classes must meet.
4. Each component's classes are brought together once, with their texts, and every pair in it that
   passes the same test is verified on the exact shingle sets. Tasks return sums of links and a star
   for each group of linked classes, never the pairs.

Buckets and components above ``block`` members (or ``block_chars`` of text) are split at random
into blocks and each pair of blocks is a task of its own, so that none holds more than two blocks.

Cases: a text of one to four words has one shingle, all its words; a text without words (or null)
links with nothing and is a group of its own; rows that repeat doc_id or have none are still rows
of their own; class_id is null only where no member of the group has a doc_id; texts of any length are
read whole, in slices of about 1 MB and one text at least, and long ones make blocks of fewer members;
a pair at exactly the threshold is linked; an empty table gives no rows; columns other than doc_id and
text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import textwords
from tideline.llm.common import Scratch
from tideline.llm.graph import components

SHINGLE, BANDS, ROWS, STEP = 5, 24, 4, 8
HASHES = BANDS * ROWS
_rng = np.random.default_rng(20240501)
_FACTORS = (_rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_SHIFTS = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of values compared: the fewest matches that keep a pair.

    After m matches in n the posterior of the similarity is Beta(m + 1, n - m + 1); its mass at or
    above t is the chance of at most m successes in n + 1 trials of probability t.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of one text's word hashes."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(textwords.window_hashes(hashes, min(SHINGLE, len(hashes))) ^ np.uint64(min(SHINGLE, len(hashes)) % SHINGLE))


def signature(sets: np.ndarray) -> bytes:
    """The low 16 bits of each MinHash value."""
    low = np.full(HASHES, np.uint32(0xFFFFFFFF))
    base = (sets >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(base), 4096):
        x = base[None, at : at + 4096] * _FACTORS + _SHIFTS
        x ^= x >> np.uint32(15)
        np.minimum(low, (x * np.uint32(0x2C1B3C6D)).min(axis=1), out=low)
    return low.astype(np.uint16).tobytes()


def _sign(batches):
    for batch in batches:
        for part in textwords.slices(batch, "text"):
            _, _, _, _, hashes, first = textwords.words(part.column("text"))
            keys, sizes, sigs = [], [], []
            for i in range(part.num_rows):
                mine = hashes[first[i] : first[i + 1]]
                own = shingles(mine)
                keys.append(hashlib.md5(mine.tobytes()).digest() if len(mine) else None)
                sizes.append(len(own))
                sigs.append(signature(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())],
                names=["doc_id", "key", "n_shingles", "sig"],
            )


def _texts_of(bits, n_bits):
    def run(batches):
        wanted = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for part in textwords.slices(batch, "text"):
                _, _, _, _, hashes, first = textwords.words(part.column("text"))
                keys = [hashlib.md5(hashes[first[i] : first[i + 1]].tobytes()).digest() for i in range(part.num_rows)]
                at = key_bit(np.frombuffer(b"".join(keys), ">u4")[0::4], n_bits)
                keep = np.flatnonzero((wanted[at >> 3] >> (at & 7)) & 1 & (np.diff(first) > 0))
                if len(keep):
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in keep], pa.binary()), part.column("text").take(pa.array(keep))], names=["key", "text"])

    return run


def key_bit(lead: np.ndarray, n_bits: int) -> np.ndarray:
    return lead.astype(np.int64) % n_bits


def key_filter(keys: DataFrame, n_bits: int) -> bytes:
    """A bitmap of hashed keys; n_bits (16 MB at most here) bounds what reaches the driver."""
    bit = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") % n_bits
    rows = keys.select(bit.alias("b")).groupBy((F.col("b") / 32768).cast("long").alias("k"))
    out = bytearray(n_bits // 8)
    for r in rows.agg(F.bitmap_construct_agg(F.col("b") % 32768).alias("bits")).toLocalIterator():
        out[r["k"] * 4096 : (r["k"] + 1) * 4096] = r["bits"]
    return bytes(out)


def whole_groups(batches, by: str, most: int):
    """Sorted batches as tables that hold all rows of each value of ``by`` they touch.

    A table ends at the first change of value after ``most`` bytes.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            k = batch.column(by).to_numpy(zero_copy_only=False)
            full = sum(b.nbytes for b in held) >= most
            if full:
                last = held[-1].column(by)[held[-1].num_rows - 1].as_py()
                new = np.flatnonzero(k != last)
                if not len(new):
                    held.append(batch)
                    break
                cut = int(new[0])
                if cut:
                    held.append(batch.slice(0, cut))
                yield pa.Table.from_batches(held).combine_chunks()
                held, batch = [], batch.slice(cut)
                continue
            rows = max(1, min(batch.num_rows, most * batch.num_rows // max(1, batch.nbytes)))
            held.append(batch.slice(0, rows))
            batch = batch.slice(rows)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def stars(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the graph with edges (a[i], b[i]) over n nodes, and the smallest it is connected to, if another."""
    lowest = np.arange(n)
    while True:
        before = lowest.copy()
        np.minimum.at(lowest, a, lowest[b])
        np.minimum.at(lowest, b, lowest[a])
        np.minimum.at(lowest, before, lowest.copy())  # a node's former lowest joins what the node has found
        lowest = lowest[lowest]
        if np.array_equal(lowest, before):
            u = np.flatnonzero(lowest != np.arange(n))
            return u, lowest[u]


def survivors(t: pa.Table, sig: np.ndarray, sizes: np.ndarray, least: dict[int, int], threshold: float):
    """Pairs of rows of one task that the incremental test keeps, for all tasks of a sorted table."""
    task, side = t.column("task").to_numpy(), t.column("side").to_numpy()
    crossing = t.column("crossing").to_numpy()
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    active, d = np.arange(len(task)), 0
    while True:
        d += 1
        active = active[active + d < len(task)]
        active = active[task[active + d] == task[active]]
        if not len(active):
            return np.concatenate(left), np.concatenate(right)
        i, j = active, active + d
        low, high = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        fit = (low >= threshold * high - 1e-9) & (~crossing[i] | (side[i] != side[j]))
        i, j = i[fit], j[fit]
        same = np.zeros(len(i), np.int32)
        for at in range(0, HASHES, STEP):
            if not len(i):
                break
            same += (sig[i, at : at + STEP] == sig[j, at : at + STEP]).sum(axis=1, dtype=np.int32)
            keep = same >= least[at + STEP]
            i, j, same = i[keep], j[keep], same[keep]
        if len(i):
            left.append(i)
            right.append(j)


def _prune(threshold: float, tolerance: float):
    def run(batches):
        least = least_matches(threshold, tolerance)
        for t in whole_groups(batches, "task", 1 << 20):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(t.num_rows, HASHES)
            a, b = survivors(t, sig, t.column("n_shingles").to_numpy(), least, threshold)
            keys = t.column("key")
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(side)).combine_chunks() for side in stars(a, b, t.num_rows)], names=["u", "v"])

    return run


def _verify(threshold: float, tolerance: float):
    def run(batches):
        least = least_matches(threshold, tolerance)
        for t in whole_groups(batches, "task", 1 << 20):
            _, _, _, _, hashes, first = textwords.words(t.column("text").combine_chunks())
            sets = [shingles(hashes[first[i] : first[i + 1]]) for i in range(t.num_rows)]
            sig = np.frombuffer(b"".join(map(signature, sets)), np.uint16).reshape(len(sets), HASHES)
            sizes = np.array([len(s) for s in sets])
            ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
            mark, ends = np.zeros(int(ids.max()) + 1, bool), np.cumsum(sizes)
            a, b = survivors(t, sig, sizes, least, threshold)
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            good = np.zeros(len(a), bool)
            for rows in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1) if len(a) else ():
                i = a[rows[0]]
                own = ids[ends[i] - sizes[i] : ends[i]]
                mark[own] = True
                for some in np.array_split(rows, 1 + int(sizes[b[rows]].sum() >> 19)):
                    n = sizes[b[some]]
                    others = np.concatenate([ids[ends[j] - sizes[j] : ends[j]] for j in b[some]]) if len(some) else own[:0]
                    both = np.add.reduceat(mark[others].astype(np.int64), np.cumsum(n) - n) if len(some) else n
                    good[some] = both >= threshold * (n + sizes[i] - both) - 1e-9
                mark[own] = False
            a, b = a[good], b[good]
            weight, links = t.column("n_docs").to_numpy(), np.zeros(len(sets), np.int64)
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            some, (u, v) = np.flatnonzero(links), stars(a, b, len(sets))
            keys = t.column("key").combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(np.concatenate([some, u]))),
                    pa.concat_arrays([pa.nulls(len(some), keys.type), keys.take(pa.array(v))]),
                    pa.array(np.concatenate([links[some], np.zeros(len(u), np.int64)])),
                ],
                names=["u", "v", "n"],
            )

    return run


def block_pairs(df: DataFrame, group: str, n_blocks: str, key: str) -> DataFrame:
    """Each row once for every pair of its group's blocks that its block is in.

    Adds task (hash of group and pair), side (0 or 1: which block of the pair) and crossing (the
    blocks differ, and only pairs of rows from both are to be compared there).
    """
    mine = F.pmod(F.xxhash64(key, F.lit("block")), n_blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_blocks) - 1))
    out = df.withColumn("_mine", mine.cast("long")).withColumn("_other", other)
    low, high = F.least("_mine", "_other"), F.greatest("_mine", "_other")
    return (
        out.withColumn("task", F.xxhash64(group, low, high))
        .withColumn("side", (F.col("_mine") > F.col("_other")).cast("int"))
        .withColumn("crossing", F.col("_mine") != F.col("_other"))
        .drop("_mine", "_other")
    )


def near_join(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 512, block_chars: int = 8 << 20) -> DataFrame:
    """(doc_id, class_id, n_links, exact_id), one row per row of ``docs(doc_id, text)``.

    class_id: the smallest doc_id of the group that links join. n_links: other rows whose shingle
    sets have a Jaccard similarity of at least ``threshold`` with this row's. exact_id: the smallest
    doc_id with the same words.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    doc_type = dict(docs.dtypes)["doc_id"]
    signed = scratch.saved(docs.mapInArrow(_sign, f"doc_id {doc_type}, key binary, n_shingles int, sig binary"), "signatures")
    classes = signed.where("key is not null").groupBy("key").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("min_id"), F.max("n_shingles").alias("n_shingles"), F.max("sig").alias("sig")
    )
    classes = scratch.saved(classes, "classes")

    # buckets: (band, four values) as one 64-bit hash; false equals only add candidates
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (2 * ROWS) + 1, F.lit(2 * ROWS)))))
    banded = classes.select("key", band.alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = banded.join(shared, "bucket").join(classes.select("key", "n_shingles", "sig"), "key")
    members = members.withColumn("n_blocks", F.ceil(F.col("n") / block))
    tasks = block_pairs(members, "bucket", "n_blocks", "key").select("task", "side", "crossing", "key", "n_shingles", "sig")
    edges = tasks.repartition("task").sortWithinPartitions("task", "key").mapInArrow(_prune(threshold, tolerance), "u binary, v binary")
    candidates = scratch.saved(components(edges, scratch), "candidates")

    n_bits = 1 << 27
    bits = spark.sparkContext.broadcast(key_filter(candidates.select(F.col("u").alias("key")), n_bits))
    texts = docs.select("text").mapInArrow(_texts_of(bits, n_bits), "key binary, text string").groupBy("key").agg(F.max("text").alias("text"))
    texts = texts.join(candidates.withColumnRenamed("u", "key"), "key").join(classes.select("key", "n_docs"), "key")
    texts = scratch.saved(texts, "texts")
    sizes = texts.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(F.length("text")) / block_chars)).alias("n_blocks"))
    tasks = block_pairs(texts.join(sizes, "component"), "component", "n_blocks", "key").select("task", "side", "crossing", "key", "n_docs", "text")
    found = tasks.repartition("task").sortWithinPartitions("task", "key").mapInArrow(_verify(threshold, tolerance), "u binary, v binary, n long")
    found = scratch.saved(found, "links")

    links = found.where("n > 0").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("linked"))
    grouped = components(found.where("v is not null").select("u", "v"), scratch)
    grouped = classes.select("key", "n_docs", "min_id").join(grouped.withColumnRenamed("u", "key"), "key", "left").join(links, "key", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "key"))
    lowest = grouped.groupBy("component").agg(F.min("min_id").alias("class_id"))
    grouped = grouped.join(lowest, "component").select("key", "class_id", F.col("min_id").alias("exact_id"), (F.col("n_docs") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    grouped = scratch.saved(grouped, "groups")
    scratch.drop(candidates, texts, found)
    out = signed.select("doc_id", "key").join(grouped, "key", "left")
    alone = F.col("key").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("exact_id")).alias("exact_id"),
    )


def one_per_group(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that have their group's smallest doc_id, one row for each such id and text.

    Rows without a doc_id have nothing to be chosen by and all stay.
    """
    found = near_join(docs, threshold)
    chosen = found.where("doc_id = class_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    repeated = chosen.where("_n > 1").select("doc_id")
    kept = docs.join(chosen.select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    if not repeated.isEmpty():
        twice = kept.join(repeated, "doc_id", "left_semi").select(docs.columns)
        kept = kept.join(repeated, "doc_id", "left_anti").select(docs.columns).union(twice.dropDuplicates(["doc_id", "text"]))
    if docs.where("doc_id is null").isEmpty():
        return kept
    return kept.union(docs.where("doc_id is null"))
