"""Benchmark decontamination: a broadcast set of benchmark word windows, scanned over every text.

The windows of all benchmark items are hashed. Their number is counted first: up to
``max_windows`` they are one broadcast block of a few arrays (hash, place in one run of bytes, item), about
120 bytes a window. Beyond that a Bloom filter of all windows is broadcast, of at most
``bloom.MOST_BITS``; the windows of texts that pass it, with their words, are joined with the items' windows,
and what was found goes back to the documents by a digest of the text. Texts are read twice then and
never written. Every hash hit is compared word by word with the item before it counts, both ways.

Cases: a null or wordless text has no words and no hits; an item without words has no windows; a
null item_id counts as ''; items that repeat an id count once; repeated documents are rows of their
own; texts of any length are taken in slices of about 1 MB and one text at least; an empty benchmark
hits nothing, an empty table gives no rows; columns of the input named like a result column are
replaced by it in ``scan``, and come back unchanged from the functions that remove.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm import textwords
from tideline.llm.bloom import Bloom
from tideline.llm.common import Scratch, unused

#: A word for Spark's own functions; ``textwords`` has the same for bytes.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _windows_of_items(n: int):
    def run(batches):
        for batch in batches:
            for part in textwords.slices(batch, "text"):
                data, _, starts, ends, hashes, first = textwords.words(part.column("text"))
                rows = defaultdict(list)
                for i, item in enumerate(part.column("item_id").to_pylist()):
                    size = min(n, first[i + 1] - first[i])
                    for k in range(first[i], first[i + 1] - size + 1) if size else ():
                        rows["item_id"].append(item or "")
                        rows["size"].append(size)
                        rows["window"].append(b" ".join(data[s:e].tobytes() for s, e in zip(starts[k : k + size], ends[k : k + size])))
                        rows["hash"].append(int(textwords.window_hashes(hashes[k : k + size], size)[0].astype(np.int64)))
                if rows:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "item_id": pa.array(rows["item_id"], pa.string()),
                            "size": pa.array(rows["size"], pa.int32()),
                            "window": pa.array(rows["window"], pa.binary()),
                            "hash": pa.array(rows["hash"], pa.int64()),
                        }
                    )

    return run


def item_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(item_id, size, window, hash): n consecutive words, or all words of a shorter item."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_windows_of_items(n), "item_id string, size int, window binary, hash long").distinct()


class Windows:
    """One block of benchmark windows, ready to be looked up."""

    FILTER_BITS = 22

    def __init__(self, table: pa.Table):
        """table: (item_id, size, window, hash)."""
        items = table.column("item_id").combine_chunks().dictionary_encode()
        self.items, codes = items.dictionary.to_pylist(), items.indices.to_numpy(zero_copy_only=False)
        hashes, sizes = table.column("hash").to_numpy().astype(np.uint64), table.column("size").to_numpy()
        windows, self.by_size = table.column("window").combine_chunks(), {}
        for size in np.unique(sizes):
            mine = np.flatnonzero(sizes == size)
            mine = mine[np.argsort(hashes[mine], kind="stable")]
            part = windows.take(pa.array(mine)).cast(pa.large_binary())
            offsets, data = np.frombuffer(part.buffers()[1], np.int64)[: len(mine) + 1], part.buffers()[2].to_pybytes()
            seen = np.zeros(1 << self.FILTER_BITS, bool)
            seen[hashes[mine] >> np.uint64(64 - self.FILTER_BITS)] = True
            self.by_size[int(size)] = hashes[mine], seen, offsets, data, codes[mine]

    def find(self, data, starts, ends, hashes, first):
        """(hit flag of each word, {row: set of items})."""
        hit, items = np.zeros(len(hashes) + 1, np.int64), defaultdict(set)
        row_end = np.repeat(first[1:], np.diff(first))
        for size, (keys, seen, offsets, windows, codes) in self.by_size.items():
            found = textwords.window_hashes(hashes, size)
            at = np.flatnonzero(seen[found >> np.uint64(64 - self.FILTER_BITS)])
            at = at[at + size <= row_end[at]]
            low, high = np.searchsorted(keys, found[at], "left"), np.searchsorted(keys, found[at], "right")
            some = low < high
            for k, a, b in zip(at[some].tolist(), low[some].tolist(), high[some].tolist()):
                text = b" ".join(data[s:e].tobytes() for s, e in zip(starts[k : k + size], ends[k : k + size]))
                ids = [codes[j] for j in range(a, b) if windows[offsets[j] : offsets[j + 1]] == text]
                if ids:
                    hit[k] += 1
                    hit[k + size] -= 1
                    items[int(np.searchsorted(first, k, side="right")) - 1].update(self.items[i] for i in ids)
        return np.cumsum(hit[:-1]) > 0, items


def _scan(windows):
    def run(batches):
        block = windows.value
        for batch in batches:
            for part in textwords.slices(batch, "text"):
                data, _, starts, ends, hashes, first = textwords.words(part.column("text"))
                hit, items = block.find(data, starts, ends, hashes, first)
                where = np.flatnonzero(hit)
                row = np.searchsorted(first, where, side="right") - 1
                hits, ids = [[] for _ in range(part.num_rows)], [[] for _ in range(part.num_rows)]
                for i in np.unique(row):
                    hits[i] = (where[row == i] - first[i]).tolist()
                    ids[i] = sorted(items[int(i)])
                keep = [k for k, name in enumerate(part.schema.names) if name not in RESULT.names]
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in keep] + [pa.array(np.diff(first), pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.string()))],
                    names=[part.schema.names[k] for k in keep] + RESULT.names,
                )

    return run


def _covered(at: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """The runs of words (begin, end) that windows beginning at ``at``, ascending, cover."""
    cut = np.flatnonzero(np.diff(at) > size) + 1
    return at[np.concatenate([[0], cut])].tolist(), (at[np.concatenate([cut - 1, [len(at) - 1]])] + size).tolist()


def _passing(bloom, sizes: list[int], most: int = 50_000):
    """The windows of texts that the filter lets pass, at most about ``most`` of one text a batch."""

    def run(batches):
        for batch in batches:
            for part in textwords.slices(batch, "text"):
                data, _, starts, ends, hashes, first = textwords.words(part.column("text"))
                row_end, keys = np.repeat(first[1:], np.diff(first)), part.column("key").to_pylist()
                for size in sizes:
                    found = textwords.window_hashes(hashes, size)
                    at = np.flatnonzero(bloom.value.holds(found))
                    at = at[at + size <= row_end[at]]
                    row = np.searchsorted(first, at, side="right") - 1
                    for i in np.unique(row):
                        mine = at[row == i]
                        for k in range(0, len(mine), most):
                            places = defaultdict(list)
                            for j in mine[k : k + most].tolist():
                                places[int(found[j].astype(np.int64)), b" ".join(data[s:e].tobytes() for s, e in zip(starts[j : j + size], ends[j : j + size]))].append(j - first[i])
                            runs = [_covered(np.array(p), size) for p in places.values()]
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array([keys[i]] * len(runs), pa.string()),
                                    pa.array([size] * len(runs), pa.int32()),
                                    pa.array([h for h, _ in places], pa.int64()),
                                    pa.array([w for _, w in places], pa.binary()),
                                    pa.array([b for b, _ in runs], pa.list_(pa.int32())),
                                    pa.array([e for _, e in runs], pa.list_(pa.int32())),
                                ],
                                names=["key", "size", "hash", "window", "begins", "ends"],
                            )

    return run


def _scan_joined(docs: DataFrame, windows: DataFrame, count: int) -> DataFrame:
    """The same result as the scan of one block, for any number of windows (a saved table).

    A window that a third of all texts hold is one key of the join: copies of a text are one row before, and the
    adaptive plan splits such a partition, as the items' side has one row a window.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most n
    bloom = spark.sparkContext.broadcast(Bloom(windows.select("hash"), count))
    digest = unused(docs, "digest")
    keyed = docs.withColumn(digest, F.sha2("text", 256))
    passing = keyed.select(F.col(digest).alias("key"), "text").mapInArrow(
        _passing(bloom, sizes), "key string, size int, hash long, window binary, begins array<int>, ends array<int>"
    )
    of_items = windows.groupBy("size", "hash", "window").agg(F.collect_set("item_id").alias("ids"))
    words = F.flatten(F.transform(F.arrays_zip("begins", "ends"), lambda r: F.sequence(r["begins"], r["ends"] - 1)))
    found = passing.distinct().join(of_items, ["size", "hash", "window"]).groupBy("key")
    hits = found.agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(words)))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"),
    )
    hits = scratch.saved(hits.withColumnRenamed("key", digest), "hits")
    n_words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    out = keyed.join(hits, digest, "left").withColumn("n_words", n_words)
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select(*docs.columns, "n_words", empty("hit_words", "array<int>"), empty("items", "array<string>"))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = 200_000) -> DataFrame:
    """docs with n_words, hit_words (positions of hit words) and items (ids found, sorted as strings)."""
    spark = docs.sparkSession
    docs = docs.select([c for c in docs.columns if c not in RESULT.names])
    if dict(docs.dtypes)["text"] != "string":
        docs = docs.withColumn("text", F.col("text").cast("string"))
    windows = Scratch(spark).saved(item_windows(benchmark, n), "windows")
    count = windows.count()
    if count > max_windows:
        return _scan_joined(docs, windows, count)
    shared = spark.sparkContext.broadcast(Windows(windows.toArrow()))
    return docs.mapInArrow(_scan(shared), T.StructType(docs.schema.fields + RESULT.fields))


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted ids), contaminated."""
    return scan(docs.select("doc_id", "text"), benchmark, n).select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def _hidden(docs: DataFrame) -> DataFrame:
    """docs with the columns renamed that scan() would replace."""
    return docs.select([F.col(c).alias(f"_own_{c}" if c in RESULT.names else c) for c in docs.columns])


def _shown(found: DataFrame, columns: list[str]) -> DataFrame:
    return found.select([F.col(f"_own_{c}" if c in RESULT.names else c).alias(c) for c in columns])


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents without any hit word, with the columns they came with."""
    return _shown(scan(_hidden(docs), benchmark, n).where(F.size("hit_words") == 0), docs.columns)


def _cut(batches):
    """Texts without their hit words, each run of them with all that stands between."""
    for batch in batches:
        names, texts = batch.schema.names, []
        for part in textwords.slices(batch, "text"):
            _, offsets, starts, ends, _, first = textwords.words(part.column("text"))
            for i, (text, hits) in enumerate(zip(part.column("text").to_pylist(), part.column("hit_words").to_pylist())):
                raw, at, parts = (text or "").encode(), 0, []
                mine = np.array(hits, np.int64) + first[i]
                for run in np.split(mine, np.flatnonzero(np.diff(mine) > 1) + 1) if len(mine) else ():
                    parts.append(raw[at : starts[run[0]] - offsets[i]])
                    at = ends[run[-1]] - offsets[i]
                texts.append((b"".join(parts) + raw[at:]).decode())
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(k) for k, n in enumerate(names)], names=names)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = 200_000) -> DataFrame:
    """docs with each run of hit words cut out of the text, until no window is left.

    What a cut brings together can be a window again, so documents that were cut are scanned again;
    texts get shorter, and a round has only the documents that the round before cut.
    """
    scratch, done, rest = Scratch(docs.sparkSession), None, _hidden(docs)
    while True:
        found = scratch.saved(scan(rest, benchmark, n, max_windows), "scanned")
        hit = F.size("hit_words") > 0
        done = found.where(~hit) if done is None else done.unionByName(found.where(~hit))
        if found.where(hit).isEmpty():
            return _shown(done, docs.columns)
        rest = scratch.saved(found.where(hit).mapInArrow(_cut, found.schema), "cut")
