"""Exact top-k by inner product: KD-trees per shard, searched best-first.

Components become whole numbers, ``floor(scale * x)``. Of rows with the same vector only the k + 1 with the
smallest ids can be among the best k of any query, so no other is a candidate, and queries with one vector
are searched once; a query's own row is taken out at the end.

1. Median splits of a bounded sample (``SAMPLE`` numbers) cut space into *regions* of about ``per_shard``
   candidates; a region with more is dealt into several *shards* by hash, so no shard outgrows a task.
2. A shard's task builds a KD-tree: the widest dimension is split at its median down to ``LEAF`` rows, and
   every node has the tight box of its rows. A query visits nodes best-first by the largest inner product
   that a point of the box could have, and stops where that is below its kth score so far.
3. Each query is first searched in a shard of its own region. Its kth score there goes with it to the other
   shards, and only to those whose region's box can reach it.

Bounds and scores are exact: products of whole numbers in double precision while no sum can pass 2**53, in
Python's whole numbers beyond. Ties go to the smaller vec_id, rows without one last.

Cases: vectors that are null or have a null or non-finite component take no part; vectors are compared with
those of their own length only, empty ones with score 0; rows that repeat a vec_id are rows of their own;
fewer than k candidates give them all; a score beyond 64 bits raises; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import Scratch
from tideline.llm.near_join import whole_groups

#: Rows of a leaf; numbers of the sample that regions are cut by; the most regions; queries of a task.
LEAF, SAMPLE, MOST_REGIONS, BLOCK = 64, 1 << 21, 1024, 8192
#: Doubles hold whole numbers up to here.
EXACT = 1 << 53
LOW, HIGH = -(1 << 62), 1 << 62


class Regions:
    """A few levels of median splits; ``of`` gives the region of each row."""

    def __init__(self, x: np.ndarray, depth: int):
        self.dim, self.at = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        self.depth = depth
        self._split(x, 1)

    def _split(self, x: np.ndarray, node: int):
        if node >= 1 << self.depth:
            return
        if x.size:
            self.dim[node] = d = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
            self.at[node] = np.median(x[:, d])
            left = x[:, d] <= self.at[node]
            if left.all():  # most are at the largest value
                self.at[node] = x[x[:, d] < self.at[node], d].max(initial=self.at[node] - 1)
                left = x[:, d] <= self.at[node]
            self._split(x[left], 2 * node)
            self._split(x[~left], 2 * node + 1)

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        if x.shape[1]:
            for _ in range(self.depth):
                node = 2 * node + (x[np.arange(len(x)), self.dim[node]] > self.at[node])
        return node


class Tree:
    """A KD-tree over rows of whole numbers: median splits, a tight box for every node."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.spans, self.children = [(0, len(x))], [None]
        at = 0
        while at < len(self.spans):
            s, e = self.spans[at]
            part = x[self.order[s:e]]
            if e - s > leaf and part.shape[1]:
                spread = part.max(axis=0) - part.min(axis=0)
                d = int(np.argmax(spread))
                if spread[d]:
                    middle = (e - s) // 2
                    self.order[s:e] = self.order[s:e][np.argsort(part[:, d], kind="stable")]
                    self.children[at] = (len(self.spans), len(self.spans) + 1)
                    self.spans += [(s, s + middle), (s + middle, e)]
                    self.children += [None, None]
            at += 1
        self.x = x[self.order]
        self.low = np.stack([self.x[s:e].min(axis=0) for s, e in self.spans])
        self.high = np.stack([self.x[s:e].max(axis=0) for s, e in self.spans])

    def search(self, q: np.ndarray, ids: np.ndarray, k: int, known: np.ndarray):
        """For each query: places of its best k rows with score >= known, its kth score elsewhere.

        Queries go through the tree together: each pops nodes best-first from a heap of its own until a
        leaf is on top, and the queries at one leaf take its rows in one product.
        """
        bound = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        score = np.full((len(q), k), LOW, q.dtype)
        place = np.full((len(q), k), -1, np.int64)
        kth, given = known.copy(), known
        heaps = [[(-b, 0)] if b >= w else [] for b, w in zip(bound[:, 0].tolist(), kth.tolist())]
        active = [i for i, h in enumerate(heaps) if h]
        ids = ids[self.order]
        while active:
            at, still, worst = {}, [], kth.tolist()
            for i in active:
                heap, w = heaps[i], worst[i]
                while heap:
                    b, node = heapq.heappop(heap)
                    if -b < w:
                        heap.clear()
                        break
                    if (below := self.children[node]) is None:
                        at.setdefault(node, []).append(i)
                        still.append(i)
                        break
                    for c in below:
                        if (v := bound[i, c]) >= w:
                            heapq.heappush(heap, (-v, c))
            for node, some in at.items():
                s, e = self.spans[node]
                some = np.array(some)
                found = q[some] @ self.x[s:e].T
                good = (found >= kth[some][:, None]).astype(bool).any(axis=1)
                some, found = some[good], found[good]
                if len(some):
                    both = np.concatenate([score[some], found], axis=1)
                    where = np.concatenate([place[some], np.broadcast_to(np.arange(s, e), found.shape)], axis=1)
                    by_id = np.argsort(np.where(where < 0, np.iinfo(np.int64).max, ids[where]), axis=1, kind="stable")
                    both, where = np.take_along_axis(both, by_id, 1), np.take_along_axis(where, by_id, 1)
                    best = np.argsort(-both, axis=1, kind="stable")[:, :k]
                    score[some], place[some] = np.take_along_axis(both, best, 1), np.take_along_axis(where, best, 1)
                    kth[some] = np.maximum(given[some], score[some][:, -1])
            active = [i for i in still if heaps[i]]
        return place, score


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _route(regions):
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                found = regions.value[int(dim)].of(_matrix(part.column("code"), int(dim))) if int(dim) in regions.value else np.ones(part.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.int32())], names=[*part.schema.names, "region"])

    return run


def _boxes(batches):
    """The box of each region among a task's rows, a row a dimension."""
    found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        dims, regions = batch.column("dim").to_numpy(), batch.column("region").to_numpy()
        for dim in np.unique(dims):
            own = dims == dim
            x, region = _matrix(batch.column("code").filter(pa.array(own)), int(dim)), regions[own]
            for r in np.unique(region):
                low, high = x[region == r].min(axis=0), x[region == r].max(axis=0)
                before = found.get((int(dim), int(r)), (low, high))
                found[int(dim), int(r)] = np.minimum(low, before[0]), np.maximum(high, before[1])
    for (dim, region), (low, high) in found.items():
        columns = [np.full(dim, dim, np.int32), np.full(dim, region, np.int32), np.arange(dim, dtype=np.int32), low, high]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dim", "region", "i", "low", "high"])


def _doubles(*arrays: np.ndarray) -> list[np.ndarray]:
    """Arrays whose inner products are exact: of doubles, or of Python's whole numbers."""
    most = [int(max(abs(int(x.max())), abs(int(x.min())))) if x.size else 0 for x in arrays]
    safe = most[0] * max(most[1:], default=0) * max(1, arrays[0].shape[1]) < EXACT
    return [x.astype(np.float64 if safe else object) for x in arrays]


def _reach(boxes):
    """(key, region) of each region other than a query's own that its kth score leads to."""

    def run(batches):
        for batch in batches:
            dims, own, kth = batch.column("dim").to_numpy(), batch.column("region").to_numpy(), batch.column("kth").to_numpy()
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                regions, low, high = boxes.value[int(dim)]
                q, low, high = _doubles(_matrix(batch.column("code").take(pa.array(mine)), int(dim)), low, high)
                bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                row, found = np.nonzero((bound >= kth[mine][:, None]).astype(bool))
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(mine[row])), pa.array(regions[found], pa.int32())], names=["key", "region"])

    return run


HITS = "key string, vec_id {id}, score long, same boolean"


def _search(k: int, id_type: pa.DataType):
    def run(batches):
        for t in whole_groups(batches, "task", 8 << 20):
            task = t.column("task").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
            for s, e in zip(cuts, cuts[1:]):
                part = t.slice(s, e - s)
                query = part.column("is_query").to_numpy()
                n_rows = int((~query).sum())  # candidates come first
                if not n_rows or n_rows == len(query):
                    continue
                x, q = _doubles(*(_matrix(part.column("code").slice(a, n), part.column("dim")[0].as_py()) for a, n in ((0, n_rows), (n_rows, len(query) - n_rows))))
                ids = part.column("vec_id").slice(0, n_rows).combine_chunks()
                order = np.argsort(np.argsort(np.where(ids.is_null(), np.iinfo(np.int64).max, ids.fill_null(0).to_numpy()), kind="stable"))  # nulls last
                tree = Tree(x)
                known = part.column("kth").slice(n_rows).to_numpy().astype(q.dtype)
                place, score = tree.search(q, order, k, known)
                row, col = np.nonzero(place >= 0)
                keep = (score[row, col] >= known[row]).astype(bool)
                row, col = row[keep], col[keep]
                found, of = tree.order[place[row, col]], part.column("key").combine_chunks()
                keys, theirs = of.take(pa.array(n_rows + row)), of.take(pa.array(found))
                scores = pa.array([int(v) for v in score[row, col]], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, ids.take(pa.array(found)).cast(id_type), scores, pc.equal(keys, theirs)], names=["key", "vec_id", "score", "same"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, per_shard: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of ``vectors(vec_id, embedding)`` that ``is_query`` holds for, against all others."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    x = F.col("embedding").cast("array<double>")
    usable = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    given = vectors.select("vec_id", F.coalesce(is_query, F.lit(False)).alias("is_query"), x.alias("embedding")).where(usable)
    given = given.select("vec_id", "is_query", F.transform("embedding", lambda v: F.floor(v * scale).cast("long")).alias("code"))
    given = given.withColumn("key", F.concat_ws("/", F.xxhash64("code").cast("string"), F.xxhash64(F.lit(1), "code").cast("string"))).withColumn("dim", F.size("code"))
    id_type = dict(given.dtypes)["vec_id"]
    own = scratch.saved(given.where("is_query").select("vec_id", "key"), "queries")

    # the smallest ids of each vector; tasks drop the others before the shuffle
    first = Window.partitionBy("key").orderBy(F.col("vec_id").asc_nulls_last())
    rows = given.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select("key", "vec_id", "dim", "code")
    rows = scratch.saved(rows, "candidates")
    regions = spark.sparkContext.broadcast(_fit(rows, per_shard))
    rows = scratch.saved(rows.mapInArrow(_route(regions), f"key string, vec_id {id_type}, dim int, code array<long>, region int"), "regions")
    shards = rows.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / (2 * per_shard)).alias("n_shards"))
    sizes = spark.createDataFrame(shards.collect(), shards.schema)  # a row a region
    boxes = spark.sparkContext.broadcast(_region_boxes(rows, sizes))

    asked = given.where("is_query").groupBy("key").agg(F.first("code").alias("code"), F.first("dim").alias("dim"))
    asked = asked.mapInArrow(_route(regions), "key string, code array<long>, dim int, region int")
    asked = scratch.saved(asked.withColumn("kth", F.lit(LOW)), "asked")
    home = asked.join(F.broadcast(sizes), ["dim", "region"]).withColumn("shard", F.pmod(F.xxhash64("key"), "n_shards"))
    near = scratch.saved(_searched(rows, sizes, home, k + 1, id_type), "near")
    kth = near.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") > k).select("key", "least")
    known = asked.drop("kth").join(kth, "key", "left").withColumn("kth", F.coalesce("least", F.lit(LOW))).drop("least")
    known = scratch.saved(known, "known")
    there = known.mapInArrow(_reach(boxes), "key string, region int")
    there = there.join(known.withColumnRenamed("region", "home"), "key").join(F.broadcast(sizes), ["dim", "region"])
    there = there.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_shards") - 1)))
    there = there.where(~((F.col("region") == F.col("home")) & (F.col("shard") == F.pmod(F.xxhash64("key"), "n_shards"))))
    far = scratch.saved(_searched(rows, sizes, there, k + 1, id_type), "far")

    order = [F.desc("score"), F.col("vec_id").asc_nulls_last()]
    best = near.union(far).withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("n") <= k + 1)
    best = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score", "same"))).alias("best"))  # k + 1 of a query
    mine = F.array_position(F.transform("best", lambda b: F.coalesce(b["same"] & (b["vec_id"] == F.col("query_id")), F.lit(False))), F.lit(True))
    out = own.withColumnRenamed("vec_id", "query_id").join(best, "key").withColumn("mine", mine)
    others = F.slice(F.filter("best", lambda b, i: i + 1 != F.col("mine")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("i", "b"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def _fit(rows: DataFrame, per_shard: int) -> dict[int, Regions]:
    """Splits for each vector length, from as many rows as make ``SAMPLE`` numbers."""
    out = {}
    for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect():
        depth = min(MOST_REGIONS.bit_length() - 1, max(0, (-(-r["n"] // per_shard) - 1).bit_length()))
        share = min(1.0, SAMPLE / max(1, r["dim"]) / r["n"])
        some = rows.where((F.col("dim") == r["dim"]) & (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share * (1 << 30))).select("code")
        if depth:
            out[r["dim"]] = Regions(_matrix(some.limit(2 * SAMPLE // max(1, r["dim"])).toArrow().column("code"), r["dim"]), depth)
    return out


def _region_boxes(rows: DataFrame, sizes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each vector length: its regions, and their boxes' low and high corners; ``MOST_REGIONS`` of a length at most."""
    out: dict[int, dict[int, tuple[list, list]]] = {}
    for r in sizes.collect():
        out.setdefault(r["dim"], {})[r["region"]] = ([0] * r["dim"], [0] * r["dim"])
    sides = rows.select("dim", "code", "region").mapInArrow(_boxes, "dim int, region int, i int, low long, high long")
    for r in sides.groupBy("dim", "region", "i").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low, high = out[r["dim"]][r["region"]]
        low[r["i"]], high[r["i"]] = r["low"], r["high"]
    return {d: (np.array(list(b)), *(np.array([v[i] for v in b.values()], np.int64).reshape(len(b), d) for i in (0, 1))) for d, b in out.items()}


def _searched(rows: DataFrame, sizes: DataFrame, asked: DataFrame, k: int, id_type: str) -> DataFrame:
    """Hits of asked(key, code, dim, region, shard, kth) in their shards; a shard's queries make blocks of tasks."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    place = ["dim", "region", "shard"]
    blocks = asked.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n_blocks"))
    members = rows.join(F.broadcast(sizes), ["dim", "region"]).withColumn("shard", F.pmod(F.xxhash64("vec_id", "key"), "n_shards"))
    members = members.join(blocks, place).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    questions = asked.join(blocks, place).withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), "n_blocks"))
    task = F.xxhash64(*place, "block").alias("task")
    members = members.select(task, F.lit(False).alias("is_query"), "key", "vec_id", "dim", "code", F.lit(LOW).alias("kth"))
    questions = questions.select(task, F.lit(True).alias("is_query"), "key", F.lit(None).cast(id_type).alias("vec_id"), "dim", "code", "kth")
    tasks = members.unionByName(questions).repartition("task").sortWithinPartitions("task", "is_query")
    return tasks.mapInArrow(_search(k, to_arrow_type(_parse_datatype_string(id_type))), HITS.format(id=id_type))
