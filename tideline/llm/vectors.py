"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one vector a group.

Vectors with the same label and the same values are one *class*. Cells are the nearest of k-means
centres in two levels: about one cell for every ``per_cell`` classes of the largest label, up to
``MOST_TOP`` top cells of ``SUB`` cells each. Centres are fitted on a bounded sample of class vectors
(``sample``, or ``PER_CENTRE`` a cell where that is more); every class goes to its nearest cell, its *home*.

A vector also *visits* lower-numbered cells where a partner could live. The members x of home a lie on
a's side of the plane between the centres a and b. A vector y of home b at angle t to x is
``cos(t) x + sin(t) e`` with a unit vector e, so it is beyond that plane by ``sin(t) e.n`` at most, n
being the plane's normal. Nothing is lost where y visits up to ``sin(t)``; but among ``dim`` directions
e.n spreads like ``1 / sqrt(dim)``, so y visits up to ``min(1, z / sqrt(dim)) sin(t)``. ``z=inf`` is
exact; the default loses next to none of the pairs (README has the recall measured), and what is
linked is always verified.

Homes of a cell meet each other and its visitors, in blocks of at most ``block`` rows a side, by
matrix products in double precision. Tasks return sums of links and a star a group of linked
vectors, never the pairs.

Cases: vectors that are null, empty, zero, or have a null or non-finite component, and those without
a label, link with nothing and are kept; vectors of different lengths never link; copies link with
each other; a cosine of exactly the threshold, as double precision gives it, is a link; rows that repeat a vec_id are marked alike; a row without vec_id that links with nothing
is kept; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Scratch
from tideline.llm.graph import components
from tideline.llm.near_join import block_pairs, stars, whole_groups

#: Cells of a top cell; the most top cells; vectors of the sample for each cell.
SUB, MOST_TOP, PER_CENTRE = 64, 1024, 8
#: Vectors that are placed at a time.
SLICE = 1024


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """k unit centres of unit rows; starts from rows that are far apart among a few tries each."""
    rng = np.random.default_rng(7)
    centres = x[[0]]
    for _ in range(k - 1):
        tries = x[rng.integers(0, len(x), 16)]
        centres = np.vstack([centres, tries[np.argmin((tries @ centres.T).max(axis=1))]])
    for _ in range(steps):
        home = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


class Cells:
    """Centres of the cells of one vector length: ``top`` and, for each of them, those below it."""

    def __init__(self, x: np.ndarray, k: int):
        self.top = spherical_kmeans(x, min(len(x), -(-k // SUB)))
        home = np.argmax(x @ self.top.T, axis=1)
        members = [x[home == t] if (home == t).any() else self.top[[t]] for t in range(len(self.top))]
        each = -(-k // len(self.top))
        self.below = [spherical_kmeans(m, min(len(m), each)) for m in members]
        self.first = np.cumsum([0] + [len(b) for b in self.below])

    def place(self, x: np.ndarray, reach: float):
        """(row, cell, home) of each visit; home has bit 1 in the row's own top cell, bit 2 in its own cell there."""
        rows, cells, homes = [], [], []
        row, top, own = visits(x, self.top, reach)
        for t in np.unique(top):
            mine = np.flatnonzero(top == t)
            r, c, h = visits(x[row[mine]], self.below[t], reach)
            rows.append(row[mine][r])
            cells.append(self.first[t] + c)
            homes.append(own[mine][r] + 2 * h)
        return np.concatenate(rows), np.concatenate(cells), np.concatenate(homes)


def visits(x: np.ndarray, centres: np.ndarray, reach: float):
    """(row, centre, whether nearest) of every centre, up to the nearest, to whose side ``reach`` leads."""
    cos = x @ centres.T
    home = np.argmax(cos, axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))[home]
    near = cos[np.arange(len(home)), home][:, None] - cos <= reach * apart + 1e-9
    near &= np.arange(len(centres))[None, :] <= home[:, None]
    row, centre = np.nonzero(near)
    return row, centre, (centre == home[row]).astype(np.int64)


def fit_cells(classes: DataFrame, count: int, k: int, sample: int) -> dict[int, Cells]:
    """Cells for each vector length in a sample of about ``sample`` of ``count`` classes."""
    rows = classes.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < min(1.0, sample / max(1, count)) * (1 << 30)).select("embedding").limit(2 * sample).toArrow()
    column = rows.column("embedding").combine_chunks()
    sizes = np.array([len(v) for v in column], np.int64)
    return {int(dim): Cells(unit_rows(column.filter(pa.array(sizes == dim)), int(dim)), k) for dim in np.unique(sizes)}


def _place(cells, reach: float, z: float):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                sizes = np.array([len(v) for v in some.column("embedding")], np.int64)
                for dim in np.unique(sizes):
                    part = some.filter(pa.array(sizes == dim))
                    if found := cells.value.get(int(dim)):
                        row, cell, home = found.place(unit_rows(part.column("embedding"), int(dim)), reach * min(1.0, z / np.sqrt(dim)))
                    else:  # a length that the sample lacks is one cell
                        row, cell, home = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64), np.full(part.num_rows, 3)
                    out = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [*out.columns, pa.array(np.full(len(row), dim), pa.int32()), pa.array(cell, pa.int32()), pa.array(home, pa.int32())],
                        names=[*out.schema.names, "dim", "cell", "home"],
                    )

    return run


def _compare(threshold: float, tile: int = 1024):
    def run(batches):
        for t in whole_groups(batches, "task", 8 << 20):
            task = t.column("task").to_numpy()
            keys, weight = t.column("key").combine_chunks(), t.column("n").to_numpy()
            home, side = t.column("home").to_numpy(), t.column("side").to_numpy()
            crossing, vectors = t.column("crossing").to_numpy(), t.column("embedding").combine_chunks()
            links, left, right = np.zeros(t.num_rows, np.int64), [], []
            cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
            for a, b in zip(cuts, cuts[1:]):
                part = vectors.slice(a, b - a)
                x = unit_rows(part, len(part[0]))
                for i in range(0, b - a, tile):
                    for j in range(i, b - a, tile):
                        cos = x[i : i + tile] @ x[j : j + tile].T
                        p, q = np.nonzero(cos >= threshold)
                        p, q = p + i + a, q + j + a
                        fit = (p < q) & (home[p] | home[q] == 3) & (~crossing[p] | (side[p] != side[q]))
                        p, q = p[fit], q[fit]
                        if len(p):
                            links[a:b] += np.bincount(p - a, weight[q], b - a).astype(np.int64) + np.bincount(q - a, weight[p], b - a).astype(np.int64)
                            u, v = stars(p - a, q - a, b - a)
                            left.append(u + a)
                            right.append(v + a)
            u, v, some = np.concatenate([*left, links[:0]]), np.concatenate([*right, links[:0]]), np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(np.concatenate([some, u]))),
                    pa.concat_arrays([pa.nulls(len(some), keys.type), keys.take(pa.array(v))]),
                    pa.array(np.concatenate([links[some], np.zeros(len(u), np.int64)])),
                ],
                names=["u", "v", "n"],
            )

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, z: float = 3.5, sample: int = 20_000, per_cell: int = 1_000, block: int = 2_048) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors(vec_id, embedding, label)``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    given = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    if dict(given.dtypes)["embedding"] != "array<float>":  # floats are half of what is shuffled, and exact in double precision
        given = given.withColumn("embedding", F.col("embedding").cast("array<double>"))
    kind = dict(given.dtypes)["embedding"]
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    key = F.when(usable, F.concat_ws("/", F.xxhash64("label", "embedding").cast("string"), F.xxhash64(F.lit(1), "embedding", "label").cast("string")))
    given = given.withColumn("key", key)
    rows = scratch.saved(given.select("vec_id", "key"), "rows")
    classes = given.where("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("min_id"))
    classes = scratch.saved(classes, "classes")
    count, largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    k = min(SUB * MOST_TOP, max(1, -(-largest // per_cell)))
    cells = spark.sparkContext.broadcast(fit_cells(classes, count, k, max(sample, PER_CENTRE * k)))

    placed = classes.select("key", "label", "n", "embedding").mapInArrow(_place(cells, float(np.sin(np.arccos(threshold))), z), f"key string, label string, n long, embedding {kind}, dim int, cell int, home int")
    placed = scratch.saved(placed, "cells")
    sizes = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("n_blocks"), F.xxhash64("label", "dim", "cell").alias("group"))
    tasks = block_pairs(placed.join(sizes, ["label", "dim", "cell"]), "group", "n_blocks", "key").select("task", "side", "crossing", "key", "n", "home", "embedding")
    found = tasks.repartition("task").sortWithinPartitions("task", "key").mapInArrow(_compare(threshold), "u string, v string, n long")
    found = scratch.saved(found, "links")
    links = found.where("n > 0").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("linked"))
    grouped = components(found.where("v is not null").select("u", "v"), scratch)
    grouped = classes.select("key", "n", "min_id").join(grouped.withColumnRenamed("u", "key"), "key", "left").join(links, "key", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "key"))
    lowest = grouped.groupBy("component").agg(F.min("min_id").alias("component_id"))
    grouped = grouped.join(lowest, "component").select("key", "component_id", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    grouped = scratch.saved(grouped, "groups")
    scratch.drop(placed, found)
    out = rows.join(grouped, "key", "left")
    group = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), group.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
