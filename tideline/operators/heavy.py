"""Keys with the most rows, by mergeable counters in place of a count of every key.

Each task keeps ``capacity`` counters. When it holds more, the count of the first one too many is taken off
all, and those at zero go; what was taken off in total, ``lost``, is how much a counter may be too low
and how many rows a key without a counter may have. Counters of tasks, batches and tables add up, and so
does what they lost; at any time ``lost <= rows / (capacity + 1)``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.streaming.run import working_dir

CAPACITY = 1000
#: Candidates that are sent to every executor; more are joined.
BROADCAST_KEYS = 100_000
#: Rows, and bytes, of which a task counts keys at a time.
ROWS, BYTES = 200_000, 1 << 24
COUNTERS = "key string, n long, rows long, lost long"


def reduced(held: dict, capacity: int) -> tuple[dict, int]:
    """At most ``capacity`` counters, and what each has lost."""
    if len(held) <= capacity:
        return held, 0
    counts = np.fromiter(held.values(), np.int64, len(held))
    off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    return {k: n - off for k, n in held.items() if n > off}, off


def _pieces(batches):
    """The keys of several batches together."""
    some, rows, size = [], 0, 0
    for batch in batches:
        some.append(batch.column(0))
        rows, size = rows + batch.num_rows, size + batch.column(0).nbytes
        if rows >= ROWS or size >= BYTES:
            yield pa.chunked_array(some)
            some, rows, size = [], 0, 0
    if some:
        yield pa.chunked_array(some)


def _count(capacity: int):
    def run(batches):
        held, rows, lost = {}, 0, 0
        for keys in _pieces(batches):
            rows += len(keys)
            found = pc.value_counts(keys)
            for key, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                held[key] = held.get(key, 0) + n
            if len(held) > 8 * capacity:
                held, off = reduced(held, capacity)
                lost += off
        held, off = reduced(held, capacity)
        keys, n = [*held, None], [*held.values(), None]
        none = [0] * len(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(n, pa.int64()), pa.array([*none, rows], pa.int64()), pa.array([*none, lost + off], pa.int64())], names=["key", "n", "rows", "lost"])

    return run


def counters(rows: DataFrame, key: Column | str = "key", capacity: int = CAPACITY) -> DataFrame:
    """(key, n, rows, lost): the counters of each task and, with n null, a row of its rows and what it lost."""
    key = F.col(key) if isinstance(key, str) else key
    return rows.select(key.cast("string").alias("key")).mapInArrow(_count(capacity), COUNTERS)


def merged(parts: DataFrame) -> DataFrame:
    """(key, at_least) of counters of any number of tasks."""
    return parts.where("n is not null").groupBy("key").agg(F.sum("n").alias("at_least"))


def heavy_keys(rows: DataFrame, k: int = 10, key: Column | str = "key", capacity: int = CAPACITY) -> DataFrame:
    """(key, n): the k keys with the most rows, exactly; ties go to the smaller key, and a null key is a key.

    Counters of a first pass tell which keys can be among them: those whose count, with what may be
    lost, reaches the kth. A second pass counts these alone, so no other key is shuffled. Where nothing was
    lost the counters are the counts; where so much was lost that a key without a counter could be among
    the first k (flat counts), all keys are counted.
    """
    key = F.col(key) if isinstance(key, str) else key
    spark, path = rows.sparkSession, working_dir(rows.sparkSession, "counters")
    counters(rows, key, capacity).write.parquet(path)
    parts = spark.read.schema(COUNTERS).parquet(path)
    found = merged(parts)
    first = lambda df: df.orderBy(F.desc("n"), "key").limit(k)
    lost = parts.agg(F.coalesce(F.sum("lost"), F.lit(0))).first()[0]
    if not lost:
        return first(found.select("key", F.col("at_least").alias("n")))
    kept, kth = found.orderBy(F.desc("at_least")).limit(k).agg(F.count(F.lit(1)), F.min("at_least")).first()
    given = rows.select(key.cast("string").alias("key"))
    if kept == k and kth > lost:
        can = found.where(F.col("at_least") + lost >= kth).select(F.col("key").alias("_key"))
        can = F.broadcast(can) if can.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else can
        given = given.join(can, F.col("key").eqNullSafe(F.col("_key")), "left_semi")
    return first(given.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
