"""Replica blocks merged batch by batch, by version vectors.

The saved log (``Snapshots`` at a path) holds

* ``blocks``  the merged blocks, file and client in runs without gaps from 1
* ``vector``  (file, client, seq): up to where each client is merged
* ``held``    blocks beyond a gap, which wait until it closes
* ``late``    copies and checksums of blocks that came again after they were merged

A batch reads its own blocks, the vector and what is held, never the log. As sequences have no gaps, a
block's number in its file follows from the vector, so nothing is numbered again as clients grow. A
block's content is that of the batch that merged it (of that batch's copies the one with the smallest
checksum); a later copy that differs makes ``conflict`` true. A batch that is tried again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators.numbering import MAX_GROUP, number_within
from tideline.sources.snapshots import Snapshots, read_snapshot

KEY = ["file", "client", "seq"]


def _combined(blocks: DataFrame) -> DataFrame:
    """One row a block of blocks(file, client, seq, content, copies, low, high)."""
    return blocks.groupBy(*KEY).agg(F.min_by("content", "low").alias("content"), F.sum("copies").alias("copies"), F.min("low").alias("low"), F.max("high").alias("high"))


def merge_batch(blocks: DataFrame, path: str, batch: int, max_group: int = MAX_GROUP) -> bool:
    """Merge blocks(file, client, seq, content) of any replicas into the log at ``path``; whether this batch was new."""
    spark = blocks.sparkSession
    log = Snapshots(spark, path)
    version = log.version()
    if version and version["batch"] >= batch:
        return False
    sha1 = F.sha1(F.col("content").cast("binary"))
    given = _combined(blocks.select("file", "client", F.col("seq").cast("long").alias("seq"), "content", F.lit(1).cast("long").alias("copies"), sha1.alias("low"), sha1.alias("high")))
    vector = log.read("vector", version)
    if vector is None:
        vector = given.select("file", "client", F.lit(0).cast("long").alias("seq")).limit(0)
    known = given.join(vector.withColumnRenamed("seq", "merged"), ["file", "client"], "left").withColumn("merged", F.coalesce("merged", F.lit(0)))
    late = known.where("seq <= merged").select(*KEY, "copies", "low", "high")
    fresh = known.where("seq > merged").drop("merged")
    held = log.read("held", version)
    if held is not None:
        fresh = _combined(fresh.unionByName(held))
    # numbered from where the client stands, a block without a gap before it has its own number
    fresh = number_within(fresh, ["file", "client"], ["seq"], "nth", max_group).join(vector.withColumnRenamed("seq", "merged"), ["file", "client"], "left")
    whole = F.coalesce("merged", F.lit(0)) + F.col("nth") == F.col("seq")
    merged, beyond = (fresh.where(c).select(*KEY, "content", "copies", "low", "high") for c in (whole, ~whole))
    grown = vector.union(merged.select(*KEY)).groupBy("file", "client").agg(F.max("seq").alias("seq"))
    return log.commit(batch, replace={"vector": grown, "held": beyond}, append={"blocks": merged, "late": late})


def version_vector(spark: SparkSession, path: str) -> DataFrame:
    """(file, client, seq): up to where each client is merged."""
    return read_snapshot(spark, path, "vector")


def held_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks that wait for one before them."""
    return read_snapshot(spark, path, "held").select(*KEY)


def merged_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, client, seq, content, copies, conflict), as ``merge_replicas`` gives it for all batches at once."""
    log = Snapshots(spark, path)
    version = log.version()
    if version is None:
        raise FileNotFoundError(f"{path} has no batch yet")
    before = Window.partitionBy("file").orderBy("client").rowsBetween(Window.unboundedPreceding, -1)  # a row a client
    starts = log.read("vector", version).select("file", "client", F.coalesce(F.sum("seq").over(before), F.lit(0)).alias("before"))
    late = log.read("late", version).groupBy(*KEY).agg(F.sum("copies").alias("more"), F.min("low").alias("late_low"), F.max("high").alias("late_high"))
    out = log.read("blocks", version).join(late, KEY, "left").join(starts, ["file", "client"])
    conflict = (F.least("low", "late_low") != F.greatest("high", "late_high")).alias("conflict")
    return out.select("file", (F.col("before") + F.col("seq")).cast("int").alias("block"), "client", "seq", "content", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies"), conflict)
