"""The keys of an unbounded stream that have the most rows, in state that doesn't grow with its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.heavy import CAPACITY, COUNTERS, counters, merged
from tideline.sources.snapshots import Snapshots, read_snapshot
from tideline.streaming.run import working_dir


def run_heavy(stream: DataFrame, path: str, checkpoint: str, key: str = "key", capacity: int = CAPACITY) -> None:
    """Keep ``capacity`` counters of what the stream has had so far in ``Snapshots`` at ``path``.

    A batch's tasks count their own rows; counters are added to those of the last version, cut back
    to ``capacity`` and committed with the batch's number, so that a batch that comes again changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, table = batch.sparkSession, Snapshots(batch.sparkSession, path)
        now = table.version()
        if now and now["batch"] >= number:
            return
        made = working_dir(spark, "counters")
        counters(batch, key, capacity).write.parquet(made)
        parts = spark.read.schema(COUNTERS).parquet(made)
        if now:
            before = table.read("counters", now).select("key", F.col("at_least").alias("n"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("lost"))
            parts = parts.union(before).union(table.read("totals", now).select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("n"), "rows", "lost"))
        held = merged(parts)
        n, least = held.orderBy(F.desc("at_least")).limit(capacity + 1).agg(F.count(F.lit(1)), F.min("at_least")).first()
        off = least if n > capacity else 0
        totals = parts.agg(F.sum("rows").alias("rows"), (F.sum("lost") + off).alias("lost"))
        left = held.select("key", (F.col("at_least") - off).alias("at_least")).where("at_least > 0").coalesce(1)  # capacity rows
        table.commit(number, replace={"counters": left, "totals": totals})
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made)
        fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(fs, True)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_heavy(spark: SparkSession, path: str) -> DataFrame:
    """(key, at_least, at_most): every key that had more rows than were lost, at most rows / (capacity + 1), is among them."""
    lost = F.broadcast(read_snapshot(spark, path, "totals").select("lost"))  # one row
    return read_snapshot(spark, path, "counters").join(lost).select("key", "at_least", (F.col("at_least") + F.col("lost")).alias("at_most"))
