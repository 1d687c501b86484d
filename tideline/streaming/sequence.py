"""Appends of a stream, numbered across its batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.numbering import MAX_GROUP, number_within
from tideline.sources.snapshots import Snapshots


def sequence_batch(appends: DataFrame, order: str, path: str, batch: int, max_group: int = MAX_GROUP) -> bool:
    """Number appends(file, client, .., order) after those of earlier batches, into ``Snapshots`` at ``path``.

    ``rows`` gets seq (per file and client) and block (per file); ``clients`` and ``files`` keep the last
    of each, and all are committed together with the batch, so one that comes again changes nothing.
    A batch's rows are numbered as a table's are: a file with most of them is many tasks.
    """
    spark = appends.sparkSession
    log = Snapshots(spark, path)
    version = log.version()
    if version and version["batch"] >= batch:
        return False
    rows = number_within(number_within(appends, ["file", "client"], [order], "_seq", max_group), ["file"], [order, "client"], "_block", max_group)
    clients, files = log.read("clients", version), log.read("files", version)
    none = F.lit(0).cast("long")
    if version:
        rows = rows.join(clients.withColumnRenamed("seq", "_s"), ["file", "client"], "left").join(files.withColumnRenamed("block", "_b"), "file", "left")
    else:
        rows = rows.withColumns({"_s": none, "_b": none})
    rows = rows.select(*appends.columns, (F.col("_seq") + F.coalesce("_s", none)).alias("seq"), (F.col("_block") + F.coalesce("_b", none)).alias("block"))
    written = log.written(batch, "rows", rows)
    last = written.groupBy("file", "client").agg(F.max("seq").alias("seq"), F.max("block").alias("block"))  # two counters from one pass over the keys
    new_clients = last.select("file", "client", "seq")
    new_files = last.select("file", "block")
    if version:
        new_clients, new_files = clients.union(new_clients), files.union(new_files)
    return log.commit(
        batch,
        replace={"clients": new_clients.groupBy("file", "client").agg(F.max("seq").alias("seq")), "files": new_files.groupBy("file").agg(F.max("block").alias("block"))},
        append={"rows": written},
    )


def run_sequenced(appends: DataFrame, order: str, path: str, checkpoint: str, max_group: int = MAX_GROUP) -> None:
    """Number what a stream of appends has now, in batches, and end; read it by ``read_snapshot(spark, path)``."""
    step = lambda rows, batch: sequence_batch(rows, order, path, batch, max_group)
    appends.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
