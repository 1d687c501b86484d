"""Where lines go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def put_in_place(spark: SparkSession, made: str, path: str) -> None:
    """Rename a finished folder to ``path``, in place of what is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(made), jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    files.delete(target, True)
    if not files.rename(source, target):
        raise OSError(f"{made} could not be renamed to {path}")


def write_lines(df: DataFrame, path: str) -> None:
    """Values only, a line each, one file a task; what was there is replaced."""
    df.select("value").write.mode("overwrite").option("lineSep", "\n").text(path)


def output(df: DataFrame, path: str) -> bool:
    """write_lines, but nothing is written for an empty result; whether it wrote.

    Rows are counted as they are written, beside ``path``, so the input is computed once.
    """
    seen, made = Observation(), f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    write_lines(df.select("value").observe(seen, F.count(F.lit(1)).alias("n")), made)
    spark = df.sparkSession
    if seen.get["n"]:
        put_in_place(spark, made, path)
        return True
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return False


def append_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "text", every: str | None = None):
    """A started stream that appends to one destination; its commit log makes it exactly-once.

    ``every`` sets the micro-batch interval, such as '500 milliseconds'; without it, what is there
    is taken and the stream ends.
    """
    writer = (df.select("value") if fmt == "text" else df).writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start(path)


def console(df: DataFrame, rows: int = 20) -> None:
    """'output: <value>' lines on the console."""
    shown = df.selectExpr("concat('output: ', value) as value")
    if df.isStreaming:
        shown.writeStream.format("console").option("truncate", False).option("numRows", rows).trigger(availableNow=True).start().awaitTermination()
    else:
        shown.show(rows, truncate=False)


def save_report(df: DataFrame, path: str) -> None:
    """A small report as one text file."""
    df.select("value").coalesce(1).write.mode("overwrite").text(path)
