"""Text lines as (key, value, id) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

MAX_LINE_BYTES = 1 << 20


def trimmed(value: Column | str) -> Column:
    """Without leading and trailing white space of any kind (Spark's trim strips spaces only)."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of several locations of the same data that exists."""
    for p in paths:
        if _exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {paths} exists")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, path, line_no, value): every line, blank ones too, numbered from 1 in its file.

    Files are read in parallel blocks. Within a block, line k is the k-th row of the scan; a small
    table of rows per block gives each block's first number. No line is shuffled.
    """
    if isinstance(path, list):
        path = first_existing(spark, path)
    rows = spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    blocks = rows.groupBy("path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("path", "block", (before - F.col("first") + 1).alias("shift"))
    return rows.join(starts, ["path", "block"]).select("file", "path", (F.col("at") + F.col("shift")).alias("line_no"), "value")


def read_lines(spark: SparkSession, path: str | list[str], header: bool = False) -> DataFrame:
    """(key, value, id) of the non-blank lines, trimmed; key and id are 'file:line'.

    A list of paths stands for several places of the same data: the first that exists is read.
    ``header`` drops line 1 of each file.
    """
    lines = numbered_lines(spark, path)
    if header:
        lines = lines.where("line_no > 1")
    place = F.concat_ws(":", "file", F.col("line_no").cast("string"))
    return lines.select(place.alias("key"), trimmed("value").alias("value"), place.alias("id")).where("value <> ''")


def table_lines(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, value, id) rows from any table."""
    out = df.select(key.cast("string").alias("key"), trimmed(value).alias("value")).where("value <> ''")
    return out.select("key", "value", F.col("key").alias("id"))


def split_long(lines: DataFrame, max_line_bytes: int = MAX_LINE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lines up to the limit, rejected longer ones), to keep user patterns off unbounded lines."""
    fits = F.octet_length("value") <= max_line_bytes
    return lines.where(fits), lines.where(~fits)


def read_lines_stream(spark: SparkSession, path: str, id_from: Column | None = None, max_files: int | None = None, max_bytes: str | None = None) -> DataFrame:
    """Lines of files that arrive in a directory.

    A stream can't number lines, so ``id_from`` (an expression over value) supplies ids where rows
    carry one; without it id is null and exactly-once rests on the record of processed files.
    ``max_files`` or ``max_bytes`` pace the stream per micro-batch.
    """
    reader = spark.readStream.option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    rows = reader.text(path).select(trimmed("value").alias("value"), F.col("_metadata.file_name").alias("key")).where("value <> ''")
    return rows.select("key", "value", (id_from if id_from is not None else F.lit(None)).cast("string").alias("id"))


def multi_append(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """(client, key, value, id): the lines of one file per client, ready to be sequenced together."""
    out = None
    for client, path in sources.items():
        part = read_lines(spark, path).select(F.lit(client).alias("client"), "key", "value", F.concat_ws("/", F.lit(client), "id").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out
