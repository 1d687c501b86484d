"""Operators on (key, value, id) lines. Each returns a function DataFrame -> DataFrame.

The functions work on batch and streaming frames alike, and are what ``plans.Pipeline`` chains.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import csvline, patterns

Op = Callable[[DataFrame], DataFrame]


def identity() -> Op:
    return lambda lines: lines.select("*")


def echo() -> Op:
    return lambda lines: lines.withColumn("value", F.concat("value", F.lit(" processed")))


def grep(pattern: str, column: int = 0) -> Op:
    """Lines that match anywhere; with column > 0 the key becomes that CSV field ('' if missing)."""
    pattern = patterns.linear_pattern(pattern)

    def run(lines: DataFrame) -> DataFrame:
        kept = lines.where(F.col("value").rlike(patterns.checked(lines.sparkSession, pattern)))
        return key_by(column)(kept) if column > 0 else kept

    return run


def contains(pattern: str) -> Op:
    """Lines that contain a plain string."""
    return lambda lines: lines.where(F.col("value").contains(pattern))


def key_by(n: int, base: int = 1, dialect: str = "toggle") -> Op:
    """The key becomes the n-th CSV field, counted from ``base``."""
    return lambda lines: lines.withColumn("key", csvline.field("value", n, base, dialect))


def transform(n: int = 3, dialect: str = "toggle") -> Op:
    """The value becomes its first n CSV fields."""
    return lambda lines: lines.withColumn("value", csvline.first_fields("value", n, dialect))


def count() -> Op:
    """One row a key, 'KEY,COUNT', id 'count-KEY'; on a stream this is a running count."""

    def run(lines: DataFrame) -> DataFrame:
        n = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        return n.select("key", csvline.format_count("key", "n").alias("value"), F.concat(F.lit("count-"), "key").alias("id"), "n")

    return run


def dedup(within: str | None = None, time: str = "ts", order: str | list[str] | None = None) -> Op:
    """One row of each id; rows without an id are all kept.

    On a table ``order`` names the columns whose smallest values come first, and the first row of an
    id stays (of equal ones the smallest by all columns); without it any of them does. On a stream the
    row that arrives first stays. The ids seen are state that grows without bound, unless ``within``
    (such as '1 hour') bounds how late a repeat can come, by the timestamp column ``time``.
    """
    by = [order] if isinstance(order, str) else list(order or [])

    def run(lines: DataFrame) -> DataFrame:
        if lines.isStreaming:
            if within:
                lines = lines.withWatermark(time, within)
            known, anonymous = lines.where("id is not null"), lines.where("id is null")
            known = known.dropDuplicatesWithinWatermark(["id"]) if within else known.dropDuplicates(["id"])
            return known.unionByName(anonymous)
        # rows without an id are each a group of their own, in the same pass
        lines, names = lines.withColumn("_own", F.when(F.col("id").isNull(), F.monotonically_increasing_id())), lines.columns
        if not by:
            return lines.dropDuplicates(["id", "_own"]).drop("_own")
        row = F.struct(*by, *[c for c in names if c not in by])
        return lines.groupBy("id", "_own").agg(F.min(row).alias("_row")).select([F.col(f"_row.{c}").alias(c) for c in names])

    return run


def repartition(n: int, key: str = "key") -> Op:
    """Rows of a key together, for Python operators with state; SQL aggregates need none."""
    return lambda lines: lines.repartition(n, key)
