"""Comparing results with recomputed truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import csvline


def duplicates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that occur more than once, with their multiplicity."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def reconcile(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(key, actual, expected, ok) of two (key, n) tables; null keys match each other."""
    a, e = actual.select(F.col("key").alias("_a"), F.col("n").alias("actual")), expected.select(F.col("key").alias("_e"), F.col("n").alias("expected"))
    # a full join needs a plain equality to be dealt out by key, hence the pair in place of <=>
    a, e = (d.withColumn("_k", F.coalesce(c, F.lit(""))).withColumn("_null", F.col(c).isNull()) for d, c in ((a, "_a"), (e, "_e")))
    out = a.join(e, ["_k", "_null"], "full")
    return out.select(F.when(~F.col("_null"), F.col("_k")).alias("key"), "actual", "expected", F.col("actual").eqNullSafe(F.col("expected")).alias("ok"))


def reconcile_totals(reconciled: DataFrame) -> DataFrame:
    """One row: totals of both sides, keys that differ, and whether all agree."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return reconciled.agg(total("actual").alias("actual"), total("expected").alias("expected"), F.count_if(~F.col("ok")).alias("wrong_keys"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("passed"))


def within_tolerance(actual: Column, expected: Column) -> Column:
    """Whether two row counts differ by at most 5 or expected / 200 (whole number), whichever is more."""
    return F.abs(actual - expected) <= F.greatest(F.lit(5), F.floor(expected / 200))


def row_count_check(actual: DataFrame, expected: DataFrame) -> DataFrame:
    a, e = actual.agg(F.count(F.lit(1)).alias("actual")), expected.agg(F.count(F.lit(1)).alias("expected"))
    both = a.withColumn("_", F.lit(0)).join(e.withColumn("_", F.lit(0)), "_").drop("_")
    return both.withColumn("passed", within_tolerance(F.col("actual"), F.col("expected")))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, as often as it lacks them, and the side that has them.

    Empty where both hold the same rows, in whatever order.
    """
    left, right = a.exceptAll(b), b.exceptAll(a)
    return left.withColumn("only_in", F.lit("first")).unionByName(right.withColumn("only_in", F.lit("second")))


def field_count_report(lines: DataFrame, expected: int = 3) -> DataFrame:
    """(fields, rows, ok): how many lines have how many RFC 4180 fields."""
    n = F.size(csvline.csv_fields("value", "rfc4180")).cast("long")
    return lines.groupBy(n.alias("fields")).agg(F.count(F.lit(1)).alias("rows")).withColumn("ok", F.col("fields") == expected)
