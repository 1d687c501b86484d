"""Counts, totals, summaries, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_by_key(lines: DataFrame) -> DataFrame:
    """(key, n)."""
    return lines.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def totals(counts: DataFrame, elapsed_sec: float | None = None) -> DataFrame:
    """One row: total of n, unique keys, and rows a second where the time is given."""
    out = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), F.count_distinct("key").alias("unique_keys"))
    if elapsed_sec is None:
        return out
    return out.withColumn("rows_per_sec", throughput(F.col("total"), F.lit(elapsed_sec)))


def throughput(rows: Column, elapsed_sec: Column) -> Column:
    """Rows a second, cut to two decimals; null for no elapsed time."""
    return F.floor(F.try_divide(rows.cast("double"), elapsed_sec) * 100) / 100


def bench_summary(runs: DataFrame, metric: str = "throughput_tuples_per_sec", by: str = "experiment", system: str = "system", systems: tuple[str, str] = ("first", "second")) -> DataFrame:
    """Per experiment: mean and sample deviation of each of two systems, and the one with more (ties: the second)."""
    stats = [x for k, s in enumerate(systems, 1) for x in (F.avg(F.when(F.col(system) == s, F.col(metric))).alias(f"mean_{k}"), F.stddev_samp(F.when(F.col(system) == s, F.col(metric))).alias(f"std_{k}"))]
    out = runs.where(F.col(system).isin(*systems)).groupBy(by).agg(*stats)
    return out.withColumn("winner", F.when(F.col("mean_1") > F.col("mean_2"), F.lit(systems[0])).when(F.col("mean_2").isNotNull(), F.lit(systems[1])).otherwise(F.lit(systems[0])))


def elapsed_summary(runs: DataFrame, by: tuple[str, ...] = ("experiment", "system"), metric: str = "elapsed_sec") -> DataFrame:
    return runs.groupBy(*by).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))


def skew_report(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows per hash bucket against a fair share; low: under half of it. Empty buckets show too."""
    found = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    buckets = rows.sparkSession.range(n).select(F.col("id").alias("bucket"))
    out = buckets.join(found, "bucket", "left").fillna({"rows": 0})
    share = F.sum("rows").over(Window.partitionBy(F.lit(0))) / n  # n rows
    return out.withColumn("fair_share", share).withColumn("low", F.col("rows") < 0.5 * F.col("fair_share"))


def top(counts: DataFrame) -> DataFrame:
    """Counts in descending order; equal counts by key."""
    return counts.orderBy(F.desc("n"), "key")


def top_k(counts: DataFrame, k: int = 10) -> DataFrame:
    """The k largest counts and, if there are more keys, one row '... and N more' (rank k + 1)."""
    first = counts.orderBy(F.desc("n"), "key").limit(k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "key")).cast("long"))  # k rows
    # asking for the sum too keeps this branch's shuffle equal to the other's, so that one serves both
    rest = counts.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("all")).where((F.col("keys") > k) & F.col("all").isNotNull())
    more = rest.select(F.lit(k + 1).cast("long").alias("rank"), F.concat(F.lit("... and "), (F.col("keys") - k).cast("string"), F.lit(" more")).alias("key"), F.lit(None).cast("long").alias("n"))
    return ranked.select("rank", "key", "n").unionByName(more)


def preview(rows: DataFrame, by: str, k: int, order: str = "line_no") -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= k).drop("_n")


def sample_first(rows: DataFrame, n: int, order: str = "line_no") -> DataFrame:
    return rows.orderBy(order).limit(n)
