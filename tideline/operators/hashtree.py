"""Comparing tables by a tree of digests, down only where they differ.

A row's hash says which bucket of each level it is in. A bucket's digest is a count, an exclusive or and
a sum of its rows' hashes, so rows need no order and none is gathered. The first level compares 2**bits
buckets of all rows; each further one looks at the rows of differing buckets alone, in 2**bits parts
each. Whole rows move for the buckets of the last level that differ, and for no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.streaming.run import working_dir

#: Bits of each level; differing buckets that are broadcast (16 bytes each).
LEVELS, FEW = (12, 12), 200_000


def _hash(columns: list[str], seed: int) -> Column:
    """A row's hash; nulls, which the function skips, count by where they are."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in columns], *[F.col(f"`{c}`").isNull() for c in columns])


def _bucket(columns: list[str], bits: int) -> Column:
    return F.shiftrightunsigned(_hash(columns, 1), 64 - bits)


def digests(rows: DataFrame, bits: int) -> DataFrame:
    """(bucket, n, mixed, total) of the buckets that hold rows."""
    one, two = _hash(rows.columns, 2), _hash(rows.columns, 3)
    return rows.groupBy(_bucket(rows.columns, bits).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(one).alias("mixed"), F.sum(two.cast("decimal(20,0)")).alias("total"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Buckets whose digests differ, or that one side lacks."""
    values = ["n", "mixed", "total"]
    both = a.select("bucket", *[F.col(v).alias(f"a_{v}") for v in values]).join(b, "bucket", "full")
    return both.where(~(F.col("a_n").eqNullSafe(F.col("n")) & F.col("a_mixed").eqNullSafe(F.col("mixed")) & F.col("a_total").eqNullSafe(F.col("total")))).select("bucket")


def _within(rows: DataFrame, bits: int, buckets: DataFrame, few: bool) -> DataFrame:
    """The rows of some buckets."""
    right = F.broadcast(buckets) if few else buckets
    return rows.withColumn("_bucket", _bucket(rows.columns, bits)).join(right.withColumnRenamed("bucket", "_bucket"), "_bucket", "left_semi").drop("_bucket")


def tree_difference(a: DataFrame, b: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Rows of either side that the other lacks, as often as it lacks them, and the side that has them.

    The result of ``same_rows`` for tables with the same columns. Starts a small job a level, which
    reads the tables and shuffles digests; where all agree nothing else is read.
    """
    spark, bits = a.sparkSession, 0
    b = b.select(*a.columns)
    for level in levels:
        bits += level
        found = differing(digests(a, bits), digests(b, bits))
        path = working_dir(spark, "buckets")
        found.write.parquet(path)
        found = spark.read.schema("bucket long").parquet(path)
        n = found.count()
        a, b = (_within(t, bits, found, n <= FEW) for t in (a, b))
        if not n:
            break
    left, right = a.exceptAll(b), b.exceptAll(a)
    return left.withColumn("only_in", F.lit("first")).unionByName(right.withColumn("only_in", F.lit("second")))


def replica_difference(blocks: DataFrame, first: str, second: str, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(file, client, seq, sha1, only_in) of blocks that one of two nodes lacks or holds with other content."""
    held = blocks.select("node", "file", "client", "seq", F.sha1(F.col("content").cast("binary")).alias("sha1"))
    return tree_difference(*(held.where(F.col("node") == n).drop("node") for n in (first, second)), levels)
