"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.streaming.run import working_dir

#: Rows that one task numbers, and rows of a group beyond which groups are dealt out by range.
MAX_GROUP = 1_000_000


def number_within(df: DataFrame, groups: list[str], order: list[str], name: str, max_group: int = MAX_GROUP) -> DataFrame:
    """df with ``name``: 1, 2, .. within each group, in the given order."""
    return total_within(df, groups, order, None, name, max_group).withColumn(name, (F.col(name) + 1).cast("int")).select(*df.columns, name)


def total_within(df: DataFrame, groups: list[str], order: list[str], size: str | None, name: str, max_group: int = MAX_GROUP) -> DataFrame:
    """df with ``name``: the sum of ``size`` (rows, if None) over the rows before it in its group.

    Where every group fits a task, that is a window. Where one doesn't, rows are dealt out by range of
    (group, order), about ``max_group`` rows of the table a task, so that a large group spans many
    tasks; each task sums its own rows, and the sums of the tasks before it, a small table, are added.
    One aggregate, over the group columns alone, tells which it is.
    """
    amount = F.lit(1) if size is None else F.col(size)
    rows, largest = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    so_far = lambda w: F.coalesce(F.sum(amount).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    if largest <= max_group:
        return df.withColumn(name, so_far(Window.partitionBy(*groups)))
    path = working_dir(df.sparkSession, "numbered")  # fixes which task holds which rows
    df.repartitionByRange(max(2, -(-rows // max_group)), *groups, *order).withColumn("_p", F.spark_partition_id()).write.parquet(path)
    fixed = df.sparkSession.read.parquet(path)
    sums = fixed.groupBy(*groups, "_p").agg(F.sum(amount).cast("long").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_before", before).where("_before > 0")  # the tasks that a group continues in
    keys = [*groups, "_p"]
    right = sums.select([F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)] + ["_before"])
    same = [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)]
    summed = fixed.withColumn("_k", so_far(Window.partitionBy(*groups, "_p"))).join(right, same, "left")
    return summed.select(*df.columns, (F.col("_k") + F.coalesce("_before", F.lit(0))).alias(name))
