"""Plans stay the ones that scale: what is shuffled, by what, and what reaches the scan."""

import re

from pyspark.sql import functions as F

from tideline.operators import appendlog, metrics, numbering, placement
from tideline.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"hashpartitioning\(([^)]*)\)", plan(df))


def test_files_are_not_shuffled_for_placement(spark):
    files = spark.range(100).select(F.concat(F.lit("f"), "id").alias("file"))
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(50)], "node string")
    placed = placement.place(files, nodes)
    assert "BroadcastHashJoin" in plan(placed) and not exchanges(placed)


def test_flow_windows_end_with_their_bucket(spark):
    events = spark.createDataFrame([("k", 1, 1)], "key string, at long, size long").withColumn("ts", F.timestamp_seconds("at"))
    assert all("_bucket" in x for x in exchanges(metrics.flow_rate(events))) and exchanges(metrics.flow_rate(events))


def test_flow_windows_are_running_sums(spark):
    """A frame that slides is summed anew for each row."""
    events = spark.createDataFrame([("k", 1, 1)], "key string, at long, size long").withColumn("ts", F.timestamp_seconds("at"))
    frames = re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]*),", plan(metrics.flow_rate(events)))
    assert len(frames) >= 2 and all("unboundedpreceding" in x for x in frames)


def test_copies_are_compared_without_gathering(spark):
    blocks = spark.createDataFrame([("f", "a", "c", 1, "x")], "file string, node string, client string, seq int, content string")
    text = plan(appendlog.divergent_files(blocks))
    assert "collect" not in text and "bit_xor" in text


def test_numbering_is_dealt_by_the_rows_of_the_table(spark):
    """One group of 60 rows in a table of 600: tasks for the table, not for the group."""
    rows = [("big", k) for k in range(60)] + [(f"g{k // 5}", k) for k in range(540)]
    df = spark.createDataFrame(rows, "g string, at long").repartition(3)
    numbered = numbering.number_within(df, ["g"], ["at"], "n", max_group=50)
    got = {(r.g, r["at"]): r.n for r in numbered.collect()}
    assert got == {(g, k): sum(g == h and j <= k for h, j in rows) for g, k in rows}
    folder = next(f.rsplit("/", 1)[0] for f in numbered.inputFiles() if "numbered-" in f)
    assert spark.read.parquet(folder).select("_p").distinct().count() > 6


def test_scans_read_what_a_query_needs(spark, sf_dir):
    text = plan(QUERIES["log_count"](spark, sf_dir))
    assert "ReadSchema: struct<text:string,source:string>" in text and "Python" not in text
    text = plan(QUERIES["field_count_report"](spark, sf_dir))
    assert "Python" not in text and text.count("Exchange") == 1
    assert "PushedFilters: [IsNotNull(event_id)" in plan(spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 2 = 1"))


def test_top_k_counts_once(spark, sf_dir):
    df = QUERIES["top_k_keys"](spark, sf_dir)
    df.collect()
    assert "ReusedExchange" in plan(df)
