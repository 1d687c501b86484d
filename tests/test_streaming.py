import json
import time

from pyspark.sql import functions as F

from tideline.operators import lines
from tideline.plans.pipeline import Pipeline
import pytest

from tideline.operators import appendlog
from tideline.sources.lines import read_lines_stream
from tideline.sources.sinks import append_stream
from tideline.sources.snapshots import Snapshots, read_snapshot
from tideline.streaming import expiring, ranges
from tideline.streaming import run as streams
from tideline.streaming.sequence import run_sequenced, sequence_batch


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(f"{r}\n" for r in rows))


def test_counts_survive_a_restart(spark, tmp_path):
    src, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    put(src, "a.txt", ["1,x", "2,y", "3,x"])

    def run():
        stream = lines.key_by(2)(read_lines_stream(spark, str(src)))
        streams.run_counts(streams.running_count(stream), out, check)
        return {r.key: r.n for r in read_snapshot(spark, out).collect()}

    assert run() == {"x": 2, "y": 1}
    put(src, "b.txt", ["4,x", "5,z"])
    assert run() == {"x": 3, "y": 1, "z": 1}
    assert run() == {"x": 3, "y": 1, "z": 1}  # nothing new: the table stays


def test_exactly_once_over_a_restart_and_a_clean_start(spark, tmp_path):
    src = tmp_path / "in"
    put(src, "a.txt", ["1,x", "2,y", "2,y"])
    own = F.regexp_extract("value", r"^(\d+)", 1)

    def run(job, delivery="exactly_once"):
        out = str(tmp_path / f"out-{job}")
        streams.run_stream(read_lines_stream(spark, str(src), own), out, str(tmp_path / f"check-{job}"), delivery)
        return sorted(r.id for r in spark.read.parquet(out).collect())

    assert run("one") == ["1", "2"]
    put(src, "b.txt", ["2,again", "3,z"])
    assert run("one") == ["1", "2", "3"]
    assert run("two") == ["1", "2", "3"]
    assert run("three", "at_least_once") == ["1", "2", "2", "2", "3"]


def test_update_mode_and_append_sink(spark, tmp_path):
    src = tmp_path / "in"
    put(src, "a.txt", ["1,x", "2,x"])
    put(src, "b.txt", ["3,x"])
    stream = lines.key_by(2)(read_lines_stream(spark, str(src), max_files=1))
    streams.run_counts(streams.running_count(stream), str(tmp_path / "o"), str(tmp_path / "c"), "update")
    rows = read_snapshot(spark, str(tmp_path / "o")).orderBy("batch").collect()
    assert len(rows) == 2 and rows[-1].n == 3
    append_stream(read_lines_stream(spark, str(src)), str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.text(str(tmp_path / "o2")).count() == 3


def test_pipeline_is_the_same_for_streams(spark, tmp_path):
    src = tmp_path / "in"
    put(src, "a.txt", [f"{k},{'ab'[k % 2]},c,d" for k in range(20)])
    stages = [("grep", ["a"]), ("transform", [2]), ("echo", {})]
    stream = Pipeline(lambda s: read_lines_stream(s, str(src)), stages).frame(spark)
    streams.run_stream(stream.select("value"), str(tmp_path / "o"), str(tmp_path / "c"), "at_least_once")
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "o")).collect()) == sorted(f"{k},a processed" for k in range(0, 20, 2))


@pytest.fixture
def saved(spark, tmp_path):
    rows = spark.createDataFrame([(str(k), f"line {k}", f"{k:03d}") for k in range(100)], "key string, value string, id string").repartition(5)
    assert ranges.save_ranges(rows, "id", str(tmp_path / "saved"), rows_a_file=16) == 100
    return str(tmp_path / "saved")


def test_paced_takes_whole_rows_per_task(spark, saved, tmp_path):
    stream, trigger = ranges.paced(spark, saved, 100, str(tmp_path / "c"), tasks=3, seconds=0.1)
    done = ranges.run_to_end(stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(**trigger))
    assert trigger == {"processingTime": "100 milliseconds"}
    assert [p["numInputRows"] for p in done if p["numInputRows"]] == [9] * 11 + [1]
    with pytest.raises(ValueError):
        ranges.paced(spark, saved, 2, str(tmp_path / "c"), tasks=3)


def test_twenty_batches_read_each_row_once_and_a_restart_goes_on(spark, saved, tmp_path):
    check, seen = str(tmp_path / "c"), []
    keep = lambda rows, n: seen.append((n, [r["id"] for r in rows.collect()]))

    def writer():
        return ranges.range_stream(spark, saved, 5, check, tasks=2).writeStream.foreachBatch(keep).option("checkpointLocation", check)

    query = writer().start()
    for _ in range(200):
        if len(seen) >= 7:
            break
        time.sleep(0.05)
    query.stop()
    first = len(seen)
    assert 7 <= first < 20
    done = ranges.run_to_end(writer())
    by_batch = dict(seen)  # a batch that was stopped midway comes again with the same rows
    assert [x for n in sorted(by_batch) for x in by_batch[n]] == [f"{k:03d}" for k in range(100)]
    assert sorted(by_batch) == list(range(20)) and {len(x) for x in by_batch.values()} == {5}
    assert max(p["numInputRows"] for p in done) == 5
    assert json.loads((tmp_path / "c-source" / "progress").read_text())["at"] in (95, 100)  # the last batch is committed with the next
    other = ranges.run_to_end(ranges.range_stream(spark, saved, 50, str(tmp_path / "c2")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c2")))
    assert sum(p["numInputRows"] for p in other) == 100  # a new job begins at the beginning


def test_ids_expire_and_a_restart_remembers(spark, tmp_path):
    def run(rows, seconds):
        src, out, check = (str(tmp_path / f"{x}-{seconds}") for x in ("in", "o", "c"))
        spark.createDataFrame(rows, "value string, id string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("value string, id string").parquet(src)
        held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in expiring.run_expiring(stream, out, check, seconds)]
        return sorted(r["value"] for r in spark.read.parquet(out).collect()), held

    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    assert run([("a", "1"), ("b", "1"), ("x", None), ("x", None)], 3600)[0][-2:] == ["x", "x"]
    got, held = run([("c", "1"), ("d", "2"), ("x", None)], 3600)  # another query on the checkpoint: 1 is known
    assert got in (["a", "d", "x", "x", "x"], ["b", "d", "x", "x", "x"]) and max(held) >= 2
    _, many = run([(f"m{k}", f"m{k}") for k in range(40)], 1)
    time.sleep(1.1)
    got, _ = run([("again", "m1")], 1)  # m1 has expired
    assert "again" in got and len(got) == 41
    time.sleep(1.1)
    _, few = run([("end", "9")], 1)
    assert max(many) >= 40 and few[-1] < 20
    assert spark.conf.get(store, None) == before


def test_expiring_groups_are_buckets_of_ids(spark, tmp_path):
    """Groups and entries of state grow with buckets and batches, not with ids, and no id is lost or doubled."""
    src, schema = str(tmp_path / "in"), "value string, n long, id string"
    rows = spark.range(3000).selectExpr("'a' as value", "if(id % 3 = 0, null, id) as n", "if(id % 10 = 0, null, cast(id as string)) as id")
    held = []
    for k in range(3):  # the same rows again and again
        rows.coalesce(1).write.mode("append").parquet(src)
        first = expiring.dedup_expiring(spark.readStream.schema(schema).parquet(src), 3600, buckets=16)
        assert first.columns == ["value", "n", "id"]
        conf = {x: spark.conf.get(x, None) for x in expiring.SETTINGS}
        for x, v in expiring.SETTINGS.items():
            spark.conf.set(x, v)
        query = first.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        for x, v in conf.items():
            spark.conf.set(x, v) if v is not None else spark.conf.unset(x)
        query.awaitTermination()
        held += [o["numRowsTotal"] for p in query.recentProgress for o in json.loads(p.json)["stateOperators"]]
    got = spark.read.parquet(str(tmp_path / "o"))
    want = rows.where("id is not null").union(rows.where("id is null")).union(rows.where("id is null")).union(rows.where("id is null"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert 16 <= max(held) < 1000


def test_sequences_over_batches_equal_the_table(spark, tmp_path):
    schema, out, src = "file string, client string, at long, text string", str(tmp_path / "o"), str(tmp_path / "a")
    hot = [("hot", f"c{k % 3}", k, "x") for k in range(60)] + [("f", "A", k, "y") for k in range(60, 64)] + [("g", "B", 64, "z")]
    made = []
    for some in (hot[:20], hot[20:50], hot[50:]):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(src)
        run_sequenced(spark.readStream.schema(schema).parquet(src), "at", out, str(tmp_path / "c"), max_group=7)  # several tasks a file
        made.append(read_snapshot(spark, out).count())
    assert made == [20, 50, 65]
    want = sorted(map(tuple, appendlog.sequence_appends(spark.createDataFrame(hot, schema), "at").collect()))
    assert sorted(map(tuple, read_snapshot(spark, out).collect())) == want
    again = spark.createDataFrame(hot[50:], schema)
    assert not sequence_batch(again, "at", out, 2)  # a batch that comes again
    assert sorted(map(tuple, read_snapshot(spark, out).collect())) == want
    assert Snapshots(spark, out).batches() == [0, 1, 2]


def test_rows_without_ids_stay(spark, tmp_path):
    src = tmp_path / "in"
    put(src, "a.txt", ["x", "y", "x"])
    streams.run_stream(read_lines_stream(spark, str(src)), str(tmp_path / "o"), str(tmp_path / "c"), "exactly_once")
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["x", "x", "y"]
    some = F.nullif(F.regexp_extract("value", r"^(\d+)", 1), F.lit(""))
    put(src, "b.txt", ["1,a", "1,a", "no id", "no id"])
    streams.run_stream(read_lines_stream(spark, str(src), some), str(tmp_path / "o2"), str(tmp_path / "c2"), "exactly_once")
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "o2")).collect()) == ["1,a", "no id", "no id", "x", "x", "y"]


def test_repeats_within_a_bound(spark, tmp_path):
    src = tmp_path / "in"
    schema = "key string, value string, id string, ts timestamp"
    rows = [("k", "a", "1", "2025-01-01 10:00:00"), ("k", "b", "1", "2025-01-01 10:00:05"), ("k", "c", None, "2025-01-01 10:00:06"), ("k", "d", None, "2025-01-01 10:00:06")]
    spark.createDataFrame(rows, "key string, value string, id string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(src))
    streams.run_stream(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "o"), str(tmp_path / "c"), "exactly_once", within="1 minute")
    got = [r.value for r in spark.read.parquet(str(tmp_path / "o")).collect()]
    assert sorted(got)[-2:] == ["c", "d"] and len(got) == 3


def test_liveness_stream_reports_changes(spark, tmp_path):
    beats = tmp_path / "b"
    spark.createDataFrame([("a", 1), ("b", 1)], "id string, n int").selectExpr("id", "current_timestamp() as ts").coalesce(1).write.parquet(str(beats))
    stream = streams.liveness_stream(spark.readStream.schema("id string, ts timestamp").parquet(str(beats)), t_fail=1.0)
    query = stream.writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if spark.table("live").where("state = 'Failed'").count() >= 2:
                break
    finally:
        query.stop()
    got = sorted((r.id, r.state) for r in spark.table("live").collect())
    assert got == [("a", "Alive"), ("a", "Failed"), ("b", "Alive"), ("b", "Failed")]
