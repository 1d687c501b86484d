import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideline.functions.ring import ring_id
from tideline.operators import appendlog, fleet, logs, metrics, placement

T0 = datetime(2025, 1, 1)


def at(sec):
    return T0 + timedelta(seconds=sec)


def test_stage_limits(spark):
    rows = [(job, f"t{k}", at(second), tuples, rate) for job, rate in (("j1", 30.0), ("j2", 2.0), ("j3", 8.0)) for k in range(3) for second in (1, 2) for tuples in (40, 100)]
    rows += [("j4", "t0", at(1), 49, 90.0), ("j5", "t0", at(1), 100, 1.0), ("j1", "idle", at(1), 500, 90.0)]
    tasks = [(job, t, 2, "running" if t != "idle" else "idle", at(0)) for job, t in {(r[0], r[1]) for r in rows}]
    got = metrics.scaling_decisions(
        spark.createDataFrame(rows, "job string, task_id string, ts timestamp, tuples_processed long, current_rate double"),
        spark.createDataFrame(tasks, "job string, task_id string, stage int, state string, started_at timestamp"), 5.0, 20.0
    )
    assert sorted((r.job, r.n, r.average, r.action) for r in got.collect()) == sorted([("j1", 3, 30.0, "up")] * 2 + [("j2", 3, 2.0, "down")] * 2)


def test_jobs_that_share_task_ids(spark):
    samples = spark.createDataFrame([("a", "t1", at(1), 5, 4.0), ("b", "t1", at(2), 7, 8.0)], "job string, task_id string, ts timestamp, tuples_processed long, current_rate double")
    tasks = spark.createDataFrame([("a", "t1", 1, "running", at(0)), ("b", "t1", 1, "running", at(0))], "job string, task_id string, stage int, state string, started_at timestamp")
    assert sorted(tuple(r) for r in metrics.stage_rollup(metrics.latest_metrics(samples), tasks).collect()) == [("a", 1, 1, 4.0, 5), ("b", 1, 1, 8.0, 7)]
    rates = metrics.task_rates(samples.withColumnRenamed("tuples_processed", "tuples"), tasks)
    assert sorted((r.job, r.total, r.average) for r in rates.collect()) == [("a", 5, 5.0), ("b", 7, 3.5)]
    events = spark.createDataFrame([("a", "t1", "grep", "running", "h", at(1), 1), ("b", "t1", "grep", "failed", "h", at(2), 1)], "job string, task_id string, op string, state string, host string, ts timestamp, seq int")
    assert sorted((r.job, r.state) for r in metrics.task_list(events).collect()) == [("a", "running"), ("b", "failed")]


def test_flow_over_many_buckets(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), at(rng.randrange(0, 20_000) / 1000), rng.randrange(100), k) for k in range(400)] + [("a", at(3), 7, 900), ("a", at(4), 8, 901), ("a", at(4), 8, 902)]
    got = {r.k: r.flow for r in metrics.flow_rate(spark.createDataFrame(rows, "key string, ts timestamp, size long, k long")).collect()}
    second = timedelta(seconds=1)
    assert got == {k: float(sum(s for key2, t2, s, _ in rows if key2 == key and t - second <= t2 <= t)) for key, t, _, k in rows}


def test_flow_without_times_and_sizes(spark):
    rows = [("k", None, 3, 1), ("k", None, 4, 2), ("k", at(1), None, 3), ("k", at(-0.5), 2, 4), ("k", at(0.5), 5, 5), ("m", at(0), None, 6)]
    got = {r.k: r.flow for r in metrics.flow_rate(spark.createDataFrame(rows, "key string, ts timestamp, size long, k long")).collect()}
    assert got == {1: 7.0, 2: 7.0, 3: 5.0, 4: 2.0, 5: 7.0, 6: None}  # rows without a time count once, for each other


def test_flow_and_latest(spark):
    ev = spark.createDataFrame([("k", at(0), 10), ("k", at(1), 20), ("k", at(2.5), 5)], "key string, ts timestamp, size long")
    assert [r.flow for r in metrics.flow_rate(ev).orderBy("ts").collect()] == [10.0, 30.0, 5.0]
    m = spark.createDataFrame([("j", "t", at(1), 5), ("j", "t", at(2), 7), ("j", "t", at(2), 9)], "job string, task_id string, ts timestamp, tuples_processed long")
    assert metrics.latest_metrics(m).first().tuples_processed == 7


def test_logs(spark):
    rows = [("n1", 1, k, x) for k, x in enumerate(["TASK START: job=a, task=t1, stage=2", "UPSCALE TRIGGERED stage=3 rate=7.5 rate=9", "nothing", "RUN END job=a"], 1)] + [("n2", 2, 1, "quiet")]
    df = spark.createDataFrame(rows, "host string, host_no int, line_no long, line string")
    got = {(r.host, r.line_no): (r.event, r.job, r.task, r.stage, r.rate) for r in logs.parse_events(df).collect()}
    assert got == {("n1", 1): ("TASK START", "a", "t1", 2, None), ("n1", 2): ("UPSCALE TRIGGERED", None, None, 3, 7.5), ("n1", 4): ("RUN END", "a", None, None, None)}
    hosts = spark.createDataFrame([("n1", 1, True), ("n2", 2, True), ("n3", 3, False)], "host string, host_no int, reachable boolean")
    report = logs.log_report(df, hosts, "task|run", first=1, ignore_case=True)
    assert [(r.host, r.matches, r.status) for r in report.collect()] == [("n1", 2, "ok"), ("n2", 0, "No matches"), ("n3", None, "unreachable")]
    assert tuple(logs.report_totals(report).first()) == (2, 2)
    assert [tuple(r) for r in logs.log_search(df, "t", count_only=True, max_count=2).orderBy("host").collect()] == [("n1", 2), ("n2", 1)]


def test_placement_moves_little(spark):
    files = spark.range(1000).select(F.concat(F.lit("key-"), "id").alias("file"))
    nodes = spark.createDataFrame([(f"node-{k}", k != 9) for k in range(10)], "node string, alive boolean")
    ten = nodes.withColumn("alive", F.lit(True))
    placed = placement.place(files, ten)
    assert placed.count() == 3000 and placed.groupBy("file").agg(F.count_distinct("node").alias("n")).where("n <> 3").count() == 0
    ring = sorted((r.h, r.node) for r in ten.select(ring_id("node").alias("h"), "node").collect())
    for r in files.select("file", ring_id("file").alias("h")).limit(50).collect():
        order = [n for h, n in ring if h >= r.h] + [n for h, n in ring if h < r.h]
        assert [x.node for x in placed.where(F.col("file") == r.file).orderBy("rank").collect()] == order[:3] if r.file in ("key-1", "key-7") else True
    diff = placement.placement_diff(files, ten, nodes)
    moved = placement.moved_files(diff).first()
    assert moved.added == moved.removed and 100 < moved.files < 500
    assert placement.place(files, nodes.limit(2)).count() == 2000 and placement.place(files, nodes.limit(0)).count() == 0
    due = placed.select("file", "node")
    assert placement.repair_plan(due, due).count() == 0


@pytest.mark.parametrize("n_nodes, algo", [(1, "sha256"), (2, "sha1"), (70, "sha256"), (3000, "sha1")])
def test_placement_equals_a_scan_of_the_ring(spark, n_nodes, algo):
    import hashlib

    h = lambda x: hashlib.new(algo, x.encode()).hexdigest()[:16]
    nodes = [f"node-{k}" for k in range(n_nodes)]
    ring = sorted((h(x), x) for x in nodes)
    got = {}
    placed = placement.place(spark.range(500).select(F.concat(F.lit("key-"), "id").alias("file")), spark.createDataFrame([(x,) for x in nodes], "node string"), algo=algo)
    for r in placed.collect():
        got.setdefault(r.file, {})[r["rank"]] = r.node
    for k in range(500):
        file = f"key-{k}"
        order = [x for p, x in ring if p >= h(file)] + [x for p, x in ring if p < h(file)]
        assert [got[file][i] for i in sorted(got[file])] == order[:3]


def test_append_log(spark):
    arrived = [("f", "B", 1, "b1"), ("f", "A", 2, "a1"), ("f", "B", 3, "b2"), ("f", "A", 4, "a2"), ("g", "A", 5, "x")]
    seq = appendlog.sequence_appends(spark.createDataFrame(arrived, "file string, client string, at int, content string"), "at")
    assert {(r.client, r.at): (r.seq, r.block) for r in seq.where("file = 'f'").collect()} == {("B", 1): (1, 1), ("A", 2): (1, 2), ("B", 3): (2, 3), ("A", 4): (2, 4)}
    blocks = [("f", "B", 2, "b2", "n1"), ("f", "A", 2, "a2", "n1"), ("f", "B", 1, "b1", "n2"), ("f", "A", 1, "a1", "n2"), ("f", "A", 3, "a3", "n1"), ("f", "A", 1, "a1", "n1"), ("f", "A", 3, "other", "n2")]
    df = spark.createDataFrame(blocks, "file string, client string, seq int, content string, node string")
    merged = appendlog.merge_replicas(df).orderBy("block").collect()
    assert [(r.block, r.client, r.seq) for r in merged] == [(1, "A", 1), (2, "A", 2), (3, "A", 3), (4, "B", 1), (5, "B", 2)]
    assert [r.conflict for r in merged] == [False, False, True, False, False] and merged[0].copies == 2
    assert appendlog.assemble(appendlog.merge_replicas(df.where("content <> 'other'"))).first().content == "a1a2a3b1b2"
    assert appendlog.replica_copy(df, "n2").first().content == "a1otherb1"
    assert [tuple(r) for r in appendlog.divergent_files(df).collect()] == [("f", 2)]
    assert appendlog.client_progress(df).first().clients == {"A": 3, "B": 2}
    assert appendlog.corrupt_blocks(appendlog.checksum(df).withColumn("content", F.when(F.col("seq") == 2, "!").otherwise(F.col("content")))).count() == 2
    assert {(r.node, r.file): (r.blocks, r.bytes) for r in appendlog.inventory(df).collect()} == {("n1", "f"): (4, 8), ("n2", "f"): (3, 9)}


def test_large_files_are_numbered_by_range(spark):
    rows = [("big" if k % 10 else None, "AB"[k % 2], k, f"c{k}") for k in range(500)]
    df = spark.createDataFrame(rows, "file string, client string, at int, content string")
    plain, dealt = (sorted(map(str, appendlog.sequence_appends(df, "at", m).collect())) for m in (10_000, 20))
    assert plain == dealt
    blocks = df.withColumnRenamed("at", "seq")
    plain, dealt = (sorted(map(str, appendlog.merge_replicas(blocks, m).collect())) for m in (10_000, 20))
    assert plain == dealt


def test_large_files_come_in_parts(spark):
    rows = [("big", k, f"<{k}>") for k in range(500)] + [("small", 1, "x"), ("small", 2, None), (None, 1, "y")]
    df = spark.createDataFrame(rows, "file string, block int, content string")
    for max_group in (10_000, 60):
        got = sorted(appendlog.assemble(df, 100, max_group).collect(), key=str)
        assert "".join(r.content for r in sorted((r for r in got if r.file == "big"), key=lambda r: r.part)) == "".join(r[2] for r in rows[:500])
        assert all(len(r.content) < 106 for r in got) and len(got) > 15
        assert [(r.part, r.content) for r in got if r.file == "small"] == [(0, "x")]
    assert {r.content for r in appendlog.assemble(df).collect()} == {"".join(r[2] for r in rows[:500]), "x", "y"}


def test_write_file_in_order(spark, tmp_path):
    rows = [("f", k, f"line {k}") for k in range(500)]
    appendlog.write_file(spark.createDataFrame(rows, "file string, block int, content string"), "f", str(tmp_path / "f"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "f").glob("part-*")))
    assert text.splitlines() == [r[2] for r in rows]


MEMBER = "id string, host string, port int, version long, ts timestamp, counter long, state string"


def member(i, counter, state, host="h", port=1):
    return (i, host, port, 1, at(0), counter, state)


def test_merge_members(spark):
    current = [member("same", 5, "Alive"), member("fail", 5, "Alive"), member("newer", 5, "Alive"), member("older", 5, "Alive"), member("revive", 5, "Failed"), member("dead", 5, "Failed"), member("alone", 1, "Suspected")]
    incoming = [member("same", 5, "Suspected"), member("fail", 1, "Failed"), member("newer", 6, "Suspected"), member("older", 4, "Suspected"), member("revive", 6, "Alive"), member("dead", 5, "Alive"), member("join", 1, "Alive"), member("gone", 9, "Failed"), member("bad", 9, "Alive", port=0), member("bad2", 9, "Alive", host="")]
    got = {r.id: (r.counter, r.state) for r in fleet.merge_members(spark.createDataFrame(current, MEMBER), spark.createDataFrame(incoming, MEMBER)).collect()}
    assert got == {"same": (5, "Alive"), "fail": (1, "Failed"), "newer": (6, "Suspected"), "older": (5, "Alive"), "revive": (6, "Alive"), "dead": (5, "Failed"), "alone": (1, "Suspected"), "join": (1, "Alive")}


def test_liveness_limits_are_strict(spark):
    beats = spark.createDataFrame([(str(age), at(100 - age)) for age in (0, 2, 2.5, 7, 7.5)] + [("late", at(101))], "id string, ts timestamp")
    now = F.lit(at(100))
    got = {r.id: r.state for r in fleet.liveness(beats, now, t_fail=5, t_suspect=2).collect()}
    assert got == {"0": "Alive", "2": "Alive", "2.5": "Suspected", "7": "Suspected", "7.5": "Failed"}
    assert {r.id: r.state for r in fleet.liveness(beats, now, t_fail=7).collect()}["7"] == "Alive"
    members = spark.createDataFrame([("a", "h", 1, 1, at(70), 1, "Failed"), ("b", "h", 1, 2, at(69), 1, "Failed"), ("c", "h", 2, 1, at(0), 1, "Suspected")], MEMBER)
    assert sorted(r.id for r in fleet.purge_failed(members, now).collect()) == ["a", "c"]
    assert sorted(r.id for r in fleet.latest_incarnation(members).collect()) == ["b", "c"]
    after = {r.id: r.counter for r in fleet.apply_heartbeats(members, spark.createDataFrame([("a", at(1)), ("c", at(1)), ("c", at(2)), ("zz", at(2))], "id string, ts timestamp")).collect()}
    assert after == {"a": 1, "b": 1, "c": 3}
    assert [r.id for r in fleet.members_by_host(members).collect()] == ["c"] and fleet.members_by_ring(members).count() == 0


def test_timeline_and_tasks(spark):
    ev = spark.createDataFrame([("j", "t1", "start", at(0)), ("j", "t1", "end", at(5)), ("j", "t1", "end", at(6)), ("j", "t2", "start", at(1)), ("j", "t2", "restart", at(2)), ("j", "t2", "restart", at(3))], "job string, task_id string, event string, ts timestamp")
    r = metrics.job_timeline(ev).first()
    assert (r.expected, r.completed, r.restarts, r.status, r.duration_us) == (2, 1, 2, "running", None)
    done = metrics.job_timeline(ev.union(spark.createDataFrame([("j", "t2", "end", at(9))], ev.schema))).first()
    assert (done.status, done.duration_us) == ("completed", 9_000_000)
