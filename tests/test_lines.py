import pytest

from tideline.functions import csvline
from tideline.operators import aggregate, lines, reconcile
from tideline.plans import pipeline
from tideline.plans.pipeline import Pipeline
from tideline.sources import lines as sources
from tideline.sources import records, sinks


@pytest.fixture
def folder(tmp_path):
    texts = {"a.txt": "one\n\n  two\t\nthree", "b.txt": "".join(f"line {k}\n" if k % 5 else "\n" for k in range(3000)), "c.txt": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    return tmp_path, texts


def expected(texts):
    return sorted((f"{name}:{k}", line.strip()) for name, text in texts.items() for k, line in enumerate(text.split("\n"), 1) if line.strip())


def test_line_numbers_over_blocks(spark, folder):
    path, texts = folder
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        rows = sources.read_lines(spark, str(path))
        assert rows.rdd.getNumPartitions() > 4
        assert sorted((r.key, r.value) for r in rows.collect()) == expected(texts)
        assert all(r.id == r.key for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_places_and_header(spark, folder):
    path, texts = folder
    rows = sources.read_lines(spark, [str(path / "missing.txt"), str(path / "a.txt")], header=True)
    assert sorted((r.key, r.value) for r in rows.collect()) == [("a.txt:3", "two"), ("a.txt:4", "three")]
    with pytest.raises(FileNotFoundError):
        sources.read_lines(spark, [str(path / "missing.txt")])


def test_long_lines_are_set_aside(spark):
    rows = spark.createDataFrame([("k", "x" * 100, "i"), ("k", "é" * 60, "j"), ("k", "y", "l")], "key string, value string, id string")
    ok, rejected = sources.split_long(rows, 100)
    assert [r.id for r in ok.collect()] == ["i", "l"] and [r.id for r in rejected.collect()] == ["j"]


def test_multi_append(spark, folder):
    path, _ = folder
    rows = sources.multi_append(spark, {"c1": str(path / "a.txt"), "c2": str(path / "a.txt")})
    assert rows.count() == 6 and rows.select("id").distinct().count() == 6


def test_generated_signs(spark):
    rows = records.generate_signs(spark, 2000, seed=3)
    fields = [r.f for r in rows.select(csvline.csv_fields("value").alias("f")).collect()]
    assert {len(f) for f in fields} == {22}
    assert all(f[0].replace(",", "").isdigit() and len(f[0]) == 7 for f in fields)
    kinds = {k: {f[7] for f in fields if f[6] == k} for k in records.SIGN_TYPES}
    assert kinds["SIGN_POLE"] == {""} and len(kinds["SIGN_REGULATORY"]) == 16 and len(kinds["SIGN_GUIDE"]) == 7 and len(kinds["SIGN_WARNING"]) == 8
    assert all(set(records.STOP_MESSAGES) & m == (set(records.STOP_MESSAGES) if k == "SIGN_REGULATORY" else set()) for k, m in kinds.items())
    assert all(f[4] == ("Street Name" if f[6] == "SIGN_GUIDE" else f[7]) for f in fields)
    assert 0.2 < lines.grep("SIGN_REGULATORY")(rows).count() / 2000 < 0.3
    assert rows.collect() == records.generate_signs(spark, 2000, seed=3).collect()


def test_first_of_each_id_stays(spark):
    rows = [("k", "late", "1", 5), ("k", "early", "1", 2), ("k", "b", "2", 3), ("k", "a", "2", 3), ("k", "x", None, 1), ("k", "x", None, 1)]
    df = spark.createDataFrame(rows, "key string, value string, id string, at int")
    got = sorted((r.id or "", r.value) for r in lines.dedup(order="at")(df).collect())
    assert got == [("", "x"), ("", "x"), ("1", "early"), ("2", "a")]
    assert lines.dedup(order="at")(df).columns == df.columns and lines.dedup()(df).count() == 4
    job = Pipeline(lambda s: df, [("identity", {})], delivery="exactly_once", order="at")
    assert sorted(r.value for r in job.run(spark).collect()) == ["a", "early", "x", "x"]


def test_logs_and_results(spark, tmp_path):
    for name, text in {"node2_20250101_100000.log": "old\n", "node2_20250102_100000.log": "x\ny\n", "node10_20250101_000000.log": "z\n", "other.txt": "no\n"}.items():
        (tmp_path / name).write_text(text)
    got = sorted((r.host_no, r.line_no, r.line) for r in records.read_logs(spark, str(tmp_path)).collect())
    assert got == [(2, 1, "x"), (2, 2, "y"), (10, 1, "z")]
    runs = tmp_path / "runs"
    runs.mkdir()
    (runs / "exp1_first_Small_5K_FilterCount.csv").write_text("run,elapsed_sec,input_tuples,output_lines,throughput_tuples_per_sec\n1,2.5,100,3,40.0\n2,2.0,100,3,50.0\n")
    (runs / "exp1_second_Small_5K_FilterCount.csv").write_text("run,elapsed_sec,input_tuples,output_lines,throughput_tuples_per_sec\n1,2.0,100,3,45.0\n")
    found = records.read_results(spark, str(runs))
    assert {(r.experiment, r.system, r.dataset, r.app) for r in found.collect()} == {(1, "first", "Small_5K", "FilterCount"), (1, "second", "Small_5K", "FilterCount")}
    s = aggregate.bench_summary(found).first()
    assert (s.mean_1, s.mean_2, s.std_2, s.winner) == (45.0, 45.0, None, "second")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("k", "v1", "1"), ("k", "v2", "2")], "key string, value string, id string")
    out = str(tmp_path / "out")
    sinks.write_lines(rows, out)
    sinks.write_lines(rows, out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["v1", "v2"]
    assert sinks.output(rows, str(tmp_path / "o2")) and not sinks.output(rows.limit(0), str(tmp_path / "o3"))
    assert (tmp_path / "o2").exists() and not (tmp_path / "o3").exists() and not list(tmp_path.glob("o3.*"))
    assert not sinks.output(rows.limit(0), str(tmp_path / "o2")) and spark.read.text(str(tmp_path / "o2")).count() == 2
    assert sinks.output(rows.limit(1), str(tmp_path / "o2")) and spark.read.text(str(tmp_path / "o2")).count() == 1
    sinks.save_report(rows, str(tmp_path / "report"))
    assert len(list((tmp_path / "report").glob("part-*"))) == 1
    sinks.console(rows)


GREP = [("l1", "1,Punched Telespar,Sign A"), ("l2", "2,Unpunched Pole,Sign B"), ("l3", "3,Punched Again,Sign C")]


def test_pipeline(spark):
    source = lambda s: s.createDataFrame([(k, v, k) for k, v in GREP], "key string, value string, id string")
    assert [r.key for r in Pipeline(source, [("grep", ["Punched"])]).run(spark).collect()] == ["l1", "l3"]
    keyed = Pipeline(source, [("filter", {"pattern": "Punched", "column": 2}), ("count", {})]).run(spark)
    assert sorted((r.key, r.value, r.id) for r in keyed.collect()) == [("Punched Again", "Punched Again,1", "count-Punched Again"), ("Punched Telespar", "Punched Telespar,1", "count-Punched Telespar")]
    twice = Pipeline(lambda s: source(s).union(source(s)), [("identity", {})], delivery="exactly_once").run(spark)
    assert twice.count() == 3
    for stages in ([], [("identity", {})] * 4):
        with pytest.raises(ValueError):
            Pipeline(source, stages)
    for stage in (("nosuch", {}), ("grep", {}), ("grep", {"pattern": ""}), ("echo", {"x": 1})):
        with pytest.raises(ValueError):
            Pipeline(source, [stage])
    with pytest.raises(ValueError):
        Pipeline(source, [("grep", ["("])]).run(spark)


def test_own_operators(spark):
    source = lambda s: s.createDataFrame([(k, v, k) for k, v in GREP], "key string, value string, id string")
    pipeline.register_row_op("twice", lambda b: b.loc[b.index.repeat(2)])
    pipeline.register_keyed_op("longest", lambda b: b.loc[[b.value.str.len().idxmax()]])
    got = Pipeline(source, [("key_by", [3]), ("twice", {}), ("longest", {})]).run(spark)
    assert got.count() == 3
    pipeline.register_op("upper", lambda: lambda df: df.selectExpr("key", "upper(value) as value", "id"))
    assert Pipeline(source, [("upper", {}), ("repartition", {"n": 3})]).run(spark).first().value.isupper()


def test_counts_and_top(spark):
    keys = ["apple", "banana", "apple", "apple", "banana", "cherry", ""]
    rows = spark.createDataFrame([(k, "v", str(i)) for i, k in enumerate(keys)], "key string, value string, id string")
    counts = aggregate.count_by_key(rows)
    assert [tuple(r) for r in aggregate.top(counts).collect()] == [("apple", 3), ("banana", 2), ("", 1), ("cherry", 1)]
    assert [tuple(r) for r in aggregate.top_k(counts, 2).orderBy("rank").collect()] == [(1, "apple", 3), (2, "banana", 2), (3, "... and 2 more", None)]
    assert aggregate.count_by_key(rows.limit(0)).count() == 0 and aggregate.top_k(counts.limit(0)).count() == 0
    assert tuple(aggregate.totals(counts, 3.0).first()) == (7, 4, 2.33)
    skew = aggregate.skew_report(rows, "key", 8).collect()
    assert len(skew) == 8 and sum(r.rows for r in skew) == 7 and any(r.low for r in skew)


def test_reconcile(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "key string, n long")
    b = spark.createDataFrame([("x", 1), ("z", 2), (None, 3)], "key string, n long")
    got = {r.key: r.ok for r in reconcile.reconcile(a, b).collect()}
    assert got == {"x": True, "y": False, "z": False, None: True}
    assert tuple(reconcile.reconcile_totals(reconcile.reconcile(a, a)).first()) == (6, 6, 0, True)
    assert reconcile.same_rows(a.union(a), a).count() == 3 and reconcile.same_rows(a, a).count() == 0
    big = spark.range(2000)
    assert reconcile.row_count_check(big.limit(1990), big).first().passed and not reconcile.row_count_check(big.limit(1989), big).first().passed
