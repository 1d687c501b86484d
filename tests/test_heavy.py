"""Keys with the most rows: exact on tables, within stated bounds on streams."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.test_plans import exchanges, plan
from tideline.operators import heavy
from tideline.plans import queries
from tideline.sources.snapshots import Snapshots
from tideline.streaming.heavy import read_heavy, run_heavy


def keys(seed, n=20_000):
    """A third of all rows on one key, some keys in between, a long tail; ties and nulls too."""
    rng = np.random.default_rng(seed)
    tail = [f"t{x}" for x in rng.integers(0, n, n // 3)]
    some = [f"m{x}" for x in np.minimum(rng.geometric(0.08, n // 3), 40)]
    out = ["hot"] * (n // 3) + some + tail + ["tie-a"] * 900 + ["tie-b"] * 900 + [None] * 700
    rng.shuffle(out)
    return out


def top(found, k):
    return sorted(found.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[:k]


@pytest.mark.parametrize("capacity,k", [(400, 10), (100, 5), (8, 10), (100_000, 10), (400, 100_000)])
def test_equals_a_full_count(spark, capacity, k):
    rows = keys(1)
    df = spark.createDataFrame([(x,) for x in rows], "key string").repartition(6)
    got = [(r.key, r.n) for r in heavy.heavy_keys(df, k, capacity=capacity).collect()]
    assert got == top(collections.Counter(rows), k)


def test_only_candidates_are_shuffled(spark):
    df = spark.createDataFrame([(x,) for x in keys(2)], "key string").repartition(6)
    found = heavy.heavy_keys(df, 10, capacity=400)
    assert "LeftSemi" in plan(found) and "BroadcastHashJoin" in plan(found)
    counted = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in counted
    assert heavy.heavy_keys(df.limit(0), 10).collect() == []


def test_flat_counts_are_counted_in_full(spark):
    df = spark.range(5000).select((F.col("id") % 2500).cast("string").alias("key"))
    found = heavy.heavy_keys(df, 3, capacity=50)
    assert "LeftSemi" not in plan(found) and exchanges(found)
    assert [(r.key, r.n) for r in found.collect()] == [("0", 2), ("1", 2), ("10", 2)]


def test_batches_are_counted_together(monkeypatch):
    """Small batches make few counts, large ones no large piece; the counters are those of all rows."""
    batch = lambda *x: pa.RecordBatch.from_arrays([pa.array(x, pa.string())], names=["key"])
    monkeypatch.setattr(heavy, "ROWS", 30)
    small = [batch("a", "b", None)] * 25 + [batch()]
    assert [len(x) for x in heavy._pieces(small)] == [30, 30, 15]
    monkeypatch.setattr(heavy, "BYTES", 1000)
    assert [len(x) for x in heavy._pieces([batch("x" * 2000), batch("y"), batch("z" * 2000)])] == [1, 2]
    found = next(heavy._count(10)(iter([*small, batch("c")]))).to_pydict()
    assert dict(zip(found["key"][:-1], found["n"])) == {"a": 25, "b": 25, None: 25, "c": 1} and found["rows"][-1] == 76 and found["lost"][-1] == 0
    assert list(heavy._pieces([])) == []


def test_texts_are_dealt_before_their_words(spark, sf_dir):
    """What is shuffled is texts, and nothing where the scan has parts enough."""
    text = plan(queries._words(spark, sf_dir, 8))
    assert text.index("Generate") < text.index("RoundRobin") and text.count("Exchange") == 1
    assert "Exchange" not in plan(queries._words(spark, sf_dir))


def test_reduced_bounds():
    rng = np.random.default_rng(3)
    for _ in range(50):
        want, held, lost = collections.Counter(), {}, 0
        for _ in range(20):
            part = collections.Counter(rng.geometric(0.05, 200).tolist())
            want += part
            for key, n in part.items():
                held[key] = held.get(key, 0) + n
            held, off = heavy.reduced(held, 12)
            lost += off
        assert len(held) <= 12 and 13 * lost <= sum(want.values()) - sum(held.values())
        assert all(held.get(key, 0) <= n <= held.get(key, 0) + lost for key, n in want.items())


def test_stream_bounds_restart_and_replay(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("source", "out", "checkpoint"))
    want, capacity = collections.Counter(), 60
    for seed in range(3):
        rows = keys(seed, 6000)
        want.update(rows)
        spark.createDataFrame([(x,) for x in rows], "key string").repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string").option("maxFilesPerTrigger", 2).parquet(source)
        run_heavy(stream, path, checkpoint, capacity=capacity)  # goes on from where it was
        got = {r.key: (r.at_least, r.at_most) for r in read_heavy(spark, path).collect()}
        totals = Snapshots(spark, path).read("totals").first()
        assert totals.rows == sum(want.values()) and totals.lost <= totals.rows / (capacity + 1) and len(got) <= capacity
        assert all(low <= want[key] <= high for key, (low, high) in got.items())
        assert {key for key, n in want.items() if n > totals.lost} <= set(got)
    before = Snapshots(spark, path).batches()
    run_heavy(spark.readStream.schema("key string").parquet(source), path, str(tmp_path / "again"), capacity=capacity)  # batch 0 once more
    assert Snapshots(spark, path).batches() == before and Snapshots(spark, path).read("totals").first() == totals
