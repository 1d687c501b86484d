"""Operators with mergeable states."""

import pytest
from tideline.operators import lines
from tideline.plans.keyed import keyed_states
from tideline.plans.pipeline import Pipeline


def longest(rows, **more):
    """(key, longest value, rows) from states."""
    add = lambda s, row: (max(s[0], row["value"] or "", key=len), s[1] + 1)
    return keyed_states(rows, lambda: ("", 0), add, lambda a, b: (max(a[0], b[0], key=len), a[1] + b[1]), lambda k, s: [(k, s[0], s[1])] if s[1] > 1 else [], "key string, value string, n long", **more)


@pytest.mark.parametrize("held", [100_000, 2])
@pytest.mark.parametrize("parts", [1, 9])
def test_states_equal_plain_python(spark, held, parts):
    rows = [(None if k % 10 == 9 else "hot" if k % 3 else f"k{k % 17}", "v" * (k % 13), str(k)) for k in range(400)]
    want = {}
    for k, v, _ in rows:
        a, n = want.get(k, ("", 0))
        want[k] = (max(a, v, key=len), n + 1)
    df = spark.createDataFrame(rows, "key string, value string, id string").repartition(parts)
    assert sorted((tuple(r) for r in longest(df, held=held).collect()), key=str) == sorted(((k, *v) for k, v in want.items() if v[1] > 1), key=str)
    assert longest(df.limit(0)).collect() == []


def test_a_hot_key_is_many_tasks(spark):
    """A third of all rows have one key; what tasks read after the first shuffle are states, a few a task."""
    df = spark.range(0, 60_000, 1, 36).selectExpr("if(id % 3 = 0, 'hot', string(id % 50)) key", "'v' value", "string(id) id")
    out = longest(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3 and plan.count("Exchange") == 2
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("hot", "hot")
    assert sum(r["n"] for r in out.collect()) == 60_000
    read = []
    store = spark.sparkContext._jsc.sc().statusStore()
    for job in before.getJobIdsForGroup("hot"):
        for stage in before.getJobInfo(job).stageIds:
            info = store.lastStageAttempt(stage)
            read.append(info.shuffleReadRecords())
    assert max(read) <= 36 * 51


def test_as_a_stage(spark):
    from tideline.plans.keyed import register_state_op

    register_state_op("total", lambda: 0, lambda s, row: s + int(row["value"]), lambda a, b: a + b, lambda k, s: [(k, str(s), f"total-{k}")])
    rows = spark.createDataFrame([("a", "1", "x"), ("b", "5", "y"), ("a", "2", "z")], "key string, value string, id string")
    assert sorted(map(tuple, Pipeline(lambda s: rows, [("total", {})]).frame(spark).collect())) == [("a", "3", "total-a"), ("b", "5", "total-b")]


def test_dedup_is_one_pass(spark):
    rows = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("c", "2", None), ("c", "2", None)], "key string, value string, id string")
    assert sorted(r["key"] for r in lines.dedup(order="key")(rows).collect()) == ["a", "c", "c"]
    assert len(lines.dedup()(rows).collect()) == 3
    for op in (lines.dedup(), lines.dedup(order="key")):
        plan = op(rows)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") == 1 and "Union" not in plan
