"""Exact top-k search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tideline.llm import topk
from tideline.llm.common import table
from tideline.llm.queries import QUERIES


def brute(rows, k, ask):
    """rows: (vec_id, embedding or None); whole-number products in plain Python."""
    kept = [(v, [int(np.floor(64 * float(x))) for x in e]) for v, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, (v, e) in enumerate(kept):
        if v is None or not ask(v):
            continue
        found = [(-sum(a * b for a, b in zip(e, f)), w is None, w or 0, w) for j, (w, f) in enumerate(kept) if j != i and len(f) == len(e)]
        out += [(v, r, w, -s) for r, (s, _, _, w) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def searched(spark, rows, k=20, every=20, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted((tuple(r) for r in topk.top_k(df, F.col("vec_id") % every == 0, k, **more).collect()), key=str)


@pytest.mark.parametrize("per_shard", [16, 100_000])
def test_equals_brute_force(spark, per_shard):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 6))
    x = centres[rng.integers(0, 5, 400)] + 0.2 * rng.normal(size=(400, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert searched(spark, rows, 7, 4, per_shard=per_shard) == brute(rows, 7, lambda v: v % 4 == 0)


def test_ties_copies_and_odd_rows(spark):
    grid = [(i, [float(i % 3 - 1), float(i % 2)]) for i in range(60)]  # six vectors only
    hot = [(100 + i, [0.5, 0.5]) for i in range(90)]  # more copies than anyone's best
    odd = [(None, [1.0, 1.0]), (None, [1.0, 1.0]), (200, None), (202, [None, 1.0]), (204, [float("nan"), 0.0]), (206, [float("inf"), 0.0]), (208, []), (210, []), (212, [1.0]), (0, [0.5, 0.5]), (0, [0.5, 0.5])]
    rows = grid + hot + odd
    for per_shard in (8, 1000):
        assert searched(spark, rows, 5, 2, per_shard=per_shard) == brute(rows, 5, lambda v: v % 2 == 0)


def test_products_beyond_double_precision(spark):
    rows = [(i, [float(3**14 + i), float(2**20 - 7 * i), -float(i)]) for i in range(40)]
    assert searched(spark, rows, 6, 4, per_shard=8) == brute(rows, 6, lambda v: v % 4 == 0)


def test_few_rows_empty_table_and_other_columns(spark):
    assert searched(spark, [], 3) == []
    assert searched(spark, [(0, [1.0])], 3) == []
    df = spark.createDataFrame([(0, [1.0], "a", 1), (1, [2.0], "b", 2)], "vec_id long, embedding array<float>, key string, score int")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 128)]


def test_boxes_bound_and_the_tree_is_pruned():
    rng = np.random.default_rng(5)
    x = np.floor(64 * np.concatenate([rng.normal(m, 0.05, (500, 8)) for m in (-1, 0, 1, 2)]))
    tree, seen = topk.Tree(x), []
    assert sorted(tree.order) == list(range(2000)) and max(e - s for (s, e), c in zip(tree.spans, tree.children) if c is None) <= topk.LEAF
    for (s, e), low, high in zip(tree.spans, tree.low, tree.high):
        assert (tree.x[s:e] >= low).all() and (tree.x[s:e] <= high).all()

    class Watched(np.ndarray):
        pass

    q = x[:50]
    spans = tree.spans
    tree.spans = type("L", (list,), {"__getitem__": lambda self, i: (seen.append(i), spans[i])[1]})(spans)
    place, score = tree.search(q, np.arange(2000), 10, np.full(50, float(topk.LOW)))
    want = np.sort(q @ x.T, axis=1)[:, ::-1][:, :10]
    assert (score == want).all()
    assert len(set(seen)) < sum(c is None for c in tree.children) / 2  # leaves that anyone read


def test_query_over_the_whole_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()]
    found = QUERIES["op11_topk_search"](spark, sf_dir)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, 20, lambda v: v % 20 == 0)
