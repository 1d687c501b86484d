import re
from collections import defaultdict

import numpy as np
import pytest
from tideline.llm import near_join
from tideline.llm.common import Scratch, table
from tideline.llm.graph import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_force(rows, threshold=0.8):
    """{doc_id: (class_id, n_links)} by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top, links = {i: i for i in sets}, defaultdict(int)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i in sets:
        common = defaultdict(int)
        for x in sets[i]:
            for j in where[x]:
                common[j] += 1
        for j, n in common.items():
            if i < j and n >= threshold * (len(sets[i]) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (find(i), links[i]) for i in sets}


@pytest.mark.parametrize("block", [512, 7])
def test_equals_all_pairs(spark, sf_dir, block):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen".split()
    made = [(10_000 + k, " ".join([*near[: k % 3], *near, *[str(k % 5)] * (k % 2)])) for k in range(40)]
    made += [(20_000, None), (20_001, ""), (20_002, "!?"), (20_003, "a b"), (20_004, "A, b."), (20_005, "a b c")]
    both = docs.union(spark.createDataFrame(made, docs.schema))
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_join.near_join(both, block=block).collect()}
    assert got == brute_force([tuple(r) for r in both.collect()])


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_join.near_join(empty).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_join.near_join(rows).collect()), key=str)
    assert got == [(1, 1, 2, 1), (1, 1, 2, 1), (2, 2, 0, 2), (None, 1, 2, 1)]
    kept = near_join.one_per_group(rows.selectExpr("*", "'x' as class_id", "1 as key"))
    assert sorted((tuple(r) for r in kept.collect()), key=str) == [(1, "a b c d e f", "x", 1), (2, None, "x", 1), (None, "a b c d e f", "x", 1)]


def test_components_of_chains_and_stars(spark):
    edges = [(f"{k:03d}", f"{k + 1:03d}") for k in range(40)] + [("900", f"{k}") for k in range(901, 930)] + [("x", "x")]
    got = {r.u: r.component for r in components(spark.createDataFrame(edges, "u string, v string"), Scratch(spark)).collect()}
    assert {k: v for k, v in got.items() if k < "900"} == {f"{k:03d}": "000" for k in range(41)}
    assert {v for k, v in got.items() if k >= "900"} == {"900"}


def test_bayesian_bound_keeps_true_pairs():
    least = near_join.least_matches(0.8, 1e-6)
    matches = np.random.default_rng(1).random((20_000, near_join.HASHES)) < 0.8
    counts = matches.cumsum(axis=1)
    lost = np.zeros(len(matches), bool)
    for n, m in least.items():
        lost |= counts[:, n - 1] < m
    assert lost.mean() < 2e-4


def test_very_long_texts(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    words = [f"w{x}" for x in rng.integers(0, 5000, 200_000)]
    changed = words[:100_000] + ["new"] + words[100_001:]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[::-1])), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as class_id")
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_join.near_join(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}
