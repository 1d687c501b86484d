"""Entropy balancing against a bisection solver in plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tideline.llm import mixing


def plain_mix(rows, ratio=1.5, most=2):
    """{doc_id: (target, rate, copies)} of rows (doc_id, source, size, unit)."""
    sources = sorted({s for _, s, _, _ in rows if s is not None}) + [None] * any(s is None for _, s, _, _ in rows)
    tokens = {s: sum(n for _, x, n, _ in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, left, free = {}, ratio * sum(tokens.values()), [s for s in sources if tokens[s]]
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > most * tokens[s]]
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = most * tokens[s]
            left -= target[s]
        free = [s for s in free if s not in full]
    out = {}
    for s in sources:
        mine = [(i, n, u) for i, x, n, u in rows if x == s]
        want = target.get(s, 0.0)
        if want >= most * tokens[s] * (1 - 1e-12):
            rates, shift = [float(most)] * len(mine), 0
        else:
            rate = lambda x, n: min(float(most), math.exp(min(x * n, 700)))
            low, high = -1e3, 1e3
            for _ in range(300):
                x = (low + high) / 2
                low, high = (x, high) if sum(n * rate(x, n) for _, n, _ in mine) < want else (low, x)
            rates = [rate(low, n) for _, n, _ in mine]
            # every shift that changes a copy, of which the one that comes nearest is taken
            changes = sorted((math.ceil((k - r - u) * mixing.BINS), n) for r, (_, n, u) in zip(rates, mine) if n for k in range(1, most + 1))
            best, total = None, 0
            for at, (b, n) in enumerate(changes):
                total += n
                if at + 1 == len(changes) or changes[at + 1][0] != b:
                    best = min(best or (math.inf,), (abs(total - want), abs(b), b))
            shift = best[2] if best else 0
        for r, (i, n, u) in zip(rates, mine):
            out[i] = want, r, sum(math.ceil((k - r - u) * mixing.BINS) <= shift for k in range(1, most + 1))
    return out


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_equals_a_plain_solver(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    rng = np.random.default_rng(9)
    rows = [(k, f"s{int(rng.integers(0, 7)) ** 2 // 7}", " ".join(["w"] * int(rng.choice([1, 3, 40, 200, 1000])))) for k in range(400)]
    rows += [(1000 + k, None, "a b c") for k in range(5)] + [(2000, "empty", ""), (2001, "empty", None), (2002, "tiny", "one")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as size", "2 as copies", "3 as mark")
    unit = (F.pmod(mixing.hash_number(), F.lit(1 << 40)) / float(1 << 40)).alias("unit")
    given = [(r.doc_id, r.source, len((r.text or "").split()), r.unit) for r in docs.select("doc_id", "source", "text", unit).collect()]
    want = plain_mix(given)
    got = {r.doc_id: r for r in mixing.report(docs).collect()}
    assert len(got) == len(want)
    for i, (target, rate, copies) in want.items():
        assert got[i].target == pytest.approx(target, rel=1e-9)
        assert got[i].rate == pytest.approx(rate, rel=1e-6) or got[i].size == 0
        assert got[i].copies == copies or got[i].size == 0, (i, got[i], rate)
    taken = mixing.mixed(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in got.values())


def test_a_long_text_and_ties(spark):
    docs = spark.createDataFrame([(1, "a", "w " * 500_000), (2, "a", "w"), (2, "a", "w"), (None, "b", "x"), (None, "b", "x y")], "doc_id long, source string, text string")
    rows = mixing.report(docs).collect()
    assert sorted(r.size for r in rows) == [1, 1, 1, 2, 500_000]
    assert len({r.copies for r in rows if r.doc_id == 2}) == 1
