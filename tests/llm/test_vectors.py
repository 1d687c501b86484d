import numpy as np
import pytest
from tideline.llm import vectors
from tideline.llm.common import table


def brute_force(rows, threshold=0.93):
    usable = [(k, r) for k, r in enumerate(rows) if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links, top = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, (i, p) in enumerate(usable):
        for j, q in usable[:a]:
            if p[2] == q[2] and len(p[1]) == len(q[1]):
                x, y = np.array(p[1], np.float64), np.array(q[1], np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    top[find(i)] = find(j)
    lowest = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            lowest[find(k)] = min(lowest.get(find(k), r[0]), r[0])
    return sorted(((r[0], links[k], lowest.get(find(k)), lowest.get(find(k)) == r[0]) for k, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("per_cell, block, sub", [(2_000, 1024, 64), (20, 16, 64), (8, 16, 4)])
def test_equals_all_pairs(spark, sf_dir, monkeypatch, per_cell, block, sub):
    monkeypatch.setattr(vectors, "SUB", sub)
    given = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows = [tuple(r) for r in given.collect()][:400]
    rng = np.random.default_rng(3)
    centre = rng.normal(size=64)
    rows += [(5000 + k, (centre + rng.normal(size=64) * 0.22).tolist(), 3) for k in range(80)]
    rows += [(6000 + k, rows[0][1], rows[0][2]) for k in range(5)] + [(6000, rows[0][1], rows[0][2])]
    rows += [(7000, None, 1), (7001, [], 1), (7002, [0.0] * 64, 1), (7003, [None] * 64, 1), (7004, [float("nan")] * 64, 1), (7005, [float("inf")] * 64, 1)]
    rows += [(7006, rows[1][1], None), (7007, [1.0, 2.0], 1), (7008, [2.0, 4.0], 1), (7009, [1.0, 2.0], 2)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as n_links")
    got = sorted((tuple(r) for r in vectors.near_vectors(made, z=float("inf"), per_cell=per_cell, block=block).collect()), key=str)
    assert got == brute_force(rows)
    assert sum(r[1] for r in got) > 100


def test_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def pair_at(x, cos, rng):
    """A vector at exactly this cosine to x, in a random direction."""
    e = rng.normal(size=len(x))
    e -= (e @ x) / (x @ x) * x
    return cos * x / np.linalg.norm(x) + np.sqrt(1 - cos * cos) * e / np.linalg.norm(e)


@pytest.mark.parametrize("sub", [64, 8])
def test_recall_of_pairs_at_the_threshold(monkeypatch, sub):
    """Isotropic vectors are the hardest to keep in cells: pairs planted at the threshold itself, over 50 cells."""
    monkeypatch.setattr(vectors, "SUB", sub)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 64))
    cells = vectors.Cells(x / np.linalg.norm(x, axis=1, keepdims=True), 50)
    a = rng.normal(size=(4_000, 64))
    b = np.array([pair_at(v, 0.93, rng) for v in a])
    both = np.concatenate([a / np.linalg.norm(a, axis=1, keepdims=True), b])
    exact, default = (cells.place(both, np.sin(np.arccos(0.93)) * min(1, z / 8)) for z in (np.inf, 3.5))

    def met(placed):
        seen = {}
        for row, cell, home in zip(*placed):
            seen.setdefault(row, {})[cell] = home
        return np.mean([any(seen[k].get(c, 0) | h == 3 for c, h in seen[k + 4_000].items() if c in seen[k]) for k in range(4_000)])

    assert met(exact) == 1.0 and met(default) >= 0.999
    assert len(default[0]) < 0.75 * len(exact[0])


def test_stars():
    rng = np.random.default_rng(4)
    for n, m in ((50, 30), (200, 150), (300, 299), (5, 0)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        if m == 299:  # one long path
            a, b = np.arange(299), np.arange(1, 300)
        top = list(range(n))
        for _ in range(n):
            for i, j in zip(a, b):
                top[i] = top[j] = min(top[i], top[j])
        u, v = vectors.stars(a, b, n)
        assert dict(zip(u.tolist(), v.tolist())) == {i: t for i, t in enumerate(top) if t != i}
