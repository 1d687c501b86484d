import numpy as np
import pytest
from tideline.llm import lm_scoring
from tideline.llm.common import table


def direct(net, context, target):
    """Log-probability of one word, without batches or grouping."""
    w = net.w
    h = np.tanh(w["shift"] + sum(w["embed"][k][c] for k, c in enumerate(context)))
    a = np.exp(h @ w["group"][:-1] + w["group"][-1])
    z = [np.exp(h @ w["member"][g][:-1] + w["member"][g][-1]) for g in range(lm_scoring.GROUPS)]
    p = np.concatenate([a[g] / a.sum() * z[g] / z[g].sum() for g in range(lm_scoring.GROUPS)])
    assert abs(p.sum() - 1) < 1e-4
    return np.log(p[target])


def test_scores_equal_direct_sums_and_rank_shuffled_texts_lower(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary, net = lm_scoring.fit(docs)
    rows = docs.orderBy("doc_id").limit(12).collect()
    got = {r.doc_id: r for r in lm_scoring.score(docs, vocabulary, net).collect()}
    assert len(got) == docs.count()
    import pyarrow as pa
    from tideline.llm import textwords

    for r in rows[:4]:
        _, _, _, _, hashes, first = textwords.words(pa.array([r.text]))
        c = vocabulary.classes(hashes)
        around = lm_scoring.windows(c, first)
        padded = [lm_scoring.CLASSES] * 2 + c.tolist() + [lm_scoring.CLASSES] * 2
        assert all(around[i].tolist() == [padded[i], padded[i + 1], padded[i + 3], padded[i + 4]] for i in range(len(c)))
        assert got[r.doc_id].n_words == len(c)
        assert got[r.doc_id].log_prob == pytest.approx(sum(direct(net, x, t) - vocabulary.rare_cost * (t >= lm_scoring.CLASSES - lm_scoring.RARE) for x, t in zip(around, c)), rel=1e-4)
    rng = np.random.default_rng(0)
    en = table(spark, sf_dir, "documents").where("lang = 'en' and n_chars > 1000").select("doc_id", "text").limit(30).collect()
    mixed = [(r.doc_id, " ".join(rng.permutation(list("".join(r.text.split())))[: len(r.text)].tolist())) for r in en]
    noise = {r.doc_id: r.mean_log_prob for r in lm_scoring.score(spark.createDataFrame(mixed, "doc_id long, text string"), vocabulary, net).collect()}
    assert np.mean([got[k].mean_log_prob > v for k, v in noise.items()]) > 0.9


def test_gradient_matches_differences():
    rng = np.random.default_rng(2)
    net = lm_scoring.Network(np.full(lm_scoring.CLASSES, 1 / lm_scoring.CLASSES))
    for k in net.w:
        net.w[k] = rng.normal(0, 0.3, net.w[k].shape)
    context, target = rng.integers(0, lm_scoring.CLASSES + 1, (50, 4)), rng.integers(0, lm_scoring.CLASSES, 50)
    slope, embed = net.gradient(context, target)
    slope["embed"] = np.zeros_like(net.w["embed"])
    for k, (classes, g) in enumerate(embed):
        slope["embed"][k][classes] = g
    for k, x in net.w.items():
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in x.shape)
            if k == "embed":
                at = (1, context[0, 1], 3)
            if k == "member":
                at = (target[0] // lm_scoring.GROUPS, *at[1:])
            loss = []
            for d in (1e-3, -1e-3):
                x[at] += d
                loss.append(-net.log_probs(context, target).mean())
                x[at] -= d
            assert slope[k][at] == pytest.approx((loss[0] - loss[1]) / 2e-3, rel=2e-2, abs=2e-5)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "?!"), (4, "one"), (4, "one"), (None, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words")
    got = lm_scoring.fit_and_score(docs).collect()
    assert sorted(r.n_words for r in got) == [0, 0, 0, 1, 1, 2]
    assert all((r.mean_log_prob is None) == (r.n_words == 0) and np.isfinite(r.log_prob) for r in got)
    assert lm_scoring.fit_and_score(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "many words " * 300_000), (2, "many words")], "doc_id long, text string")
    assert {r.doc_id: r.n_words for r in lm_scoring.fit_and_score(long).collect()} == {1: 600_000, 2: 2}
