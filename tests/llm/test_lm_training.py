import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tideline.llm import lm_scoring


def test_short_texts_train(spark):
    """Every word is a target, those of texts of one or two words too."""
    docs = spark.createDataFrame([(k, ("left right", "up down", "alone")[k % 3]) for k in range(600)], "doc_id long, text string").coalesce(2)
    vocabulary, net = lm_scoring.fit(docs)
    untrained = lm_scoring.Network(vocabulary.unigram)
    got, plain = ({r.doc_id: r.log_prob for r in lm_scoring.score(docs, vocabulary, n).collect()} for n in (net, untrained))
    assert np.mean([got[k] - plain[k] for k in range(0, 600, 3)]) > 0.05
    assert np.mean([got[k] - plain[k] for k in range(1, 600, 3)]) > 0.05


def plain_training(texts, vocabulary, rate):
    """One shard, word by word and weight by weight."""
    import pyarrow as pa
    from tideline.llm import textwords

    net = lm_scoring.Network(vocabulary.unigram)
    w = {k: x.astype(np.float64) for k, x in net.w.items()}
    square = {k: np.full_like(x, 1e-4) for k, x in w.items()}
    words = []
    for t in texts:
        c = vocabulary.classes(textwords.words(pa.array([t]))[4]).tolist()
        padded = [lm_scoring.CLASSES] * 2 + c + [lm_scoring.CLASSES] * 2
        words += [(padded[i : i + 2] + padded[i + 3 : i + 5], c[i]) for i in range(len(c))]
    order, seen = [], 0
    while seen < len(words):
        n = min(16 * lm_scoring.BATCH, len(words) - seen)
        order.append(seen + np.random.default_rng(seen).permutation(n))
        seen += n
    for part in order:
        for at in range(0, len(part), lm_scoring.BATCH):
            some, slope = part[at : at + lm_scoring.BATCH], {k: np.zeros_like(x) for k, x in w.items()}
            for i in some:
                context, target = words[i]
                g, m = divmod(target, lm_scoring.GROUPS)
                h = np.tanh(w["shift"] + sum(w["embed"][k][c] for k, c in enumerate(context)))
                a = np.exp(h @ w["group"][:-1] + w["group"][-1])
                b = np.exp(h @ w["member"][g][:-1] + w["member"][g][-1])
                a, b = a / a.sum(), b / b.sum()
                a[g] -= 1
                b[m] -= 1
                slope["group"] += np.outer([*h, 1], a) / len(some)
                slope["member"][g] += np.outer([*h, 1], b) / len(some)
                back = (w["group"][:-1] @ a + w["member"][g][:-1] @ b) * (1 - h * h) / len(some)
                slope["shift"] += back
                for k, c in enumerate(context):
                    slope["embed"][k][c] += back
            for k in w:
                square[k] += slope[k] ** 2
                w[k] -= rate * slope[k] / np.sqrt(square[k])
    return w, len(words)


def test_training_equals_a_plain_loop(spark, monkeypatch):
    """Shards, batches and averages against word by word training."""
    monkeypatch.setattr(lm_scoring, "BATCH", 40)
    monkeypatch.setattr(lm_scoring, "SHARD_WORDS", 450)
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 50, rng.integers(1, 30)))) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    counts = lm_scoring.count_words(docs, lm_scoring.Scratch(spark))
    vocabulary, _ = lm_scoring.fit(docs, counts=counts)
    shards = -(-sum(len(t.split()) for _, t in rows) // 450)
    placed = docs.withColumn("place", F.xxhash64("doc_id", "text", F.lit(11))).withColumn("shard", F.pmod("place", F.lit(shards))).orderBy("place").collect()
    # batches in tasks have the module's size: train here as a task does
    parts, mine = [], []
    for s in range(shards):
        texts = [r.text for r in placed if r.shard == s]
        parts.append(plain_training(texts, vocabulary, 0.1))
        state = lm_scoring.Shard(vocabulary, 0.1)
        for t in texts:
            state.add(pa.array([t]))
        n, weights = state.weights()
        assert n == parts[-1][1]
        mine.append(np.frombuffer(weights, "<f4"))
    assert shards > 2
    for flat, (w, _) in zip(mine, parts):
        want = np.concatenate([x.ravel() for x in w.values()])
        assert np.abs(flat - want).max() < 5e-3 and np.abs(flat - want).mean() < 1e-5


def test_the_model_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_WORDS", 300)
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 80, 25))) for k in range(200)] + [(1005, None), (1006, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = [lm_scoring.fit(d) for d in (docs.coalesce(1), docs.repartition(7))]
    assert np.array_equal(models[0][1].flat(), models[1][1].flat())
    a, b = ({r.doc_id: r.log_prob for r in lm_scoring.fit_and_score(d).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert all(abs(a[k] - b[k]) <= 1e-5 * abs(a[k]) for k in a)


def test_words_of_one_text_alone(spark):
    docs = spark.createDataFrame([(1, "a b only1 only2"), (2, "a b twice"), (3, "a b twice"), (4, None)], "doc_id long, text string")
    for known in (1 << 18, 2):
        lm_scoring.KNOWN, before = known, lm_scoring.KNOWN
        got = {r.doc_id: r.n_single for r in lm_scoring.fit_and_score(docs).collect()}
        lm_scoring.KNOWN = before
        assert got == {1: 2, 2: 0, 3: 0, 4: 0}


def test_single_words_among_those_of_the_buckets(spark, monkeypatch):
    often = " ".join(f"w{k}" for k in range(lm_scoring.CLASSES - lm_scoring.RARE))
    docs = spark.createDataFrame([(1, often), (2, often), (3, "rare1 twice"), (4, "rare2 rare3 w1 twice")], "doc_id long, text string")
    for known in (1 << 18, 1):
        monkeypatch.setattr(lm_scoring, "KNOWN", known)
        assert {r.doc_id: r.n_single for r in lm_scoring.fit_and_score(docs).collect()} == {1: 0, 2: 0, 3: 1, 4: 2}
