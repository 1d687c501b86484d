import collections
import math

import numpy as np
import pyarrow as pa
import pytest
from tideline.llm import lm_scoring, textwords
from tideline.llm.common import Scratch


@pytest.mark.parametrize("known", [1 << 18, 20])
def test_rare_words_have_their_own_counts(spark, monkeypatch, known):
    """Words in a bucket differ by the log of their counts, joined or at hand."""
    monkeypatch.setattr(lm_scoring, "KNOWN", known)
    often = " ".join(f"w{k}" for k in range(lm_scoring.CLASSES - lm_scoring.RARE))
    docs = [(k, often) for k in range(9)]
    words = [f"r{k}" for k in range(300)]
    docs += [(100 + k, w) for k, w in enumerate(words)] + [(1000 + k, w) for k, w in enumerate(w for w in words[:150] for _ in range(4))]
    docs += [(5000, f"{words[0]} {words[299]} {words[299]}"), (5001, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    counts = lm_scoring.count_words(docs, Scratch(spark))
    vocabulary, net = lm_scoring.fit(docs, counts=counts)
    got = {r.doc_id: r for r in lm_scoring.score(docs, vocabulary, net, counts).collect()}
    assert len(got) == docs.count() and got[5001].log_prob == 0 and got[5001].mean_log_prob is None
    n = collections.Counter(w for r in docs.collect() for w in (r.text or "").split())
    hashes = textwords.words(pa.array(words))[4]
    bucket = (hashes % np.uint64(lm_scoring.RARE)).astype(int)
    plain = {r.doc_id: r.log_prob for r in lm_scoring.score(docs, vocabulary, net).collect()}
    mass = collections.Counter()
    for w, b in zip(words, bucket):
        mass[b] += n[w]
    assert vocabulary.in_buckets.tolist() == [mass[b] for b in range(lm_scoring.RARE)]
    for k, (w, b) in enumerate(zip(words, bucket)):
        share = math.log(n[w] / (mass[b] + 1))
        assert got[100 + k].log_prob == pytest.approx(plain[100 + k] + vocabulary.rare_cost + share, abs=1e-6)
    whole = {r.doc_id: r.log_prob for r in lm_scoring.fit_and_score(docs).collect()}
    a, b = next((i, j) for i in range(1, 150) for j in range(150, 299) if bucket[i] == bucket[j])
    assert whole[100 + a] - whole[100 + b] == pytest.approx(math.log(5), abs=1e-5)
