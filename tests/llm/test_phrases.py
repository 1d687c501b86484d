"""Collocations against plain counting, and the parse that they are counted in."""

import re
from collections import Counter

import pytest
from tideline.llm import phrases

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def pieces(text):
    return [w for w in ([x for x in re.split("[ \t]+", p) if x] for p in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER))) if w]


def plain(rows, least, first, share=100):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *words), a in candidates.items():
        held = any(q[0] == lang and len(q) - 1 > len(words) and 100 * b >= share * a and any(list(q[i : i + len(words)]) == words for i in range(1, len(q))) for q, b in candidates.items())
        if not held:
            cuts = [(1000 * a * n[lang] // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.append((lang, " ".join(words), a, f[(lang, *words[:k])], f[(lang, *words[k:])], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, r, *x[1:]) for r, x in enumerate(own[:first], 1)]
    return sorted(ranked)


ROWS = (
    [("en", "The quick, brown Fox; the quick brown fox!\nthe quick\tbrown fox  jumps over"), ("en", "a a a a a a a a a a"), (None, "one two three. one two three"), ("und", "one two\x0bthree one two")] * 3
    + [("en", None), ("en", ""), ("en", " \t. ,"), (None, None), ("de", "Über die Brücke\xa0geht Ärger — über die Brücke")]
    + [("en", f"passage number {i} begins, the long shared passage of words that copies hold goes on and on until it ends here. and {i % 3} more of it") for i in range(40)]
    + [("x", "w" + " w" * 500), ("en", "k " * 3 + "\x00 \x00 (x) [y] " * 4)]
)


@pytest.mark.parametrize("every", [1, 3, 32])
@pytest.mark.parametrize("share", [100, 60])
def test_equals_plain_counting(spark, every, share):
    docs = spark.createDataFrame([(lang, text, "x", 1) for lang, text in ROWS], "lang string, text string, g string, n int").repartition(3)
    found = sorted(tuple(r) for r in phrases.collocations(docs, least=3, first=20, share=share, every=every).collect())
    assert found == plain(ROWS, 3, 20, share)


def test_counts_are_exact_beyond_64_bits(spark):
    a, b = spark.range(1).selectExpr("cast(1000 as decimal(19,0)) * cast(9000000000000 as decimal(19,0)) * cast(8000000000000 as decimal(19,0)) a", "cast(9000000000000 as decimal(19,0)) * cast(7 as decimal(19,0)) b").select("a", "b").first()
    got = spark.range(1).selectExpr("cast(1000 as decimal(19,0)) * cast(9000000000000 as decimal(19,0)) * cast(8000000000000 as decimal(19,0)) a", "cast(9000000000000 as decimal(19,0)) * cast(7 as decimal(19,0)) b")
    assert got.select(phrases._floored(got["a"], got["b"])).first()[0] == int(a) // int(b)


def test_copies_share_chunks(spark):
    shared = " ".join(f"word{i * i % 97}" for i in range(400))
    rows = [("en", f"own {i} start. {shared} own end {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = phrases.dictionary(docs, every=8).collect()
    words = sum(len(p) for _, t in rows for p in pieces(t))
    assert sum(r["n"] * r["own"] for r in found) == words
    assert sum(r["own"] for r in found) < words / 5  # counted inside distinct chunks
    assert max(r["n"] for r in found) >= 50


def test_a_word_of_many_rows_and_no_rows(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).collect() == []
    docs = spark.createDataFrame([("en", "same same")] * 300 + [("en", None)], "lang string, text string")
    assert [tuple(r) for r in phrases.collocations(docs).collect()] == [("en", 1, "same same", 300, 600, 600, 600, 500)]
