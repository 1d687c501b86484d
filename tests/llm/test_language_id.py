"""Codewords, features and fitting of language ID."""

import numpy as np
import pytest
from tideline.llm import language_id


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 7, 8, 12, 20, 30])
def test_every_bit_splits_the_languages_its_own_way(n):
    code = language_id.codewords(n)
    assert code.shape[0] == n and len({tuple(r) for r in code}) == n
    assert all(abs(c.sum()) < n for c in code.T)
    assert len({tuple(c * c[0]) for c in code.T}) == code.shape[1]
    if n <= 6:
        assert code.shape[1] == 2 ** (n - 1) - 1


def counted(text):
    """The features by a plain loop."""
    raw = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode())
    raw = b" " + b" ".join(raw.split()) + b" "
    out = np.zeros(language_id.DIM)
    for k, n in enumerate((2, 3, 4)):
        for i in range(len(raw) - n + 1):
            h = 0
            for c in raw[i : i + n]:
                h = (h * 0x1F1 + c) % 2**32
            out[(h + k * 0x51ED27) * 0x9E3779B1 % 2**32 >> 32 - language_id.DIM_BITS] += 1
    out = np.sqrt(out)
    return out / np.linalg.norm(out)


@pytest.mark.parametrize("piece", [1 << 20, 7, 3])
def test_every_ngram_counts_once(monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    for text in ("Ein kurzer Satz, größer als 3 Stücke!", "a", "é"):
        assert np.allclose(language_id.features(text), counted(text), atol=1e-6)
    assert not language_id.features("").any() and not language_id.features("12 ?").any()


WORDS = {"aa": "the cat sat on that mat with those hats", "bb": "der hund und die katze ruhen unter dem tisch", "cc": "les chats et les chiens dorment sous une table"}


def rows(languages, n):
    rng = np.random.default_rng(5)
    return [(" ".join(rng.permutation(WORDS[lang].split())), lang) for lang in languages for _ in range(n)]


@pytest.mark.parametrize("languages", [("aa", "bb"), ("aa", "bb", "cc")])
def test_few_languages_are_told_apart(spark, languages):
    model = language_id.fit(spark.createDataFrame(rows(languages, 20), "text string, lang string"))
    found = model.predict([WORDS[lang] for lang in languages])
    assert [f[0] for f in found] == list(languages) and all(f[1] > 0.5 for f in found)


def test_most_frequent_labels_are_learned(spark):
    given = rows(("aa",), 9) + rows(("bb",), 8) + rows(("cc",), 3) + [("x y z", None), (None, "aa")]
    model = language_id.fit(spark.createDataFrame(given, "text string, lang string"), max_languages=2)
    assert model.languages == ["aa", "bb"]


def test_identify_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    found = language_id.identify(empty)
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and found.collect() == []
