"""Cross-tokenizer alignment against whole-text encodings and plain counting."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tideline.llm import alignment
from tideline.llm.common import table
from tideline.llm.queries import QUERIES

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    "", None, "a", "  a", "a  b ", "a \n b", "\n\nx", "word's don't I'll", "x▁y", "日本語 text", "1234 12ab_cd", "<|endoftext|> <s> </s>", "a\tb \t c", "é café,", "don't. \nNext",
    "…“quoted”—dash", "ends with space ", "\x00 \x1c a \x1f b", "a b  c", "naïve.Über,ß!", "!!! ??? a,b;c", "a" * 3000, "\n", " ", "' s 's", "x'\n'y", "<0x41> [UNK]", "🙂🙂 a🙂", "  \n\n  \n x\n", "a\r\nb\r\n c", "é, á",
]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


@pytest.fixture(scope="module")
def whole(aligner):
    """Tokens of a whole text at once, and everything that follows from them, plainly."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True

    def run(text):
        a = first.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        parts_a, parts_b = [aligner.a_bytes[i] for i in a], [aligner.b_bytes[i] for i in b]
        if not text or b"".join(parts_a) != f" {text}".encode() or b"".join(parts_b) != f" {text}".encode():
            return 0, 0, 0, "", []
        of_a, of_b = ([i for i, p in enumerate(parts) for _ in p] for parts in (parts_a, parts_b))  # the token of each byte
        links = sorted(set(zip(of_a, of_b)))
        cuts = [k + 1 for k in range(len(of_a)) if of_a[k : k + 2] in ([of_a[k]], [of_a[k], of_a[k] + 1]) and of_b[k : k + 2] in ([of_b[k]], [of_b[k], of_b[k] + 1])]
        groups, at = [], (0, 0)
        for c in cuts:
            end = of_a[c - 1] + 1, of_b[c - 1] + 1
            groups.append("|".join(",".join(map(str, ids[s:e])) for ids, s, e in zip((a, b), at, end)))
            at = end
        return len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), sorted((a[i], b[j]) for i, j in links)

    return run


def same(aligner, whole, text):
    *numbers, pairs = aligner.align(text)
    assert (*numbers, sorted((int(p) >> aligner.shift, int(p) & (1 << aligner.shift) - 1) for p in pairs)) == whole(text), repr(text)[:80]


def test_units_give_what_whole_texts_give(spark, sf_dir, aligner, whole):
    for text in ODD + [r["text"] for r in table(spark, sf_dir, "documents").collect()]:
        same(aligner, whole, text)
    clean = [t for t in ODD if t and "▁" not in t]
    for joint in (" ", "\n", ""):
        same(aligner, whole, joint.join(clean))


def test_long_texts_and_forgotten_units(whole):
    small = alignment.Aligner(A, B, remembered=3)
    same(small, whole, "one two, three. " * 30_000 + "\nlast")


def test_a_unit_of_megabytes(aligner):
    text = "ab-" * 400_000
    n_a, n_b, n_groups, _, pairs = aligner.align(text + " tail")
    part = aligner.align("ab-" * 1000 + " tail")
    assert n_a > 400_000 and len(pairs) >= max(n_a, n_b) and n_groups > part[2]


def test_merge_of_runs():
    rng = np.random.default_rng(4)
    runs = []
    for _ in range(9):
        pair = np.unique(rng.integers(0, 40, 60).astype(np.uint32) << 15 | rng.integers(0, 6, 60).astype(np.uint32))
        runs.append((pair, rng.integers(1, 9, len(pair)).astype(np.uint32)))
    runs.append((np.zeros(0, np.uint32), np.zeros(0, np.uint32)))
    total = Counter()
    for pair, n in runs:
        total.update(dict(zip(pair.tolist(), n.tolist())))
    most = {a: max(v for p, v in total.items() if p >> 15 == a) for a in {p >> 15 for p in total}}
    for (pair, _), reply in zip(runs, alignment.merge_runs(runs, 15)):
        assert [int(r) for r in reply] == [2 * total[p] + (total[p] == most[p >> 15]) for p in pair.tolist()]


def counted(texts, whole):
    found = [whole(t) for t in texts]
    count = Counter(p for f in found for p in set(f[4]))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    return [(*f[:3], len(f[4]), sum(count[p] == most[p[0]] for p in f[4]), sum(count[p] for p in f[4]), f[3]) for f in found]


@pytest.mark.parametrize("more", [{}, {"most": 50, "parts": 4}])
def test_counts(spark, whole, more):
    texts = ODD + ["the same text, twice"] * 2 + ["short"] * 60 + ["hot words " * 40]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, run string, part int").repartition(3)
    out = sorted((tuple(r) for r in alignment.align(docs, A, B, **more).collect()), key=str)
    assert out == sorted(((i, *c) for (i, _), c in zip(rows, counted(texts, whole))), key=str)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_query_over_the_whole_table(spark, sf_dir, whole):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    found = QUERIES["op13_alignment"](spark, sf_dir)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = sorted((i, *c) for (i, _), c in zip(rows, counted([t for _, t in rows], whole)))
    assert sorted(tuple(r) for r in found.collect()) == want
