"""Language ID, token files, line dedup and mixing on the test tables and on edge cases."""

import zlib

import numpy as np
import pytest
from tideline.llm import language_id, line_dedup, mixing, token_files
from tideline.llm.common import shared_dir, table
from tideline.llm.queries import tokenizer_path

EDGE = [(None, None, None, None), (9001, "", "en", "src1"), (9002, "123 ... !!", "en", None), (9003, "Wort " * 400_000, None, "src2"), (9001, "twice", "en", "src1"), (9001, "twice", "en", "src1")]
SCHEMA = "doc_id long, text string, lang string, source string"


def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).selectExpr("*", "'own' as score", "7 as n_dropped", "8 as size", "9 as copies")


def test_language_id_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and 20 < len(held) < len(got) / 2
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_edges(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").selectExpr("*", "'own' as score", "7 as n_dropped", "8 as size", "9 as copies").unionByName(edge(spark))
    model = language_id.fit(docs)
    found = {(r.doc_id, r.text): r for r in language_id.predict(edge(spark), model).collect()}
    assert found[(None, None)].lang_pred == found[(9001, "")].lang_pred == found[(9002, "123 ... !!")].lang_pred == "und"
    kept = language_id.accepted(edge(spark).unionByName(docs.where("doc_id < 100")))
    assert kept.columns == edge(spark).columns and kept.where("doc_id > 9000 and score = 'own'").count() == 3
    none = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(edge(spark), none).collect()} == {"und"}
    one = language_id.fit(docs.where("lang = 'de'"))
    assert {r.lang_pred for r in language_id.predict(edge(spark), one).collect()} == {"und", "de"}


@pytest.mark.parametrize("n", [2, 3, 4, 6, 12])
def test_codewords_differ(n):
    code = language_id.codewords(n)
    assert len({tuple(r) for r in code}) == n and all(abs(c.sum()) < n for c in code.T if n > 1)


def test_token_files_round_trip(spark, sf_dir):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    odd = ["a  b", "a\n\nb", " lead", "trail ", "tab\there", "x <|endoftext|> y", "don't we'll", " nb sp ", "naïve, Grüße! 123 4a5", "日本語 テキスト", "!", None, "", "\n", "a \nb", "é" * 5000]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame([(50_000 - k, t) for k, t in enumerate(odd)] + [(None, "no id"), (3, "again 3")], "doc_id long, text string"))
    out = shared_dir(spark)
    token_files.write(docs, out, path)
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in docs.collect()), key=lambda r: r[0])
    got = sorted(token_files.digests(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == [i for i, _ in rows]
    start, want = 0, set()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.add((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert {(r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got} == want
    assert token_files.encode_and_read(docs.limit(0), path).count() == 0


def test_token_files_by_shares_of_a_shard(spark, sf_dir):
    out = shared_dir(spark)
    token_files.write(table(spark, sf_dir, "documents").select("doc_id", "text"), out, tokenizer_path("byte_bpe_50k.json"))
    files = token_files.TokenFiles(out)
    for k in range(len(files.shards)):
        whole, parts = list(files.documents(k, 1 << 30)), list(files.documents(k, 100))
        assert len(whole) == 1 < len(parts)
        assert np.array_equal(np.concatenate([p[3] for p in parts]), whole[0][3]) and np.array_equal(np.concatenate([p[1] for p in parts]), whole[0][1])


def test_line_dedup(spark):
    pages = [(k, f"head\nline {k}\n\nfoot" if k % 2 else f"head\nline {k}", "a") for k in range(20)] + [(100, "head\nfoot", "b"), (101, None, None), (102, "", "a")]
    docs = spark.createDataFrame(pages, "doc_id long, text string, source string").selectExpr("*", "1 as n_dropped")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.report(docs, ratio=0.5).collect()}
    assert got[0] == ("line 0", 1) and got[1] == ("line 1\n\nfoot", 1) and got[100] == ("head\nfoot", 0) and got[101] == (None, 0) and got[102] == ("", 0)
    joined = line_dedup.drop_boilerplate(docs, "source", ratio=0.4, max_lines=1)
    assert {r.doc_id: (r.text, r.n_dropped) for r in joined.collect()}[1] == ("line 1\n", 2)
    assert line_dedup.report(docs.limit(0)).count() == 0


def test_line_dedup_of_many_lines(spark):
    """A null site, repeated rows, clashing names, lines on exactly the ratio: the same broadcast and joined."""
    rows = [(k, "\n".join(["menu", f"own {k}", " ", "menu", "half" if k % 2 else "other"]), site) for k in range(12) for site in ("a", "b", None)]
    docs = spark.createDataFrame(rows + rows + [(99, None, None), (None, "", "a")], "doc_id long, text string, source string")
    docs = docs.selectExpr("*", "1 AS site", "2 AS page_lines", "3 AS page_key")
    one, joined = (line_dedup.drop_boilerplate(docs, "source", ratio=0.47, max_lines=m) for m in (100, 2))
    assert one.columns == joined.columns == [*docs.columns, "n_dropped"] and one.dtypes == joined.dtypes
    assert sorted(map(str, one.collect())) == sorted(map(str, joined.collect()))
    got = {(r.doc_id, r.source): (r.text, r.n_dropped) for r in joined.collect()}
    assert got[3, "b"] == got[3, None] == ("own 3\n ", 3) and got[99, None] == (None, 0) and got[None, "a"] == ("", 0)
    exact = line_dedup.drop_boilerplate(docs.where("doc_id is not null and text is not null"), "source", ratio=0.5, max_lines=1)
    assert {r.n_dropped for r in exact.collect()} == {2}  # "half" and "other" are on just half of the pages


def test_mixing_meets_targets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source in ('src0', 'src1', 'src2', 'src3')").unionByName(spark.createDataFrame(EDGE, SCHEMA), allowMissingColumns=True)
    rows = mixing.report(docs).collect()
    again = mixing.report(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert all(r.taken <= 2 * r.size and r.taken == r.size * r.copies for r in rows)
    total = sum(r.size for r in rows)
    found = {}
    for r in rows:
        t = found.setdefault((r.source_size, r.target), [0, 0.0, 0])
        t[0] += r.taken
        t[1] += r.rate * r.size
        t[2] = max(t[2], r.size)
    assert abs(sum(t for _, t in found) - 1.5 * total) < 1e-6 * total
    for (size, target), (taken, expected, largest) in found.items():
        assert abs(expected - target) <= 1e-6 * target and abs(taken - target) <= max(largest, 0.001 * target)
    assert mixing.report(docs.limit(0)).count() == 0


def test_mixing_shares_and_copies(spark):
    level = lambda rows, total: mixing.water_level(spark.createDataFrame(rows, "tokens long, weight double"), total, 2)
    assert level([(10, 5.0), (10, 2.0), (10, 1.0)], 45.0) == pytest.approx(25 / 3)
    assert level([(0, 5.0), (0, 2.0)], 0.0) == 0
    docs = edge(spark)
    taken = mixing.mixed(docs)
    assert taken.columns == docs.columns
    n = sum(r.copies for r in mixing.report(docs).collect())
    assert taken.count() == n


def test_size_of(spark):
    df = spark.createDataFrame([("a b\tc\nd\x0be\x0cf\rg",), (" x y",), ("",), (None,), ("  ",)], "text string")
    assert [r[0] for r in df.select(mixing.size_of()).collect()] == [7, 2, 0, 0, 0]


def test_token_files_of_long_texts_least_ids_and_clashing_columns(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    least = -(1 << 63)
    rows = [(least, "least"), (None, "none"), (None, None), (5, "long words é " * 120_000), (6, "x" * 1_500_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as n_tokens", "3 as start")
    got = {(r.doc_id, r.n_tokens) for r in token_files.encode_and_read(docs, path).collect()}
    assert got == {(i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows}


def test_line_dedup_of_long_lines(spark):
    line = "long " * 400_000
    docs = spark.createDataFrame([(k, f"{line}\nown {k}", "s") for k in range(6)], "doc_id long, text string, source string")
    assert {(r.text, r.n_dropped) for r in line_dedup.report(docs).collect()} == {(f"own {k}", 1) for k in range(6)}
