import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from tideline.llm import decontaminate
from tideline.llm.bloom import Bloom
from tideline.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, n=10):
    out = {}
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for k in range(len(w) - size + 1) if w else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    ids |= found
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def test_equals_brute_force_in_one_block_and_joined(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    long = "word " * 300_000 + "Größe zwei 3 vier fünf sechs sieben acht neun zehn elf"
    docs = docs.union(spark.createDataFrame([(9001, None), (9002, ""), (9003, "x" * 3_000_000), (9004, long), (9005, "only THREE words"), (9006, "say only three words!")], docs.schema))
    items = items.union(spark.createDataFrame([(7001, "Only three, words"), (7002, None), (7003, " "), (7004, "größe zwei 3 vier fünf sechs sieben acht neun zehn")], items.schema))
    expected = brute_force([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert sum(v[4] for v in expected.values()) > 5
    got = {r[0]: tuple(r[1:]) for r in decontaminate.report(docs, items).collect()}
    assert got == expected
    twice = docs.withColumn("digest", F.lit(1)).union(docs.withColumn("digest", F.lit(1)))
    joined = decontaminate.scan(twice, items, max_windows=400)
    assert joined.columns == ["doc_id", "text", "digest", "n_words", "hit_words", "items"]
    one = decontaminate.scan(twice, items)
    assert sorted(map(tuple, joined.drop("text").collect()), key=str) == sorted(map(tuple, one.drop("text").collect()), key=str)
    assert joined.dtypes == one.dtypes and joined.count() == 2 * len(expected)


def test_spans_are_cut_for_any_number_of_windows(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    one, joined = (decontaminate.remove_spans(docs, items, max_windows=m) for m in (200_000, 5))
    assert sorted(map(str, one.collect())) == sorted(map(str, joined.collect()))


def test_bloom_filter(spark):
    rows = spark.range(20_000).selectExpr("xxhash64(id) AS hash")
    bloom = Bloom(rows, 20_000)
    assert bloom.holds(np.array([r[0] for r in rows.collect()], np.int64).astype(np.uint64)).all()
    others = np.array([r[0] for r in spark.range(20_000, 220_000).selectExpr("xxhash64(id) AS hash").collect()], np.int64).astype(np.uint64)
    assert bloom.holds(others).mean() < 1e-3 and len(bloom.holds(others[:0])) == 0
    assert not Bloom(rows.limit(0), 0).holds(others).any()


def test_removal(spark):
    bench = spark.createDataFrame([(1, " ".join("abcdefghijkl")), (None, "zz yy"), (1, "zz yy")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Keep this. A b c d e f g h i j k l! And this.", 5), (2, "clean", None), (3, "zz zz yy yy", 1), (None, None, 1)], "doc_id long, text string, n_words int")
    kept = decontaminate.remove_documents(docs, bench)
    assert kept.columns == docs.columns and sorted((tuple(r) for r in kept.collect()), key=str) == [(2, "clean", None), (None, None, 1)]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert cut[1] == "Keep this. ! And this." and cut[2] == "clean" and cut[3].strip() == ""
    empty = docs.limit(0)
    assert decontaminate.report(empty, bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
