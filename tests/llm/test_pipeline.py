import sys
from pathlib import Path

import corpus_pipeline
from tideline.llm import mixing, token_files
from tideline.llm.common import Scratch, table
from tideline.llm.queries import ORACLE, QUERIES, tokenizer_path

sys.path.insert(0, str(Path(__file__).parent))
import test_decontaminate
import test_near_join


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_dedup", "decontaminate", "mix", "token_files"]
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14)) and set(ORACLE) <= set(QUERIES)


def test_pipeline_equals_brute_force(spark, sf_dir, tmp_path):
    """The table with some rows that each stage must drop, against plain Python."""
    docs = table(spark, sf_dir, "documents")
    first = docs.where("doc_id = 3").first().text
    extra = [(90_001, None, "en", "src1", 0), (90_002, "12 34 !!", None, None, 8), (90_003, first, "en", "src2", 1), (90_004, first.replace(" the ", " an ", 1), "en", "src3", 1)]
    both = docs.union(spark.createDataFrame(extra, docs.schema))
    both.write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, sf_dir, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))

    rows = [(r.doc_id, r.text) for r in both.collect() if r.text and any(c.isalpha() for c in r.text)]
    groups = test_near_join.brute_force(rows)
    rows = [(i, t) for i, t in rows if groups[i][0] == i]
    hits = test_decontaminate.brute_force(rows, [tuple(r) for r in table(spark, sf_dir, "benchmark").collect()])
    clean = sorted(i for i, _ in rows if not hits[i][4])
    assert 90_003 not in clean and len(clean) < both.count() - 10

    now, scratch = both, Scratch(spark)
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = scratch.saved(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns
    assert sorted(r.doc_id for r in now.collect()) == clean

    copies = {r.doc_id: r.copies for r in mixing.report(now).collect()}
    mixed = corpus_pipeline.STAGES[3][1](spark, now, str(tmp_path))
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in copies.items() if n}

    encoder = token_files.Encoder(tokenizer_path("byte_bpe_50k.json"))
    text = dict(rows)
    want = sorted((i, len(encoder.whole.encode(text[i], add_special_tokens=False).ids) + 1) for i, n in copies.items() for _ in range(n))
    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == want
    assert [r.start for r in got] == [sum(n for _, n in want[:k]) for k in range(len(want))]


def test_empty_documents(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, sf_dir, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
