"""Tables compared by digests, and lines searched by trigrams."""

import re

import pytest
from pyspark.sql import functions as F
from tideline.operators import hashtree, lineindex, logs, reconcile
from tideline.streaming.run import working_dir


@pytest.mark.parametrize("levels", [(12, 12), (2,), (1, 1, 1)])
def test_difference_equals_same_rows(spark, levels):
    a = spark.range(500).selectExpr("id % 90 a", "if(id % 7 = 0, null, string(id % 11)) b", "if(id % 7 = 0, string(id % 11), null) c", "cast(id % 5 as double) d")
    b = a.where("a % 13 <> 0").union(spark.createDataFrame([(1, None, "x", 0.0), (1, "x", None, 0.0), (None, None, None, None)], a.schema)).repartition(3)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(hashtree.tree_difference(a, b, levels)) == rows(reconcile.same_rows(a, b)) != []
    assert rows(hashtree.tree_difference(a, a.repartition(5), levels)) == []
    none = a.limit(0)
    assert rows(hashtree.tree_difference(a, none, levels)) == rows(reconcile.same_rows(a, none))
    assert rows(hashtree.tree_difference(none, none, levels)) == []


def test_a_row_more_is_a_difference(spark):
    a = spark.range(100).selectExpr("id % 3 x")
    assert [tuple(r) for r in hashtree.tree_difference(a.union(a.limit(1)), a).collect()] == [(a.first()[0], "first")]


def test_equal_tables_shuffle_digests_only(spark):
    wide = spark.range(20_000).select("id", F.repeat(F.lit("x"), 200).alias("text"))
    path = working_dir(spark, "wide")
    wide.write.parquet(path)
    a = spark.read.parquet(path)
    found = hashtree.tree_difference(a, spark.read.parquet(path), (4,))
    assert found.isEmpty()
    plan = hashtree.digests(a, 4)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and plan.count("Exchange") == 1
    assert hashtree.digests(a, 4).count() == 16


LINES = ["alpha beta", "Gamma gamma delta", "error: disk full", "ERROR 42 at node7", "", None, "naïve Über", "a.b*c", "tail end", "end", "foobarbaz", "foo--baz", "ab" * 300, "x" * 5000 + "needle", "日本語の行", "[[x]] &&", "abcabcabd", "tab\there"]
PATTERNS = [
    "error", "disk (full|empty)", "gamma|delta", "foo(bar|--)baz", "ab{2,}", "(abc)+abd", "^tail", "end$", r"node\d+", "needle", "日本語", "naïve", r"a\.b\*c", "(?:alpha|beta)+ b", "x?yz|tail", "[Ee]rror: d", "(?P<w>gam+a) g", "zzz", r"\bend\b", "(?i)ERROR",
    ".", "a*", "[[:alpha:]]x", r"\Qa.b\E", "ab|", "(a|b|c)d", r"\p{L}+ beta", "foo.*baz", "(x{3}){2}needle",
]


@pytest.fixture(scope="module")
def indexed(spark):
    rows = [(f"h{i % 3}", i % 3, i, x) for i, x in enumerate(LINES * 4)]
    df = spark.createDataFrame(rows, "host string, host_no int, line_no long, line string").repartition(4)
    path = working_dir(spark, "indexed")
    lineindex.build_index(df, path, lines_per_block=3)
    return df, path


@pytest.mark.parametrize("pattern", PATTERNS)
def test_search_equals_the_scan(spark, indexed, pattern):
    df, path = indexed
    try:
        want = sorted(logs.log_search(df, pattern).collect(), key=str)
    except ValueError:
        pytest.skip("not a pattern here")
    assert sorted(lineindex.indexed_search(spark, path, pattern).collect(), key=str) == want


@pytest.mark.parametrize("flags", [{"ignore_case": True}, {"invert": True}, {"count_only": True}, {"max_count": 2}, {"extended": False}])
def test_flags(spark, indexed, flags):
    df, path = indexed
    for pattern in ("error", "Gamma g", "ab+"):
        rows = lambda out: sorted(out.collect(), key=str)
        assert rows(lineindex.indexed_search(spark, path, pattern, **flags)) == rows(logs.log_search(df, pattern, **flags))


def test_blocks_without_the_trigrams_are_not_read(spark, indexed):
    _, path = indexed
    share = lambda p: tuple(lineindex.read_share(spark, path, p).first())
    blocks, read = share("zzz never there")
    assert blocks > 20 and read == 0
    assert 0 < share("disk full")[1] < blocks / 2
    assert share("a*") == (blocks, blocks)
    assert share("(?i)Disk Full") == share("disk full")


def test_many_blocks_are_one_file_and_its_pages_are_passed_over(spark):
    """Blocks aren't files, and the scan itself returns few lines."""
    path = working_dir(spark, "indexed")
    line = F.when(F.col("id") % 5000 == 1234, "a needle here").when(F.col("id") % 700 == 3, None).otherwise(F.concat(F.lit("LINE h\u00e9 "), "id"))
    df = spark.range(0, 20_000, 1, 2).select(F.lit("h").alias("host"), F.lit(1).alias("host_no"), F.col("id").alias("line_no"), line.alias("line"))
    lineindex.build_index(df, path, lines_per_block=20)
    assert len(spark.read.parquet(f"{path}/lines").inputFiles()) == 2
    assert tuple(lineindex.read_share(spark, path, "needle|hay stack").first()) == (1000, 4)
    found = lineindex.indexed_search(spark, path, "needle|hay stack")
    assert sorted(r.line_no for r in found.collect()) == [1234, 6234, 11234, 16234]
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert 4 <= scan.metrics().apply("numOutputRows").value() <= 400
    everywhere = lineindex.indexed_search(spark, path, "line h\u00e9 [0-9]*7$", ignore_case=True)  # more ranges of blocks than a scan gets
    assert everywhere.count() == df.where("line like '%7'").count()
    one = [(k * 20, 20, k % 2 == 0) for k in range(2000)]
    ranges = lineindex._ranges(spark.createDataFrame(one, "block long, lines long, may boolean"))
    assert len(ranges) == lineindex.RANGES and all(any(a <= b <= z for a, z in ranges) for b, _, may in one if may)


def test_what_patterns_need():
    need = lineindex.required
    assert need("Error: disk") == "error: disk"
    assert need("abc|xyz") == ("or", ["abc", "xyz"])
    assert need("(abc)+def") == ("and", ["abc", "abcdef"])
    assert need("ab.cde[0-9]+fgh") == ("and", ["cde", "fgh"])
    for nothing in ("ab", ".*", "abc|x", "(abc)?", "[[:alpha:]]]xyz", r"\Qabc\E", "(?s)abc", "(?iu)été", "(?-i)abc", r"\pLabc", "abc{", "[a-z&&[^b]]abc"):
        assert need(nothing) is True or nothing == "abc{"
    for pattern in ("the|then|there", "(foo|foobar)baz", "x(yz){2}w"):  # what matches has what is needed
        def holds(n, text):
            return n is True or (n in text if isinstance(n, str) else (all if n[0] == "and" else any)(holds(p, text) for p in n[1]))

        for text in ("the", "then", "there", "foobaz", "foobarbaz", "xyzyzw"):
            if re.search(pattern, text):
                assert holds(need(pattern), text)
