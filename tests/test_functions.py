import csv
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tideline.functions import csvline, patterns
from tideline.functions.ring import ring_id, ring_number

# line, fields, first three
CASES = [
    ("a,b,c", ["a", "b", "c"], "a,b,c"),
    ('one,"two, with comma",three', ["one", "two, with comma", "three"], 'one,"two, with comma",three'),
    ("a,,c", ["a", "", "c"], "a,,c"),
    ("a,b,", ["a", "b", ""], "a,b,"),
    ("solo", ["solo"], "solo"),
    ("", [""], ""),
    ('"hello",world', ["hello", "world"], '"hello",world'),
    (",mid,", ["", "mid", ""], ",mid,"),
    ('1,"a, b",c,d', ["1", "a, b", "c", "d"], '1,"a, b",c'),
    ('"open,q,r,s', ["open,q,r,s"], '"open,q,r,s'),
    ('"""123,456""",z', ["123,456", "z"], '"""123,456""",z'),
]


def toggle(line):
    out, field, quoted = [], "", False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            out.append(field)
            field = ""
        else:
            field += c
    return out + [field]


def test_csv_cases(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "v string")
    got = df.select(csvline.csv_fields("v").alias("f"), csvline.first_fields("v").alias("t")).collect()
    assert [r.f for r in got] == [c[1] for c in CASES] == [toggle(c[0]) for c in CASES]
    assert [r.t for r in got] == [c[2] for c in CASES]


def test_rfc4180_like_the_csv_module(spark):
    lines = ["a,b", 'a,"b,c",d', '"a""b",c', '""', "", ",", '"a" tail,b', '"open, to the end', 'x,"y",', '"",""', 'a"b,c']
    got = spark.createDataFrame([(x,) for x in lines], "v string").select(csvline.csv_fields("v", "rfc4180").alias("f")).collect()
    assert [r.f for r in got] == [next(csv.reader([x]), [""]) or [""] for x in lines]
    three = spark.createDataFrame([('1,"a, b",c,d',), ("a,b",)], "v string").select(csvline.first_fields("v", 3, "rfc4180").alias("t")).collect()
    assert [r.t for r in three] == ["1,a, b,c", "a,b"]


def test_long_line(spark):
    line = '"' + "x," * 800_000 + '",tail'
    got = spark.createDataFrame([(line,)], "v string").select(csvline.field("v", 2).alias("k"), csvline.first_fields("v").alias("t")).first()
    assert got.k == "tail" and got.t == line


def test_fields_by_number(spark):
    df = spark.createDataFrame([('1,Streetlight,"Type, X",extra',)], "v string")
    row = df.select(csvline.field("v", 3).alias("a"), csvline.field("v", 9).alias("b"), csvline.field("v", 0, base=0).alias("c")).first()
    assert tuple(row) == ("Type, X", "", "1")
    with pytest.raises(ValueError):
        csvline.field("v", 0)


def test_counts(spark):
    df = spark.createDataFrame([("a,b", 3), ("", 1)], "k string, n long").select(csvline.format_count("k", "n").alias("v"))
    key, n = csvline.parse_count("v")
    assert [tuple(r) for r in df.select(key, n).collect()] == [("a,b", 3), ("", 1)]
    odd = spark.createDataFrame([("nocomma",), ("a,x",)], "v string").select(n.alias("n")).collect()
    assert [r.n for r in odd] == [None, None]


def test_ring_ids(spark):
    df = spark.createDataFrame([("node-1",), ("é",)], "s string").select("s", ring_id("s").alias("a"), ring_id("s", "sha1").alias("b"), ring_number(ring_id("s")).alias("n"))
    for r in df.collect():
        digest = hashlib.sha256(r.s.encode()).hexdigest()[:16]
        assert r.a == digest and r.b == hashlib.sha1(r.s.encode()).hexdigest()[:16] and int(r.n) == int(digest, 16)


def test_patterns(spark):
    assert patterns.linear_pattern("(?P<x>a)b") == "(?<x>a)b"
    for bad in ("", "(?=a)", "(?<!a)b", r"(a)\1"):
        with pytest.raises(ValueError):
            patterns.linear_pattern(bad)
    with pytest.raises(ValueError):
        patterns.checked(spark, "(")
    for basic, text, found in [("a+", "a+", True), ("a+", "aa", False), (r"a\+", "aa", True), (r"\(ab\)\{2\}", "abab", True), ("a|b", "b", False), ("[+]", "+", True), ("*a", "*a", True), ("x{2}", "x{2}", True), (r"a\.b", "axb", False)]:
        assert bool(re.search(patterns.basic_pattern(basic), text)) == found, basic


def test_column_types(spark):
    df = spark.createDataFrame([("a",)], "v string").select(F.col("v"), csvline.field("v", 1).alias("f"))
    assert dict(df.dtypes) == {"v": "string", "f": "string"}
