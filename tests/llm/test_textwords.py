import numpy as np
import pyarrow as pa
from tideline.llm import decontaminate, lm_scoring, near_join, textwords


def words_of(texts):
    data, _, starts, ends, hashes, first = textwords.words(pa.array(texts, pa.string()))
    spelled = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    return [spelled[first[i] : first[i + 1]] for i in range(len(texts))], hashes


def test_empty_rows_between_words():
    for gap in ([None], [""], [None, "", None]):
        got, hashes = words_of(["abc", *gap, "def ghi", *gap, "jkl"])
        assert got == [["abc"], *[[] for _ in gap], ["def", "ghi"], *[[] for _ in gap], ["jkl"]]
        assert np.array_equal(hashes, words_of(["abc def ghi jkl"])[1])


def test_empty_rows_leave_the_operators_alone(spark):
    rows = [(1, "one two three four five"), (2, None), (3, "one two three four five"), (4, ""), (5, "else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, "zz yy")], "item_id long, text string")
    want = {1: 5, 2: 0, 3: 5, 4: 0, 5: 1}
    assert {r.doc_id: r.n_words for r in decontaminate.report(docs, bench).collect()} == want
    assert {r.doc_id: r.n_words for r in lm_scoring.fit_and_score(docs).collect()} == want
    groups = {}
    for r in near_join.near_join(docs).collect():
        groups[r[0]] = tuple(r)[1:]
    assert groups[1] == groups[3]
