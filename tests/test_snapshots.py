"""Versions of tables, and what is built on them: merging in batches."""

import threading

import pytest
from pyspark.sql import functions as F
from tideline.operators import appendlog, mergedlog
from tideline.sources.snapshots import Snapshots, read_snapshot
from tideline.streaming.run import working_dir


def test_a_reader_never_fails_while_batches_come(spark):
    table, seen, failed, over = Snapshots(spark, working_dir(spark, "versions"), keep=5), [], [], threading.Event()
    table.commit(0, replace={"rows": spark.range(0, 50, 1, 2)})

    def read():
        while not over.is_set():
            try:
                ids = [r["id"] for r in table.read().collect()]
                seen.append(ids[0] // 50)
                assert len(ids) == 50 and min(ids) % 50 == 0 and max(ids) - min(ids) == 49
            except BaseException as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for batch in range(1, 21):
        assert table.commit(batch, replace={"rows": spark.range(50 * batch, 50 * batch + 50, 1, 2)})
    over.set()
    reader.join()
    assert not failed and len(seen) > 3 and seen == sorted(seen)
    assert len(table.batches()) == 5
    assert table.version()["batch"] == 20


def test_a_batch_that_is_tried_again_counts_once(spark):
    table = Snapshots(spark, working_dir(spark, "versions"))
    assert table.read() is None and table.version() is None
    for batch in (0, 1, 1, 0, 2):
        table.commit(batch, append={"rows": spark.range(batch * 10, batch * 10 + 3)})
    assert sorted(r["id"] for r in read_snapshot(spark, table.path).collect()) == [0, 1, 2, 10, 11, 12, 20, 21, 22]
    # two attempts at one batch that know nothing of each other: one pointer
    assert table._point(3, table.version() | {"batch": 3}) and not table._point(3, {"batch": 3, "tables": {}})
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, table.path, "other")


BLOCKS = [(f, c, s, f"{f}{c}{s}", n) for f in ("x", "y") for c in ("a", "b", "c") for s in range(1, 8) for n in ("n1", "n2", "n3") if (s + len(n) + ord(c) + ord(n[1])) % 3]


@pytest.mark.parametrize("max_group", [1_000_000, 4])
def test_three_batches_equal_one_merge(spark, max_group):
    rows = spark.createDataFrame(BLOCKS, "file string, client string, seq long, content string, node string")
    path = working_dir(spark, "log")
    deal = lambda k: (F.col("seq") + (F.col("node") == "n3").cast("int")) % 3 == k
    waiting = []
    for k in range(3):
        assert mergedlog.merge_batch(rows.where(deal(k)), path, k, max_group)
        waiting.append(mergedlog.held_blocks(spark, path).count())
        assert not mergedlog.merge_batch(rows, path, k, max_group)  # tried again
    assert waiting[0] > 0 == waiting[-1]
    want = appendlog.merge_replicas(rows.drop("node"))
    assert sorted(map(tuple, mergedlog.merged_blocks(spark, path).collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, mergedlog.version_vector(spark, path).collect())) == [(f, c, 7) for f in ("x", "y") for c in ("a", "b", "c")]


def test_gaps_are_held_and_later_conflicts_shown(spark):
    make = lambda rows: spark.createDataFrame(rows, "file string, client string, seq long, content string")
    path = working_dir(spark, "log")
    mergedlog.merge_batch(make([("f", "a", 1, "one"), ("f", "a", 3, "three"), ("f", "b", 2, "late")]), path, 0)
    assert [tuple(r) for r in mergedlog.merged_blocks(spark, path).collect()] == [("f", 1, "a", 1, "one", 1, False)]
    assert sorted(map(tuple, mergedlog.held_blocks(spark, path).collect())) == [("f", "a", 3), ("f", "b", 2)]
    mergedlog.merge_batch(make([("f", "a", 2, "two"), ("f", "a", 1, "other"), ("f", "a", 3, "three")]), path, 1)
    assert sorted(map(tuple, mergedlog.merged_blocks(spark, path).collect())) == [("f", 1, "a", 1, "one", 2, True), ("f", 2, "a", 2, "two", 1, False), ("f", 3, "a", 3, "three", 2, False)]
    mergedlog.merge_batch(make([("f", "b", 1, "first")]), path, 2)
    assert [(r["block"], r["client"], r["seq"]) for r in mergedlog.merged_blocks(spark, path).orderBy("block").collect()] == [(1, "a", 1), (2, "a", 2), (3, "a", 3), (4, "b", 1), (5, "b", 2)]


def test_a_batch_doesnt_read_the_log(spark, monkeypatch):
    make = lambda lo, hi: spark.range(lo, hi).selectExpr("'f' file", "'a' client", "id seq", "string(id) content")
    path, read = working_dir(spark, "log"), []
    mergedlog.merge_batch(make(1, 50), path, 0)
    plain = Snapshots.read
    monkeypatch.setattr(Snapshots, "read", lambda self, name="rows", version=None: (read.append(name), plain(self, name, version))[1])
    mergedlog.merge_batch(make(50, 60), path, 1)
    assert set(read) == {"vector", "held"}
