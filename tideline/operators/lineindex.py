"""Search over saved lines by an index of character trigrams.

Lines are saved with the number of their block, ``lines_per_block`` of one task's lines in order, and with
pages of as many lines. The index has a bitmap of every block's trigrams (of UTF-8 bytes, A-Z lower-cased), 8 KB a
block for 65,536 bits. What a pattern's matches must hold is derived from it (runs of literals, any of several
branches), and the scan is given ranges of blocks that have it: Parquet's page index keeps it off the pages of all
others. A pattern of which nothing follows, and an inverted search, read all blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import patterns
from tideline.operators.logs import log_search

LINES_PER_BLOCK, SLOTS, SLOT = 10_000, 2, 32768
#: Ranges of blocks that one scan is given; where there are more, the nearest are read as one.
RANGES = 256
#: Bytes that are hashed at a time.
PIECE = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Constructs that the two dialects read differently: nested classes, flags other than i, quotations, \b{..}
_DOUBTFUL = re.compile(r"(?s)(?:^|[^\\])(?:\\\\)*\[(?:[^\]\\]|\\.)*\[|&&|\(\?[a-zA-Z]*[a-hj-zA-Z-][a-zA-Z-]*[:)]|\\[QEGRXhHvVpPkbB]\{|\\[QEGRXhHpPk]|\\0")


def required(pattern: str):
    """What every match holds: True (nothing known), a string of 3 or more characters, or ('and' | 'or', parts)."""
    if _DOUBTFUL.search(re.sub(r"\(\?P<\w+>", "(", pattern)):
        return True
    try:
        tree = parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return True
    return _of(tree)


def _all(parts: list):
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _literal(tree) -> str | None:
    """The one string that a part of a pattern matches, if it is that simple."""
    out = []
    for kind, value in tree:
        if kind is op.LITERAL:
            out.append(chr(value))
        elif kind is op.SUBPATTERN and (inner := _literal(value[3])) is not None:
            out.append(inner)
        elif kind is not op.AT:
            return None
    return "".join(out)


def _of(tree):
    parts, run = [], []

    def end():
        text = "".join(run).translate(str.maketrans(_UPPER, _LOWER))
        parts.append(text if len(text) >= 3 else True)
        run.clear()

    for kind, value in tree:
        if kind is op.LITERAL:
            run.append(chr(value))
        elif kind is op.AT:  # takes no characters
            continue
        elif kind is op.SUBPATTERN:
            if (text := _literal(value[3])) is not None:
                run.append(text)
            else:
                end()
                parts.append(_of(value[3]))
        elif kind is op.BRANCH:
            end()
            ways = [_of(w) for w in value[1]]
            parts.append(True if True in ways else ("or", ways))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, _, inner = value
            if least and (text := _literal(inner)) is not None:
                run.append(text)  # its first time follows what is before, its last comes before what follows
                end()
                run.append(text)
            else:
                end()
                parts.append(_of(inner) if least else True)
        else:
            end()
    end()
    return _all(parts)


def _slots(data: np.ndarray, slots: int) -> np.ndarray:
    """The places of the trigrams of UTF-8 bytes in the bitmaps of a block, one after the other."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    hashed = (low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(2654435761)
    return (hashed.astype(np.uint64) * np.uint64(slots * SLOT) >> np.uint64(32)).astype(np.int64)


def _holds(need, slots: int) -> Column:
    """Whether a block's bitmaps bits_0, bits_1, .. have all trigrams that are needed."""
    if isinstance(need, tuple):
        conditions = [_holds(n, slots) for n in need[1]]
        out = conditions[0]
        for c in conditions[1:]:
            out = out & c if need[0] == "and" else out | c
        return out
    places = set()
    for text in re.split("[\ufffd\ud800-\udfff]", need):  # what a line shows there can be other bytes
        places |= set(_slots(np.frombuffer(text.encode(), np.uint8), slots).tolist())
    out = F.lit(True)
    for at in sorted(places):
        k, place = divmod(at, SLOT)
        byte = F.conv(F.hex(F.substring(f"bits_{k}", place // 8 + 1, 1)), 16, 10).cast("int")
        out = out & (F.call_function("getbit", byte, F.lit(place % 8)) == 1)
    return out


def _bitmaps(slots: int):
    """(block, bits_0, ..) of runs of lines of one block; a block that two tasks read has a row from each."""

    def mark(bits: np.ndarray, data: np.ndarray, ends: np.ndarray) -> None:
        """Add the trigrams of lines that end at ``ends`` of their bytes; the last place takes those across lines."""
        for at in range(0, max(0, len(data) - 2), PIECE):
            found = _slots(data[at : at + PIECE + 2], slots)
            across = np.concatenate([ends - 2, ends - 1]) - at
            found[across[(across >= 0) & (across < len(found))]] = slots * SLOT
            bits[found] = True

    def row(block: int, bits: np.ndarray) -> pa.RecordBatch:
        packed = np.packbits(bits[: slots * SLOT], bitorder="little").reshape(slots, SLOT // 8)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in packed]], names=["block", *[f"bits_{k}" for k in range(slots)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, bits = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks, text = batch.column(0).to_numpy(), batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            begins = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]])
            for first, last in zip(begins[:-1], begins[1:]):
                if blocks[first] != block:
                    if block is not None:
                        yield row(block, bits)
                    block, bits = int(blocks[first]), np.zeros(slots * SLOT + 1, bool)
                a, b = offsets[first], offsets[last]
                mark(bits, data[a:b], offsets[first + 1 : last + 1] - a)
        if block is not None:
            yield row(block, bits)

    return run


def build_index(logs: DataFrame, path: str, lines_per_block: int = LINES_PER_BLOCK, slots: int = SLOTS) -> None:
    """Save logs(host, host_no, line_no, line) at ``path``/lines, and the index of their blocks at ``path``/index."""
    at = F.monotonically_increasing_id()  # the task and, in 33 bits, the line within it
    logs.withColumn("_block", at - F.pmod(at.bitwiseAND(F.lit((1 << 33) - 1)), F.lit(lines_per_block))).write.option("parquet.page.row.count.limit", lines_per_block).parquet(f"{path}/lines")
    saved = logs.sparkSession.read.parquet(f"{path}/lines").select("_block", F.coalesce("line", F.lit("")).cast("binary").alias("line"))
    names = [f"bits_{k}" for k in range(slots)]
    one = saved.mapInArrow(_bitmaps(slots), "block long, " + ", ".join(f"{x} binary" for x in names))
    each = [F.call_function("bitmap_or_agg", F.col(x)).alias(x) for x in names]
    one.groupBy("block").agg(*each).withColumn("lines", F.lit(lines_per_block).cast("long")).write.parquet(f"{path}/index")


def blocks_to_read(spark: SparkSession, path: str, need) -> DataFrame:
    """(block, lines, may): every block, how many lines one has at most, and whether it may hold what is needed."""
    index = spark.read.parquet(f"{path}/index")
    slots = len(index.columns) - 2
    return index.select("block", "lines", (F.lit(True) if need is True else _holds(need, slots)).alias("may"))


def _ranges(blocks: DataFrame) -> list[tuple[int, int]]:
    """At most ``RANGES`` ranges (first, last) of blocks that cover all that may match."""
    found = blocks.where("may").withColumn("task", F.expr("shiftright(block, 33)"))
    run = F.col("block") - F.col("lines") * F.row_number().over(Window.partitionBy("task").orderBy("block"))
    runs = found.withColumn("run", run).groupBy("task", "run").agg(F.min("block").alias("first"), F.max("block").alias("last")).select("first", "last").toArrow()  # two numbers a run
    first, last = (np.sort(runs.column(c).to_numpy()) for c in ("first", "last"))
    gaps = first[1:] - last[:-1]
    cut = np.sort(np.argsort(-gaps, kind="stable")[: RANGES - 1])
    return list(zip(first[[0, *(cut + 1)]].tolist(), last[[*cut, -1]].tolist())) if len(first) else []


def _any(conditions: list[Column]) -> Column:
    """Any of them, as a tree that isn't deep."""
    if len(conditions) == 1:
        return conditions[0]
    half = len(conditions) // 2
    return _any(conditions[:half]) | _any(conditions[half:])


def indexed_search(spark: SparkSession, path: str, pattern: str, extended: bool = True, invert: bool = False, **flags) -> DataFrame:
    """``log_search`` over the lines saved at ``path``, reading only blocks that may match, and those between near ones."""
    plain = pattern if extended else patterns.basic_pattern(pattern)
    need, logs = True if invert else required(plain), spark.read.parquet(f"{path}/lines")
    if need is not True:
        ranges = _ranges(blocks_to_read(spark, path, need))
        logs = logs.where(_any([F.col("_block").between(a, b) for a, b in ranges])) if ranges else logs.limit(0)
    return log_search(logs.drop("_block"), pattern, extended=extended, invert=invert, **flags)


def read_share(spark: SparkSession, path: str, pattern: str, extended: bool = True) -> DataFrame:
    """One row: blocks, and blocks_read by a search for the pattern."""
    found = blocks_to_read(spark, path, required(pattern if extended else patterns.basic_pattern(pattern)))
    return found.agg(F.count(F.lit(1)).alias("blocks"), F.count_if("may").alias("blocks_read"))
