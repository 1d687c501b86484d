"""Operators of one's own with a state a key, which no key's rows have to meet for."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Keys whose states a task holds before it hands them on.
HELD = 100_000


def keyed_states(lines: DataFrame, zero: Callable[[], Any], add: Callable[[Any, dict], Any], merge: Callable[[Any, Any], Any], finish: Callable[[str, Any], Iterable[tuple]], schema: str | StructType, held: int = HELD) -> DataFrame:
    """What ``finish(key, state)`` gives for each key of lines.

    Every task adds its own rows to a state a key (``zero``, then ``add(state, row)``), and only states
    move: they are merged in two rounds, first in about as many groups a key as the square root of the tasks,
    so that a key with most rows is many tasks in both. ``merge`` must not care for order or grouping.
    """
    key_type = dict(lines.dtypes)["key"]
    groups = max(1, round(lines.rdd.getNumPartitions() ** 0.5))
    pair = pa.schema({"key": lines.select("key").limit(0).toArrow().schema.field("key").type, "state": pa.binary()})

    def packed(states):
        return pa.RecordBatch.from_arrays([pa.array(list(states), pair.field("key").type), pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], schema=pair)

    def collect(batches):
        states: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                key = row["key"]
                states[key] = add(states[key] if key in states else zero(), row)
            if len(states) >= held:
                yield packed(states)
                states = {}
        yield packed(states)

    def merged(batches):
        """(key, state) of rows that come sorted by key; one state is held at a time."""
        last, state, some = None, None, False
        for batch in batches:
            for key, data in zip(batch.column("key").to_pylist(), batch.column("state").to_pylist()):
                own = pickle.loads(data)
                if some and key == last:
                    state = merge(state, own)
                else:
                    if some:
                        yield last, state
                    last, state, some = key, own, True
        if some:
            yield last, state

    def merge_round(batches):
        states: dict = {}
        for key, state in merged(batches):
            states[key] = state
            if len(states) >= held:
                yield packed(states)
                states = {}
        yield packed(states)

    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(wanted)

    def finished(batches):
        rows: list[dict] = []
        for key, state in merged(batches):
            rows += [dict(zip(fields.names, r)) for r in finish(key, state)]
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema=fields)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=fields)

    states = lines.mapInArrow(collect, f"key {key_type}, state binary")
    if groups > 1:
        dealt = states.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(groups))).repartition("key", "_group").sortWithinPartitions("key", "_group")
        states = dealt.select("key", "state").mapInArrow(merge_round, f"key {key_type}, state binary")
    return states.repartition("key").sortWithinPartitions("key").mapInArrow(finished, wanted)


def register_state_op(name: str, zero, add, merge, finish, schema: str = "key string, value string, id string") -> None:
    """A stage from a mergeable state a key, for keys of any size (``register_keyed_op`` gathers a key's lines)."""
    from tideline.plans.pipeline import register_op

    register_op(name, lambda: lambda lines: keyed_states(lines, zero, add, merge, finish, schema))
