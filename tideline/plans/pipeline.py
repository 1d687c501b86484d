"""Jobs as a source, one to three named stages, and a sink; the same for tables and streams."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tideline.operators import lines as ops

_REGISTRY: dict[str, Callable[..., ops.Op]] = {
    "identity": ops.identity,
    "echo": ops.echo,
    "grep": ops.grep,
    "filter": ops.grep,
    "contains": ops.contains,
    "key_by": ops.key_by,
    "transform": ops.transform,
    "count": ops.count,
    "dedup": ops.dedup,
    "repartition": ops.repartition,
}


def register_op(name: str, factory: Callable[..., ops.Op]) -> None:
    """Make ``factory(**args) -> (DataFrame -> DataFrame)`` a stage of that name."""
    _REGISTRY[name] = factory


def register_row_op(name: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str = "key string, value string, id string") -> None:
    """A stage from a function over batches of lines that returns any number of rows for each."""

    def factory() -> ops.Op:
        def run(lines: DataFrame) -> DataFrame:
            def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    yield fn(batch)

            return lines.mapInPandas(each, schema)

        return run

    register_op(name, factory)


def register_keyed_op(name: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str = "key string, value string, id string") -> None:
    """A stage from a function over all lines of a key, for state that is flushed at the end.

    A key's lines meet in one task; use SQL aggregates where keys are unbounded.
    """
    register_op(name, lambda: lambda lines: lines.groupBy("key").applyInPandas(fn, schema))


def operation(name: str, *args, **kwargs) -> ops.Op:
    """A registered operator with its arguments, positional or by name, checked against what it takes."""
    if name not in _REGISTRY:
        raise ValueError(f"unknown operator {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    try:
        inspect.signature(_REGISTRY[name]).bind(*args, **kwargs)
    except TypeError as e:
        raise ValueError(f"{name}: {e}") from e
    return _REGISTRY[name](*args, **kwargs)


@dataclass
class Pipeline:
    """source(spark) -> lines, then each (operator, arguments), then sink(lines).

    ``delivery``: 'exactly_once' drops repeated ids before the first stage, 'at_least_once' doesn't.
    ``order``: columns by which a table's first row of an id is the one that stays.
    """

    source: Callable[[SparkSession], DataFrame]
    stages: list[tuple[str, dict | list]]
    sink: Callable[[DataFrame], object] | None = None
    delivery: str = "at_least_once"
    max_stages: int = 3
    order: str | list[str] | None = None
    _ops: list[ops.Op] = field(init=False, repr=False)

    def __post_init__(self):
        if not 1 <= len(self.stages) <= self.max_stages:
            raise ValueError(f"a pipeline has 1 to {self.max_stages} stages, not {len(self.stages)}")
        if self.delivery not in ("exactly_once", "at_least_once"):
            raise ValueError(f"unknown delivery {self.delivery!r}")
        self._ops = [operation(name, **args) if isinstance(args, dict) else operation(name, *args) for name, args in self.stages]

    def frame(self, spark: SparkSession) -> DataFrame:
        lines = self.source(spark)
        if self.delivery == "exactly_once":
            lines = ops.dedup(order=self.order)(lines)
        for op in self._ops:
            lines = lines.transform(op)
        return lines

    def run(self, spark: SparkSession):
        out = self.frame(spark)
        return self.sink(out) if self.sink else out
