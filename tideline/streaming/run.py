"""Running streams: checkpoints, delivery modes, final results, stateful operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.operators.lines import dedup
from tideline.sources.snapshots import Snapshots

_OWN: dict[str, str] = {}


def working_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or, in a local session without it, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _OWN.setdefault(app, f"file://{tempfile.mkdtemp(prefix='spark-tideline-')}") if app not in _OWN else _OWN[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_stream(stream: DataFrame, path: str, checkpoint: str, delivery: str = "exactly_once", within: str | None = None) -> None:
    """Take what the source has now, append it to Parquet at ``path``, and end.

    The checkpoint is the job's identity: running again on it resumes after the last batch, a new
    one starts clean. ``exactly_once`` drops ids seen before (state in the checkpoint) and writes
    with the file sink's commit log; ``at_least_once`` appends each batch, and a batch that is
    retried after a crash can repeat rows.
    """
    if delivery == "exactly_once":
        query = dedup(within)(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    elif delivery == "at_least_once":
        query = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("append").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        raise ValueError(f"unknown delivery {delivery!r}")
    query.awaitTermination()


def run_counts(counts: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """Keep a streaming aggregate in ``Snapshots`` at ``path``; ``read_snapshot`` reads it.

    ``complete`` replaces the table by the whole result after each batch, which is what is flushed at
    the end of the input; ``update`` adds the rows that changed, with their batch. A reader finds
    a whole version at any time, and a batch that is tried again counts once. The aggregate's state
    lives in the checkpoint together with the offsets.
    """

    def write(batch: DataFrame, number: int) -> None:
        table = Snapshots(batch.sparkSession, path)
        if mode == "complete":
            table.commit(number, replace={"rows": batch})
        else:
            table.commit(number, append={"rows": batch.withColumn("batch", F.lit(number).cast("long"))})

    counts.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def running_count(stream: DataFrame) -> DataFrame:
    """(key, n) so far; the same expression as the batch count."""
    return stream.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def liveness_stream(beats: DataFrame, t_fail: float, t_suspect: float | None = None) -> DataFrame:
    """Changes of state of each member of a stream beats(id, ts), by processing time.

    A beat makes a member Alive. Silence makes it Suspected after t_suspect and Failed t_fail later
    (Failed after t_fail where there is no suspicion).
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        if state.hasTimedOut:
            now = "Suspected" if before == "Alive" and t_suspect is not None else "Failed"
        else:
            now = "Alive"
            for _ in parts:
                pass
        state.update((now,))
        if now == "Alive":
            state.setTimeoutDuration(int(1000 * (t_fail if t_suspect is None else t_suspect)))
        elif now == "Suspected":
            state.setTimeoutDuration(int(1000 * t_fail))
        yield pd.DataFrame([(key[0], now)] if now != before else [], columns=["id", "state"])

    return beats.groupBy("id").applyInPandasWithState(step, "id string, state string", "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)
