"""Dedup of a stream whose memory of ids expires."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

#: Groups that ids, and rows without one, are dealt to; fixed for a checkpoint.
BUCKETS = 4096
#: Ids that one entry of a group's list holds.
CHUNK = 10_000


class FirstOfId(StatefulProcessor):
    """The first row of each id, and again the first after ``ttl_ms`` without one that came through; a group has the ids of one bucket.

    A group's state is a list that gets the ids that come through in a batch as entries of ``CHUNK``, and an entry
    expires by itself. So a group is read and added to once a batch, however many ids it has, and nothing is rewritten.
    """

    def __init__(self, ttl_ms: int, columns: list[str], id_type: DataType):
        self.ttl_ms, self.columns, self.id_type = ttl_ms, columns, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", StructType([StructField("ids", ArrayType(self.id_type))]), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, new = None, []
        for row in rows:
            own = row["id"]
            if own is not None:
                if known is None:
                    known = {x for entry in self.seen.get() for x in entry[0]}
                if own in known:
                    continue
                known.add(own)
                new.append(own)
            yield Row(**{c: row[c] for c in self.columns})
        if new:
            self.seen.appendList([(new[i : i + CHUNK],) for i in range(0, len(new), CHUNK)])

    def close(self) -> None:
        pass


def dedup_expiring(stream: DataFrame, seconds: float, buckets: int = BUCKETS) -> DataFrame:
    """Rows of a stream without those whose id came through in the last ``seconds`` of processing time.

    State is the ids of that time, in ``buckets`` groups that a batch reads where it has rows: more of them suit small
    batches over many ids. Rows without an id are all kept, in the same pass. ``run_expiring`` makes the settings
    that it needs.
    """
    bucket = F.when(F.col("id").isNull(), F.floor(F.rand() * buckets)).otherwise(F.pmod(F.xxhash64("id"), F.lit(buckets)))
    first = FirstOfId(int(seconds * 1000), stream.columns, stream.schema["id"].dataType)
    return stream.withColumn("_bucket", bucket.cast("int")).groupBy("_bucket").transformWithState(first, stream.schema, "Append", "processingTime")


#: What such a stream needs: a store with times to live, and no batches without data, as there is always
#: state that may expire and a run over what is there would not end. State goes with the next data.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def run_expiring(stream: DataFrame, path: str, checkpoint: str, seconds: float) -> list[dict]:
    """Take what the source has now through ``dedup_expiring`` into Parquet at ``path``, and end; the progress of its batches.

    The checkpoint remembers the ids and when they expire. A query takes its settings when it starts, so
    those of the session are as before afterwards.
    """
    conf = stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        conf.set(k, v)
    try:
        query = dedup_expiring(stream, seconds).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            conf.set(k, v) if v is not None else conf.unset(k)
    query.awaitTermination()
    return [json.loads(p.json) for p in query.recentProgress]
