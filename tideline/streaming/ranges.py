"""A stream over a finite table, a range of rows a batch.

``save_ranges`` writes the rows in order, in files of consecutive positions, with a manifest of where each
file begins. The source's offsets are positions: a batch is the next ``rows`` of them, and its tasks read
the files of their part of the range and no others. The checkpoint has the offsets; what the source
itself has committed is kept in a small file beside it, so that a job that is started again goes on at
the same pace.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

ROWS_A_FILE = 100_000


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if urlparse(path).scheme else f"file://{path}")


def save_ranges(rows: DataFrame, by: str | list[str], path: str, rows_a_file: int = ROWS_A_FILE) -> int:
    """Save rows in the order of ``by`` for ``range_stream``; how many there are."""
    spark = rows.sparkSession
    ordered = rows.orderBy(*([by] if isinstance(by, str) else by)).withColumn("_p", F.monotonically_increasing_id())
    ordered.write.option("maxRecordsPerFile", rows_a_file).parquet(f"{path}/rows")
    saved = spark.read.schema(ordered.schema).parquet(f"{path}/rows").select("_p", F.col("_metadata.file_path").alias("file"))
    files, at = [], 0
    for r in saved.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("_p").alias("first")).orderBy("first").collect():  # a row a file
        files.append({"file": r["file"], "first": at, "rows": r["n"]})
        at += r["n"]
    fs, root = _fs(path)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"schema": rows.schema.jsonValue(), "rows": at, "files": files}).encode())
    return at


def _manifest(path: str) -> dict:
    fs, root = _fs(path)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


class _Range(InputPartition):
    def __init__(self, pieces: list[tuple[str, int, int]]):
        self.pieces = pieces  # (file, first row in it, rows)


class RangeReader(DataSourceStreamReader):
    def __init__(self, path: str, rows: int, tasks: int, progress: str, names: list[str]):
        self.path, self.rows, self.tasks, self.progress, self.names = path, rows, tasks, progress, names
        self.manifest = _manifest(path)
        fs, place = _fs(progress)
        known = fs.get_file_info(place).type == pafs.FileType.File
        self.at = json.loads(fs.open_input_stream(place).read())["at"] if known else 0

    def initialOffset(self) -> dict:
        self.at = 0  # a new checkpoint begins at the beginning
        return {"at": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.manifest["rows"], self.at + self.rows)
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        self.at, out = max(self.at, end["at"]), []
        size = max(1, -(-(end["at"] - start["at"]) // self.tasks))
        for first in range(start["at"], end["at"], size):
            last, pieces = min(end["at"], first + size), []
            for f in self.manifest["files"]:
                a, b = max(first, f["first"]), min(last, f["first"] + f["rows"])
                if a < b:
                    pieces.append((f["file"], a - f["first"], b - a))
            out.append(_Range(pieces))
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for name, skip, rows in partition.pieces:
            fs, place = _fs(name)
            with fs.open_input_file(place) as f:
                file = pq.ParquetFile(f)
                at, groups, lead = 0, [], None
                for g in range(file.num_row_groups):
                    n = file.metadata.row_group(g).num_rows
                    if at < skip + rows and at + n > skip:
                        lead = at if lead is None else lead
                        groups.append(g)
                    at += n
                table = file.read_row_groups(groups, columns=self.names).slice(skip - lead, rows)
            yield from table.to_batches()

    def commit(self, end: dict) -> None:
        fs, place = _fs(self.progress)
        fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
        made = f"{place}.{uuid.uuid4().hex}"
        with fs.open_output_stream(made) as f:
            f.write(json.dumps(end).encode())
        fs.move(made, place)


class RangeSource(DataSource):
    """Format ``row_ranges``; options path, rows (a batch), tasks, progress."""

    @classmethod
    def name(cls) -> str:
        return "row_ranges"

    def schema(self) -> StructType:
        return StructType.fromJson(_manifest(self.options["path"])["schema"])

    def streamReader(self, schema: StructType) -> RangeReader:
        o = self.options
        return RangeReader(o["path"], int(o["rows"]), int(o.get("tasks", 1)), o["progress"], schema.names)


def range_stream(spark: SparkSession, path: str, rows: int, checkpoint: str, tasks: int = 1) -> DataFrame:
    """The rows saved at ``path``, ``rows`` a batch, for a job with that checkpoint."""
    spark.dataSource.register(RangeSource)
    source = spark.readStream.format("row_ranges").option("path", path).option("rows", rows).option("tasks", tasks)
    return source.option("progress", f"{checkpoint.rstrip('/')}-source/progress").load()


def paced(spark: SparkSession, path: str, rows_per_sec: int, checkpoint: str, tasks: int = 1, seconds: float = 1.0) -> tuple[DataFrame, dict]:
    """A stream of the rows saved at ``path``, and the trigger that makes it ``rows_per_sec`` (0: as fast as batches of 1,000,000 go).

    The rate is dealt to ``tasks`` in whole rows, as 100 over 3 gives 33 each and 99 in all.
    """
    rate = rows_per_sec // tasks * tasks
    if rows_per_sec and not rate:
        raise ValueError("fewer rows a second than tasks")
    rows = max(1, int(rate * seconds)) if rate else 1_000_000
    return range_stream(spark, path, rows, checkpoint, tasks), {"processingTime": f"{int(seconds * 1000) if rate else 0} milliseconds"}


def run_to_end(writer) -> list[dict]:
    """Start a writer over such a stream, wait until the table has gone through, and stop; the progress of its batches."""
    query = writer.start()
    try:
        query.processAllAvailable()
        return [json.loads(p.json) for p in query.recentProgress]
    finally:
        query.stop()
