"""Tables that readers find whole at any time, while batches replace them or add to them.

A batch writes its rows to folders of its own and then, last of all, one small pointer file that is
renamed into place and names all folders of this version. Readers take the pointer of the highest batch
and read the folders that it names; these stay as they are for ``keep`` batches more. A batch whose
pointer exists, or that is older, changes nothing, so a batch that is tried again counts once.

    path/pointers/<batch>     {"batch": n, "tables": {name: {"schema": .., "folders": [..]}}}
    path/versions/<batch>-<unique>/<name>
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

KEEP = 20


class Snapshots:
    def __init__(self, spark: SparkSession, path: str, keep: int = KEEP):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}" if below else self.path)

    def batches(self) -> list[int]:
        """The batches whose pointers are there, in order."""
        pointers = self._path("pointers")
        if not self._fs.exists(pointers):
            return []
        return sorted(int(n) for n in (f.getPath().getName() for f in self._fs.listStatus(pointers)) if n.isdigit())

    def version(self, batch: int | None = None) -> dict | None:
        """What a batch's pointer says; of the last batch without one."""
        if batch is None:
            known = self.batches()
            if not known:
                return None
            batch = known[-1]
        stream = self._fs.open(self._path(f"pointers/{batch:020d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str = "rows", version: dict | None = None) -> DataFrame | None:
        """A table as of a version (the last, without one); None before the first batch that has it."""
        version = version or self.version()
        table = (version or {"tables": {}})["tables"].get(name)
        if table is None:
            return None
        return self.spark.read.schema(StructType.fromJson(table["schema"])).parquet(*table["folders"])

    def written(self, batch: int, name: str, df: DataFrame) -> DataFrame:
        """df, written where a commit of this batch that is given it leaves it."""
        folder = f"{self.path}/versions/{batch:020d}-{uuid.uuid4().hex}/{name}"
        df.write.parquet(folder)
        out = self.spark.read.schema(df.schema).parquet(folder)
        out.tideline_folder = folder
        return out

    def commit(self, batch: int, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None) -> bool:
        """Make a version in which some tables are replaced and some have more rows; whether it was made."""
        now = self.version()
        if now and now["batch"] >= batch:
            return False
        tables, made = dict(now["tables"]) if now else {}, []
        for changes, grows in ((replace, False), (append, True)):
            for name, df in (changes or {}).items():
                df = df if hasattr(df, "tideline_folder") else self.written(batch, name, df)
                made.append(df.tideline_folder)
                before = tables[name]["folders"] if grows and name in tables else []
                tables[name] = {"schema": df.schema.jsonValue(), "folders": [*before, df.tideline_folder]}
        if not self._point(batch, {"batch": batch, "tables": tables}):
            for folder in made:
                self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(folder), True)
            return False
        self._clear()
        return True

    def _point(self, batch: int, version: dict) -> bool:
        target, made = self._path(f"pointers/{batch:020d}"), self._path(f"pointers/_{uuid.uuid4().hex}")
        out = self._fs.create(made)
        out.write(bytearray(json.dumps(version).encode()))
        out.close()
        if not self._fs.exists(target) and self._fs.rename(made, target):
            return True
        self._fs.delete(made, False)  # another attempt at this batch was first
        return False

    def _clear(self) -> None:
        """Remove versions that only pointers older than the last ``keep`` name."""
        known = self.batches()
        if len(known) <= self.keep:
            return
        folders = lambda b: {f for t in self.version(b)["tables"].values() for f in t["folders"]}
        kept, old = folders(known[-self.keep]), known[: -self.keep]
        for b in known[-self.keep + 1 :]:
            kept |= folders(b)
        for b in old:
            for f in folders(b) - kept:
                self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(f), True)
            self._fs.delete(self._path(f"pointers/{b:020d}"), False)


def read_snapshot(spark: SparkSession, path: str, name: str = "rows") -> DataFrame:
    out = Snapshots(spark, path).read(name)
    if out is None:
        raise FileNotFoundError(f"{path} has no version with {name!r} yet")
    return out
