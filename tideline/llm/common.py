"""What the training-data operators share: tables, the shared folder, saved intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.streaming.run import working_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share."""
    return working_dir(spark, "training")


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores added while df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder.

    ``saved`` cuts the lineage: what follows reads a finished table, so a lost executor costs only
    the tasks it was running. ``drop`` frees tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, shared_dir(spark), 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:02d}-{name}"

    def saved(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.tideline_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "tideline_path", None):
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
