"""Fleet health from heartbeats and member snapshots.

members: (id, host, port, version, ts, counter, state) with state Alive, Suspected or Failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.ring import ring_id


def _age(ts: str, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6


def liveness(heartbeats: DataFrame, as_of: Column, t_fail: float = 5.0, t_suspect: float | None = None) -> DataFrame:
    """(id, last_seen, age, state) of heartbeats(id, ts) at a moment; later heartbeats don't count.

    Without t_suspect a member older than t_fail is Failed. With it, a member is Suspected beyond
    t_suspect and Failed beyond t_suspect + t_fail. All limits are strict.
    """
    seen = heartbeats.where(F.col("ts") <= as_of).groupBy("id").agg(F.max("ts").alias("last_seen"))
    seen = seen.withColumn("age", _age("last_seen", as_of))
    if t_suspect is None:
        state = F.when(F.col("age") > t_fail, "Failed")
    else:
        state = F.when(F.col("age") > t_suspect + t_fail, "Failed").when(F.col("age") > t_suspect, "Suspected")
    return seen.withColumn("state", state.otherwise("Alive"))


def merge_members(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """What a node knows after it hears another's members.

    Rows without host or port are ignored, and so are unknown members that are Failed. An incoming
    Failed beats a state that isn't, whatever its counter; else the strictly higher counter wins, so
    a newer Alive revives a Failed member.
    """
    fields = [c for c in current.columns if c != "id"]
    valid = incoming.where("port <> 0 and port is not null and coalesce(host, '') <> ''")
    a = current.select("id", F.struct(*fields).alias("a"))
    b = valid.select("id", F.struct(*fields).alias("b"))
    both = a.join(b, "id", "full").where(F.col("a").isNotNull() | ~F.col("b.state").eqNullSafe("Failed"))
    failed = (F.col("b.state") == "Failed") & (F.col("a.state") != "Failed")
    newer = F.col("b.counter") > F.col("a.counter")
    take = F.col("a").isNull() | F.coalesce(failed, F.lit(False)) | F.coalesce(newer, F.lit(False))
    return both.select("id", F.when(take, F.col("b")).otherwise(F.col("a")).alias("m")).select("id", *[F.col(f"m.{c}").alias(c) for c in fields])


def purge_failed(members: DataFrame, as_of: Column, t_cleanup: float = 30.0) -> DataFrame:
    """Members without those that have been Failed for longer than t_cleanup; Suspected ones stay."""
    return members.where(~F.coalesce((F.col("state") == "Failed") & (_age("ts", as_of) > t_cleanup), F.lit(False)))


def latest_incarnation(members: DataFrame) -> DataFrame:
    """The newest version of each host and port."""
    newest = F.row_number().over(Window.partitionBy("host", "port").orderBy(F.desc("version"), "id"))
    return members.withColumn("_n", newest).where("_n = 1").drop("_n")


def apply_heartbeats(members: DataFrame, beats: DataFrame) -> DataFrame:
    """Counter and time of members after beats(id, ts); Failed members don't take them, unknown ones are ignored."""
    heard = beats.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_ts"))
    live = F.col("_n").isNotNull() & ~F.col("state").eqNullSafe("Failed")
    out = members.join(heard, "id", "left")
    out = out.withColumn("counter", F.when(live, F.col("counter") + F.col("_n")).otherwise(F.col("counter"))).withColumn("ts", F.when(live, F.greatest("ts", "_ts")).otherwise(F.col("ts")))
    return out.select(members.columns)


def members_by_ring(members: DataFrame) -> DataFrame:
    """Alive members in ring order."""
    return members.where("state = 'Alive'").withColumn("ring", ring_id("id")).orderBy("ring")


def members_by_host(members: DataFrame) -> DataFrame:
    """Members that haven't failed, by host and port."""
    return members.where("state <> 'Failed'").orderBy("host", "port")
