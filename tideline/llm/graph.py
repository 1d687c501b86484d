"""Connected components by joins; no edge or label ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tideline.llm.common import Scratch


ROWS_A_FILE = 50_000


def _saved(edges: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, tuple]:
    """The saved edges, and their number and an order-free digest, taken while they are written."""
    seen = Observation()
    digest = F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))
    out = scratch.saved(edges.observe(seen, F.count(F.lit(1)).alias("n"), digest.alias("digest")), name)
    return out, (seen.get["n"], seen.get["digest"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, component) for every node of ``edges(u, v)``; the component is its smallest node.

    Alternates two rewrites that keep connectivity: every node hands its larger neighbours to its
    smallest neighbour, then its smaller ones. Path lengths shrink geometrically, and it ends when
    each component is a star around its smallest node. A hub's edges meet only in joins, which
    Spark can split, and in minima, which are taken before the shuffle.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, state = _saved(edges, scratch, "edges")
    while True:
        files = max(1, -(-state[0] // ROWS_A_FILE))  # a round's edges are few; so are its files
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("v"))
        small = large.join(low.withColumnRenamed("v", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, new_state = _saved(small.union(low).distinct().coalesce(files), scratch, "edges")
        scratch.drop(now)
        if new_state == state:
            break
        now, state = new, new_state
    return new.select("u", F.col("v").alias("component")).union(new.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct())
