"""Consistent-hash placement of files on nodes."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.ring import ring_id


def place(files: DataFrame, nodes: DataFrame, n: int = 3, alive_only: bool = True, algo: str = "sha256", max_nodes: int = 1_000_000) -> DataFrame:
    """(file, file_ring, rank, node): the first n nodes clockwise from each file, rank 0 the primary.

    files(file), nodes(node[, alive]). The ring is cut into arcs of a few nodes by its leading hex
    digits; a row for each arc has its nodes and the n that follow. A file looks only at its own arc, and
    files aren't shuffled where the arcs are small enough to broadcast. The nodes, a fleet and not data,
    pass through the driver; more than ``max_nodes`` raise.
    """
    live = nodes.where("alive") if alive_only and "alive" in nodes.columns else nodes
    rows = live.select("node", ring_id("node", algo).alias("ring")).distinct().limit(max_nodes + 1).collect()
    if len(rows) > max_nodes:
        raise ValueError(f"more than {max_nodes} nodes")
    ring = sorted((r["ring"], str(r["node"])) for r in rows)
    if not ring:
        return files.select("file", ring_id("file", algo).alias("file_ring"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("node")).limit(0)
    n, digits = min(n, len(ring)), 0
    while 16**digits * 4 < len(ring):
        digits += 1
    positions = [h for h, _ in ring]
    arcs = []
    for k in range(16**digits):
        lead = f"{k:0{digits}x}" if digits else ""
        first, end = bisect.bisect_left(positions, lead), bisect.bisect_left(positions, lead + "g")
        inside = [(h, x) for h, x in ring[first:end]]
        arcs.append((lead, inside + [("g", ring[(end + j) % len(ring)][1]) for j in range(n)]))  # g: after every digit
    arcs = files.sparkSession.createDataFrame(arcs, "_lead string, _arc array<struct<h:string,node:string>>")
    placed = files.select("file", ring_id("file", algo).alias("file_ring")).withColumn("_lead", F.substring("file_ring", 1, digits)).join(arcs, "_lead")
    after = F.slice(F.filter("_arc", lambda x: x["h"] >= F.col("file_ring")), 1, n)
    return placed.select("file", "file_ring", F.posexplode(F.transform(after, lambda x: x["node"])).alias("rank", "node"))


def repair_plan(expected: DataFrame, held: DataFrame) -> DataFrame:
    """(file, node, action): 'copy' where a copy is due and missing, 'drop' where one is held and not due."""
    e, h = expected.select("file", "node").distinct(), held.select("file", "node").distinct()
    missing = e.join(h, ["file", "node"], "left_anti").withColumn("action", F.lit("copy"))
    return missing.unionByName(h.join(e, ["file", "node"], "left_anti").withColumn("action", F.lit("drop")))


def placement_diff(files: DataFrame, nodes_a: DataFrame, nodes_b: DataFrame, n: int = 3) -> DataFrame:
    """(file, node, change): copies that a change of membership adds or removes."""
    a, b = (place(files, nodes, n).select("file", "node", F.lit(True).alias(side)) for nodes, side in ((nodes_a, "before"), (nodes_b, "after")))
    both = a.join(b, ["file", "node"], "full").where("before is null or after is null")
    return both.select("file", "node", F.when(F.col("before").isNull(), "added").otherwise("removed").alias("change"))


def moved_files(diff: DataFrame) -> DataFrame:
    """One row: files whose copies changed, copies added and removed."""
    n = lambda c: F.count_if(F.col("change") == c)
    return diff.agg(F.count_distinct("file").alias("files"), n("added").alias("added"), n("removed").alias("removed"))
