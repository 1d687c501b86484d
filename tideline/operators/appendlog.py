"""Append-only files as rows of blocks (file, client, seq, content[, node])."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.numbering import MAX_GROUP, number_within, total_within

#: Bytes of a file that one row of ``assemble`` holds.
MAX_PART = 64 << 20


def sequence_appends(appends: DataFrame, order: str, max_group: int = MAX_GROUP) -> DataFrame:
    """appends(file, client, .., order) with seq (per file and client) and block (per file), from 1, in order."""
    return number_within(number_within(appends, ["file", "client"], [order], "seq", max_group), ["file"], [order, "client"], "block", max_group)


def checksum(blocks: DataFrame) -> DataFrame:
    """blocks with size in bytes and SHA-1 of the content."""
    content = F.col("content").cast("binary")
    return blocks.withColumn("size", F.octet_length(content)).withColumn("sha1", F.sha1(content))


def corrupt_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks whose content no longer has the sha1 it was stored with."""
    return blocks.where(~F.sha1(F.col("content").cast("binary")).eqNullSafe(F.col("sha1")))


def merge_replicas(blocks: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """(file, block, client, seq, content, copies, conflict): one file from what all replicas hold.

    One block for each (client, seq), in that order, numbered from 1. Where replicas disagree on a
    block's content, the one with the smallest checksum stays and conflict is true.
    """
    content = F.col("content").cast("binary")
    one = blocks.withColumn("sha1", F.sha1(content)).groupBy("file", "client", "seq").agg(F.min_by("content", "sha1").alias("content"), F.count(F.lit(1)).alias("copies"), (F.min("sha1") != F.max("sha1")).alias("conflict"))
    return number_within(one, ["file"], ["client", "seq"], "block", max_group).select("file", "block", "client", "seq", "content", "copies", "conflict")


def client_progress(blocks: DataFrame) -> DataFrame:
    """(file, clients): the highest sequence of each client, as a map."""
    last = blocks.groupBy("file", "client").agg(F.max("seq").alias("seq"))
    return last.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("client", "seq")))).alias("clients"))


def assemble(blocks: DataFrame, max_part: int = MAX_PART, max_group: int = MAX_GROUP) -> DataFrame:
    """(file, part, content): contents in block order, cut into parts of about ``max_part`` bytes at block ends.

    Almost every file is one part, 0. Of a larger one no row or task holds more than a part; ``write_file``
    writes it out.
    """
    sized = blocks.select("file", "block", F.col("content").cast("string").alias("content")).withColumn("_size", F.octet_length("content").cast("long"))
    placed = total_within(sized, ["file"], ["block"], "_size", "_at", max_group)
    parts = F.array_sort(F.collect_list(F.struct("block", "content")))
    out = placed.groupBy("file", F.floor(F.col("_at") / max_part).cast("long").alias("part")).agg(F.array_join(F.transform(parts, lambda b: b["content"]), "").alias("content"))
    return out.select("file", "part", "content")


def write_file(blocks: DataFrame, file: str, path: str) -> None:
    """One file's contents in block order, as ordered part files; no row or task holds it whole."""
    blocks.where(F.col("file") == file).repartitionByRange("block").sortWithinPartitions("block").select(F.col("content").cast("string").alias("value")).write.mode("overwrite").text(path)


def inventory(blocks: DataFrame) -> DataFrame:
    """Per node and file: blocks, bytes and version (its highest block count so far)."""
    return blocks.groupBy("node", "file").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.octet_length(F.col("content").cast("binary"))).cast("long").alias("bytes"), F.max("seq").alias("last_seq"))


def replica_copy(blocks: DataFrame, node: str, max_part: int = MAX_PART, max_group: int = MAX_GROUP) -> DataFrame:
    """The files as one node holds them, assembled in (client, seq) order."""
    return assemble(number_within(blocks.where(F.col("node") == node), ["file"], ["client", "seq"], "block", max_group), max_part, max_group)


def divergent_files(blocks: DataFrame) -> DataFrame:
    """(file, versions): files of which nodes hold different contents.

    A copy's digest is a count, a sum and an exclusive or of its blocks' hashes, which need no order, so
    nothing of a file is gathered.
    """
    mark = [F.col("client"), F.col("seq"), F.sha1(F.col("content").cast("binary"))]
    one, two = F.xxhash64(F.lit(1), *mark), F.xxhash64(F.lit(2), *mark)
    copies = blocks.groupBy("file", "node").agg(F.struct(F.count(F.lit(1)), F.bit_xor(one), F.sum(two.cast("decimal(20,0)"))).alias("digest"))
    return copies.groupBy("file").agg(F.count_distinct("digest").alias("versions")).where("versions > 1")
