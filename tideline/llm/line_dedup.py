"""Line dedup by site-relative frequency.

A line's frequency on a site is the share of the site's pages that contain it. Lines on at least
``min_pages`` pages and on more than ``ratio`` of them are boilerplate of that site and are dropped
from all its pages. Lines are counted once a page, before the shuffle within each batch. Only the
boilerplate lines' hashes are broadcast, in arrays a site, up to ``max_lines`` of them (their number is
measured). Beyond that a Bloom filter of them is, of at most ``bloom.MOST_BITS``; the lines that pass it are joined
with the boilerplate by site and hash, and each page gets its own list. Texts are never written either way.

Cases: a null text stays null and has no lines; blank lines are never counted or dropped; a null
site is a site; rows that repeat a page count as pages; a line on exactly ``ratio`` of the pages stays;
texts and lines of any length are read whole, a line only travels as its hash; an empty table gives no
rows; columns named like a result are replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import textwords
from tideline.llm.bloom import Bloom
from tideline.llm.common import Scratch, unused


def line_hash(line: str) -> int:
    h = xxhash.xxh3_64_intdigest(line.encode())
    return h - (1 << 64) if h >> 63 else h


def _count(batches):
    for batch in batches:
        n = Counter()
        for site, text in zip(batch.column("site").to_pylist(), batch.column("text")):
            n.update((site, line_hash(x)) for x in {x for x in (text.as_py() or "").split("\n") if x.strip()})
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.int64()), pa.array(list(n.values()), pa.int64())], names=["site", "line", "n"]
        )


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(site, line, n) of ``pages(site, text)``: hashes of the lines above the ratio."""
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("total")).withColumnRenamed("site", "_site")
    lines = pages.mapInArrow(_count, "site string, line long, n long").groupBy("site", "line").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pages)
    return lines.join(totals, F.col("site").eqNullSafe(F.col("_site"))).where(F.col("n") > ratio * F.col("total")).select("site", "line", "n")


def _site_lines(site: str | None, lines: list[int]) -> np.ndarray:
    """One hash for a site and each of some lines."""
    return textwords.mix(np.array(lines, np.int64).astype(np.uint64) ^ np.uint64(xxhash.xxh3_64_intdigest(b"" if site is None else b"+" + site.encode())))


def _site_line_column(batches):
    for batch in batches:
        pairs = zip(batch.column("site").to_pylist(), batch.column("line").to_pylist())
        found = [int(_site_lines(site, [line]).astype(np.int64)[0]) for site, line in pairs]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["hash"])


def _passing(bloom):
    """The lines of pages, once a page, that the filter lets pass."""

    def run(batches):
        for batch in batches:
            keys, sites, lines = [], [], []
            for key, site, text in zip(batch.column("key").to_pylist(), batch.column("site").to_pylist(), batch.column("text")):
                mine = sorted({line_hash(x) for x in (text.as_py() or "").split("\n") if x.strip()})
                some = np.flatnonzero(bloom.value.holds(_site_lines(site, mine))) if mine else ()
                keys += [key] * len(some)
                sites += [site] * len(some)
                lines += [mine[k] for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sites, pa.string()), pa.array(lines, pa.int64())], names=["key", "site", "line"])

    return run


def _among(hashes: list[int], known: np.ndarray) -> np.ndarray:
    """Which hashes are among known ones (sorted)."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    at = np.searchsorted(known, np.array(hashes, np.int64))
    return known[np.minimum(at, len(known) - 1)] == hashes


def _drop(bad, site: str, listed: str | None = None):
    """Texts without the lines of ``bad`` (site: sorted hashes), or of the column ``listed``."""
    none = np.zeros(0, np.int64)

    def run(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            own, kept, dropped = columns.pop(listed, None), [], []
            for i, (where, text) in enumerate(zip(columns[site].to_pylist(), columns["text"])):
                text = text.as_py()
                lines = left = text.split("\n") if text is not None else []
                known = bad.value.get(where, none) if listed is None else np.sort(own[i].values.to_numpy())
                if len(known):
                    left = [x for x, gone in zip(lines, _among([line_hash(x) for x in lines], known)) if not (gone and x.strip())]
                kept.append("\n".join(left) if text is not None else None)
                dropped.append(len(lines) - len(left))
            columns["text"] = pa.array(kept, pa.string())
            columns["n_dropped"] = pa.array(dropped, pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def drop_boilerplate(docs: DataFrame, site: str, ratio: float = 0.02, min_pages: int = 5, max_lines: int = 1_000_000) -> DataFrame:
    """docs without their site's boilerplate lines, with n_dropped (lines taken out of each row)."""
    spark = docs.sparkSession
    docs = docs.select([c for c in docs.columns if c != "n_dropped"]).withColumn("text", F.col("text").cast("string"))
    own = unused(docs, "site")
    docs = docs.withColumn(own, F.col(site).cast("string"))
    pages, scratch = docs.select(F.col(own).alias("site"), "text"), Scratch(spark)
    lines = scratch.saved(boilerplate(pages, ratio, min_pages), "boilerplate")
    count, schema = lines.count(), docs.limit(0).selectExpr("*", "0L as n_dropped").schema
    if count <= max_lines:
        known: dict = {}
        for r in lines.collect():  # at most max_lines
            known.setdefault(r["site"], []).append(r["line"])
        known = {k: np.sort(np.array(v, np.int64)) for k, v in known.items()}
        return docs.mapInArrow(_drop(spark.sparkContext.broadcast(known), own), schema).drop(own)
    bloom = spark.sparkContext.broadcast(Bloom(lines.select("site", "line").mapInArrow(_site_line_column, "hash long"), count))
    digest = F.sha2("text", 256)
    passing = pages.select(digest.alias("key"), "site", "text").mapInArrow(_passing(bloom), "key string, site string, line long").distinct()
    right = lines.select(F.col("site").alias("_site"), F.col("line").alias("_line"))
    of_pages = passing.join(right, (F.col("line") == F.col("_line")) & F.col("site").eqNullSafe(F.col("_site"))).groupBy("key", "site")
    key, where, listed = (unused(docs, c) for c in ("page_key", "page_site", "page_lines"))
    of_pages = scratch.saved(of_pages.agg(F.collect_list("line").alias(listed)).withColumnsRenamed({"key": key, "site": where}), "pages")
    out = docs.join(of_pages, (digest == F.col(key)) & F.col(own).eqNullSafe(F.col(where)), "left")
    out = out.select(*docs.columns, F.coalesce(listed, F.array().cast("array<bigint>")).alias(listed))
    return out.mapInArrow(_drop(None, own, listed), schema).drop(own)


def report(docs: DataFrame, ratio: float = 0.02, min_pages: int = 5) -> DataFrame:
    """Per document: doc_id, text without boilerplate lines, n_dropped."""
    return drop_boilerplate(docs.select("doc_id", "source", "text"), "source", ratio, min_pages).select("doc_id", "text", "n_dropped")
