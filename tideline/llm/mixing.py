"""Mixing sources to token targets by entropy balancing.

Each document gets a rate, as close as possible in relative entropy to taking everything once, such
that every source's expected tokens meet its target and no rate exceeds ``max_copies``. The solution
has the form ``min(max_copies, exp(lambda_s * size / scale_s))``: documents are exponentially tilted
by size, one multiplier a source. The convex dual falls apart by source; guarded Newton steps solve
it, each one Spark job over counts of (source, size), so an iteration never touches documents. A step
that leaves its bracket becomes a bisection, so every multiplier ends at its target or with a bracket
that doubles can't split.

Rates become whole copies with one hash number a document; a shift of these numbers per source,
read off a distributed histogram, brings the rounded tokens to the target.

Up to ``BROADCAST_SOURCES`` sources, which are counted, targets and multipliers are arrays in the driver
from step to step and a small table that is broadcast to the documents. Beyond, they are a saved table
from step to step, of any number of sources, and joined.

Cases: null text has size 0; a null source is a source, last in order; a source without tokens has
target 0; documents of size 0 add nothing whatever is taken; rows that repeat both doc_id and text
share a hash number and get equal copies (so do null ids with one text: many such rows round together,
and their source's words miss the target by up to their size); an empty table gives an empty mix;
texts of any length are read once, by one expression; ``mixed`` returns the columns it was given,
whatever their names, ``report`` reads doc_id, text and source alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tideline.llm.common import Scratch
from tideline.operators.numbering import total_within

WEIGHTS = (5.0, 2.0, 1.0)
BINS = 1 << 12
#: Rows of the table of sources that are sent to every executor.
BROADCAST_SOURCES = 100_000


def size_of(text: str = "text"):
    """Words of a text: runs of characters other than space, tab and line ends."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exact_sum(x):
    """A sum that doesn't depend on the order of rows, so that reruns agree to the last bit."""
    return F.sum(x.cast("decimal(30,6)"))


def water_level(sources: DataFrame, total: float, most: float) -> float:
    """The u at which min(u * weight, most * tokens), summed over sources(weight, tokens), is ``total``.

    That is total dealt by weight with what a full source can't take dealt again: starting from the
    plain share, each aggregate finds the sources that are full at u, and u rises until none is added.
    """
    u, full = 0.0, -1
    while True:
        over = F.lit(u) * F.col("weight") > most * F.col("tokens")
        n, taken, free = sources.where("tokens > 0").agg(F.count_if(over), F.sum(F.when(over, F.col("tokens"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not free:
            return u
        u, full = (total - most * (taken or 0)) / free, n


class Mix:
    """Targets, rates and rounding shifts of each source."""

    def __init__(self, sizes: DataFrame, ratio: float = 1.5, max_copies: int = 2):
        """sizes: (doc_id, source, size, mark), mark the hash number of a row."""
        self.spark, self.max_copies = sizes.sparkSession, max_copies
        self.scratch = Scratch(self.spark)
        counts = self.scratch.saved(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
        tokens = F.col("size") * F.col("n")
        sources = counts.groupBy("source").agg(F.sum(tokens).alias("tokens"), exact_sum(tokens * F.col("size").cast("double")).cast("double").alias("squares"))
        sources = self.scratch.saved(sources.withColumn("no_source", F.col("source").isNull()), "tokens")
        few = sources.limit(BROADCAST_SOURCES + 1).collect()
        self.n = len(few)
        if self.n <= BROADCAST_SOURCES:
            self.table = self._solve_few(counts, few, ratio)
        else:
            self.table = self._targets(sources, ratio)
            self.table = self.scratch.saved(self._solve(counts), "multipliers")
        self.table = self.scratch.saved(self._round(sizes), "shifts")
        self.scratch.drop(counts, sources)

    def _targets(self, sources: DataFrame, ratio: float) -> DataFrame:
        """(_source, _total, _scale, _target) of any number of sources(source, tokens, squares, no_source)."""
        weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS)).cast("int"))
        ranked = total_within(sources, [], ["no_source", "source"], None, "place").withColumn("weight", weight)
        ranked = self.scratch.saved(ranked.select("source", "tokens", "squares", "weight"), "weights")
        self.n, total = ranked.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        level = water_level(ranked, ratio * total, self.max_copies)
        target = F.when(F.col("tokens") > 0, F.least(F.lit(level) * F.col("weight"), F.lit(float(self.max_copies)) * F.col("tokens"))).otherwise(0.0)
        scale = F.when(F.col("tokens") > 0, F.col("squares") / F.col("tokens")).otherwise(1.0)
        table = ranked.select(F.col("source").alias("_source"), F.col("tokens").alias("_total"), scale.alias("_scale"), target.alias("_target"))
        return self.scratch.saved(table, "targets")

    def _solve_few(self, counts: DataFrame, sources: list, ratio: float, tolerance: float = 1e-9) -> DataFrame:
        """The table with _lam, as ``_solve`` makes it, for at most ``BROADCAST_SOURCES`` sources.

        Targets and brackets stay in the driver; a Newton step sends it one row a source, and no state is written.
        """
        sources = sorted(sources, key=lambda r: (r["no_source"], r["source"] or ""))
        total = np.array([r["tokens"] or 0 for r in sources], np.int64)
        squares = np.array([r["squares"] or 0.0 for r in sources], np.float64)
        weight, most, some = np.resize(np.array(WEIGHTS), len(sources)), float(self.max_copies), total > 0
        level, full = 0.0, np.zeros(len(sources), bool)
        while some.any() and (free := weight[some & ~full].sum()):
            level = (ratio * float(total.sum()) - most * float(total[full].sum())) / free
            over = some & (level * weight > most * total)
            if (over == full).all():
                break
            full = over
        target = np.where(some, np.minimum(level * weight, most * total), 0.0)
        scale = np.where(some, squares / np.maximum(total, 1), 1.0)
        whole = target >= most * total * (1 - 1e-12)
        lam, low, high, done = np.zeros(len(sources)), np.full(len(sources), -np.inf), np.full(len(sources), np.inf), whole.copy()
        names = [r["source"] for r in sources]
        while not done.all():
            left = np.flatnonzero(~done)
            step = pa.table({"_k": left, "_source": pa.array([names[k] for k in left], pa.string()), "_lam": lam[left], "_scale": scale[left]})
            tilt = F.col("_lam") * F.col("size") / F.col("_scale")
            rate, tokens = F.exp(F.least(tilt, F.lit(math.log(most)))), F.col("size") * F.col("n")
            found = self._with(counts, self.spark.createDataFrame(step)).groupBy("_k").agg(
                exact_sum(tokens * rate).cast("double").alias("value"), exact_sum(F.when(tilt < math.log(most), tokens * rate * F.col("size") / F.col("_scale")).otherwise(0.0)).cast("double").alias("slope")
            )
            for r in found.collect():
                k, gap = r["_k"], r["value"] - target[r["_k"]]
                if gap < 0:
                    low[k] = max(low[k], lam[k])
                else:
                    high[k] = min(high[k], lam[k])
                newton = lam[k] - gap / r["slope"] if r["slope"] > 0 else math.inf
                bracketed = low[k] > -math.inf and high[k] < math.inf
                if abs(gap) <= tolerance * target[k] or bracketed and high[k] - low[k] <= 1e-15 * (abs(low[k]) + abs(high[k])):
                    done[k] = True
                elif low[k] < newton < high[k] and abs(newton - lam[k]) <= 8 * (1 + abs(lam[k])):
                    lam[k] = newton
                else:
                    lam[k] = (low[k] + high[k]) / 2 if bracketed else lam[k] - math.copysign(1, gap) * (1 + abs(lam[k]))
        solved = {"_source": pa.array(names, pa.string()), "_total": total, "_scale": scale, "_target": target, "_lam": pa.array(lam, mask=whole)}
        return self.spark.createDataFrame(pa.table(solved))

    def _with(self, df: DataFrame, table: DataFrame) -> DataFrame:
        """df with its source's row; where the table may be broadcast, df stays where it is."""
        if self.n <= BROADCAST_SOURCES:
            table = F.broadcast(table)
        return df.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    def _solve(self, counts: DataFrame, tolerance: float = 1e-9) -> DataFrame:
        """The table with _lam, the root of each source's dual slope (null: the source is taken whole)."""
        whole = F.col("_target") >= self.max_copies * F.col("_total") * (1 - 1e-12)
        inf = F.lit(math.inf)
        state = self.table.withColumns({"_lam": F.lit(0.0), "_low": -inf, "_high": inf, "_done": whole})
        fields = state.columns
        while True:
            seen = Observation()
            state = self.scratch.saved(state.observe(seen, F.count_if(~F.col("_done")).alias("left")), "newton")
            if not seen.get["left"]:
                return state.select(*self.table.columns, F.when(~whole, F.col("_lam")).alias("_lam"))
            tilt = F.col("_lam") * F.col("size") / F.col("_scale")
            rate, tokens = F.exp(F.least(tilt, F.lit(math.log(self.max_copies)))), F.col("size") * F.col("n")
            inner = tilt < math.log(self.max_copies)
            found = self._with(counts, state.where("not _done").select("_source", "_lam", "_scale")).groupBy("source").agg(
                exact_sum(tokens * rate).cast("double").alias("value"), exact_sum(F.when(inner, tokens * rate * F.col("size") / F.col("_scale")).otherwise(0.0)).cast("double").alias("slope")
            )
            gap, lam = F.col("value") - F.col("_target"), F.col("_lam")
            low = F.when(gap < 0, F.greatest("_low", "_lam")).otherwise(F.col("_low"))
            high = F.when(gap < 0, F.col("_high")).otherwise(F.least("_high", "_lam"))
            newton = F.when(F.col("slope") > 0, lam - gap / F.col("slope")).otherwise(inf)
            fits = (low < newton) & (newton < high) & (F.abs(newton - lam) <= 8 * (1 + F.abs(lam)))
            bracketed = (low > -inf) & (high < inf)
            other = F.when(bracketed, (low + high) / 2).otherwise(lam - F.signum(gap) * (1 + F.abs(lam)))
            met = (F.abs(gap) <= tolerance * F.col("_target")) | bracketed & (high - low <= 1e-15 * (F.abs(low) + F.abs(high)))
            new = state.join(F.broadcast(found) if self.n <= BROADCAST_SOURCES else found, F.col("source").eqNullSafe(F.col("_source")), "left")
            new = new.withColumns({"_new": F.when(met, lam).when(fits, newton).otherwise(other), "_low2": low, "_high2": high, "_met": met})
            keep = F.col("_done")
            new = new.withColumns({"_lam": F.when(keep, lam).otherwise(F.col("_new")), "_low": F.when(keep, F.col("_low")).otherwise(F.col("_low2")), "_high": F.when(keep, F.col("_high")).otherwise(F.col("_high2")), "_done": keep | F.col("_met")})
            state = new.select(fields)

    def _breaks(self, df: DataFrame) -> DataFrame:
        """Adds its source's row, rate and, for each copy k, the bin of the shift from which it is taken k times."""
        df = self._with(df, self.table)
        tilted = F.exp(F.least(F.col("_lam") * F.col("size") / F.col("_scale"), F.lit(math.log(self.max_copies))))
        rate = F.when(F.col("_lam").isNull(), F.lit(float(self.max_copies))).otherwise(tilted)
        unit = F.pmod("mark", F.lit(1 << 40)) / float(1 << 40)
        df = df.withColumn("rate", rate).withColumn("_sum", F.col("rate") + unit)
        return df.withColumn("_bins", F.array(*[F.ceil((F.lit(float(k)) - F.col("_sum")) * BINS).cast("long") for k in range(1, self.max_copies + 1)]))

    def _round(self, sizes: DataFrame) -> DataFrame:
        """The table with _shift; a source that is taken whole, or not at all, keeps the plain rounding."""
        bins = self._breaks(sizes.select("source", "size", "mark").where("size > 0")).select("source", "size", F.explode("_bins").alias("bin"))
        mass = bins.groupBy("source", "bin").agg(F.sum("size").alias("tokens"))
        upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("bin"))  # a few thousand bins
        reached = self._with(mass.withColumn("upto", upto), self.table.select("_source", "_target"))
        best = reached.groupBy("source").agg(F.min(F.struct(F.abs(F.col("upto") - F.col("_target")).alias("gap"), F.abs("bin").alias("size"), "bin")).alias("best"))
        shift = F.when(F.col("_lam").isNotNull() & (F.col("_target") > 0), F.coalesce("best.bin", F.lit(0))).otherwise(0).cast("long")
        return self.table.join(best, F.col("source").eqNullSafe(F.col("_source")), "left").select(*self.table.columns, shift.alias("_shift"))

    def copies(self, sizes: DataFrame) -> DataFrame:
        """sizes with source_size, target, rate and copies; extra columns pass through."""
        found = self._breaks(sizes)
        copies = F.size(F.filter("_bins", lambda b: b <= F.col("_shift"))).cast("long")
        return (
            found.withColumn("copies", copies)
            .withColumn("source_size", F.col("_total"))
            .withColumn("target", F.col("_target"))
            .drop("_lam", "_scale", "_target", "_total", "_shift", "_sum", "_bins")
        )


def hash_number(text: str = "text"):
    return F.xxhash64(F.col("doc_id").cast("string"), F.col(text).cast("string"), F.lit(20240501))


def sizes_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of().alias("size"), hash_number().alias("mark"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies, rate."""
    sizes = Scratch(docs.sparkSession).saved(sizes_of(docs), "sizes")
    return Mix(sizes).copies(sizes).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    mix = Mix(Scratch(docs.sparkSession).saved(sizes_of(docs), "sizes"))
    own = {c: f"_own_{c}" for c in docs.columns}
    given = docs.withColumns({"_src": F.col("source").cast("string"), "_size": size_of(), "_mark": hash_number()}).withColumnsRenamed(own)
    given = given.withColumnsRenamed({"_src": "source", "_size": "size", "_mark": "mark"})
    taken = mix.copies(given).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select([F.col(own[c]).alias(c) for c in docs.columns])
