"""Masked pseudo-likelihood: a bidirectional window network predicts every word from both sides.

Words of the whole corpus are counted. The network's classes are the most frequent ones and a number
of hash buckets for all others; a word in a bucket has the share of the bucket's count that its own
count is, so every word of the corpus has its own probability. The counts of the most frequent
``KNOWN`` words are broadcast, those of all others are joined by word. The network sums one embedding
for each of the ``2 * reach`` neighbours of a masked word, applies tanh, and predicts the word by a
two-level softmax (a group, then a member of it), so probabilities are normalised over the whole
vocabulary. A document's score is the sum of the log-probabilities of its words given the words
around them.

Training is one pass of Adagrad over the corpus, in numpy. Documents are dealt by a hash of their id
and text into shards of about ``SHARD_WORDS`` words, ``MOST_SHARDS`` at most; a shard starts from the
unigram model and takes its documents in the order of that hash, every word a target, once, in batches
of ``BATCH``. Its weights go to the shared folder, and are averaged by number of targets in rounds of
``ROUND``, so that neither a task nor the driver ever holds more than that. Neither files nor partitions
nor the number of executors have a say in the model.

Cases: null, empty and wordless texts have no words, log_prob 0 and no mean; an empty corpus leaves
the unigram model; repeated rows count, and score, each, and those that repeat both id and text train in
one shard (copies with ids of their own are spread); a word that the counts lack has the share of
a count of one; texts of any length are taken in slices of about 1 MB and one text at least; columns
other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import textwords
from tideline.llm.common import Scratch

GROUPS = 60
CLASSES = GROUPS * GROUPS
RARE = 256  # a power of two, so that signed and unsigned hashes fall into the same buckets
REACH, WIDTH = 2, 24
#: Words whose counts each task has at hand; the rest of the corpus' words are joined.
KNOWN = 1 << 18
BATCH = 4096
#: Words of a training shard, until that makes MOST_SHARDS of them; weights averaged at a time.
SHARD_WORDS, MOST_SHARDS, ROUND = 1 << 21, 4096, 8


class Vocabulary:
    """Word hashes to classes: frequent words first, then RARE buckets by hash.

    in_buckets: the count of each bucket's words. Where no counts are given for scoring, the words of
    a bucket share its probability evenly: each costs ``rare_cost`` (the log of the mean number of
    distinct words in a bucket) besides.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, in_buckets: np.ndarray, distinct: int):
        self.rare_cost = float(np.log(max(1.0, (distinct - len(hashes)) / RARE)))
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.arange(len(hashes))[order]
        p = np.full(CLASSES, 1e-9)
        p[: len(counts)] += counts
        p[CLASSES - RARE :] += in_buckets
        self.in_buckets = in_buckets
        self.once = np.zeros(CLASSES)
        self.once[: len(counts)] = counts == 1
        self.unigram = p / p.sum()

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        rare = CLASSES - RARE + (hashes % np.uint64(RARE)).astype(np.int64)
        if not len(self.keys):
            return rare
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.ids[at], rare)


class Network:
    """embed and shift make the hidden values; group and member the two softmaxes, their last rows the biases."""

    def __init__(self, unigram: np.ndarray):
        rng = np.random.default_rng(11)
        p = unigram.reshape(GROUPS, GROUPS)
        self.w = {
            "embed": rng.normal(0, 0.1, (2 * REACH, CLASSES + 1, WIDTH)).astype(np.float32),
            "shift": np.zeros(WIDTH, np.float32),
            "group": np.zeros((WIDTH + 1, GROUPS), np.float32),
            "member": np.zeros((GROUPS, WIDTH + 1, GROUPS), np.float32),
        }
        self.w["group"][-1] = np.log(p.sum(axis=1))
        self.w["member"][:, -1] = np.log(p / p.sum(axis=1, keepdims=True))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.w.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, x in self.w.items():
            self.w[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def _forward(self, context: np.ndarray, target: np.ndarray):
        """Hidden values (and a column of ones) by target's group, exponentials of both softmaxes, the order by group and its cuts."""
        w = self.w
        group = target // GROUPS
        # rows in order of their groups, so that each group's are one slice
        order = np.argsort(group.astype(np.int16), kind="stable")
        cuts = np.searchsorted(group[order], np.arange(GROUPS + 1)).tolist()
        context = context[order]
        hidden = np.ones((len(target), WIDTH + 1), w["group"].dtype)
        x = w["embed"][0].take(context[:, 0], axis=0)
        for k in range(1, 2 * REACH):
            x += w["embed"][k].take(context[:, k], axis=0)
        x += w["shift"]
        np.tanh(x, out=hidden[:, :WIDTH])
        a = hidden @ w["group"]
        b = np.empty((len(target), GROUPS), hidden.dtype)
        for g in range(GROUPS):
            if cuts[g] < cuts[g + 1]:
                np.matmul(hidden[cuts[g] : cuts[g + 1]], w["member"][g], out=b[cuts[g] : cuts[g + 1]])
        for z in (a, b):
            if len(z) and np.abs(z).max() > 60:  # else exponentials neither overflow nor vanish
                z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
        return hidden, a, b, context, target[order], order, cuts

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target."""
        _, a, b, _, sorted_target, order, _ = self._forward(context, target)
        every, out = np.arange(len(target)), np.empty(len(target), a.dtype)
        group, member = sorted_target // GROUPS, sorted_target % GROUPS
        out[order] = np.log(a[every, group] / a.sum(axis=1) + 1e-30) + np.log(b[every, member] / b.sum(axis=1) + 1e-30)
        return out

    def gradient(self, context: np.ndarray, target: np.ndarray):
        """({name: slope}, [(classes, their slopes) for each neighbour's embeddings])."""
        w, n = self.w, self.w["group"].dtype.type(len(target))
        hidden, a, b, context, target, _, cuts = self._forward(context, target)
        every = np.arange(len(target))
        for z, own in ((a, target // GROUPS), (b, target % GROUPS)):
            z *= 1 / (z.sum(axis=1, keepdims=True) * n)
            z[every, own] -= 1 / n
        out = {"group": hidden.T @ a, "member": np.zeros_like(w["member"])}
        back = a @ w["group"][:-1].T
        for g in range(GROUPS):
            rows = slice(cuts[g], cuts[g + 1])
            if cuts[g] < cuts[g + 1]:
                np.matmul(hidden[rows].T, b[rows], out=out["member"][g])
                back[rows] += b[rows] @ w["member"][g, :-1].T
        h = hidden[:, :WIDTH]
        back *= 1 - h * h
        out["shift"] = back.sum(axis=0)
        embed = []
        for k in range(2 * REACH):  # sums of each class's rows
            by_class = np.argsort(context[:, k].astype(np.int16), kind="stable")
            classes = context[by_class, k]
            begins = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]])
            embed.append((classes[begins], np.add.reduceat(back.take(by_class, axis=0), begins, axis=0)))
        return out, embed


class Adagrad:
    def __init__(self, net: Network, rate: float):
        self.net, self.rate = net, np.float32(rate)
        self.square = {k: np.full_like(x, 1e-4) for k, x in net.w.items()}

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        dense, embed = self.net.gradient(context, target)
        for k, g in dense.items():
            self.square[k] += g * g
            self.net.w[k] -= self.rate * g / np.sqrt(self.square[k])
        for k, (classes, g) in enumerate(embed):  # the classes of a batch alone
            square = self.square["embed"][k][classes] + g * g
            self.square["embed"][k][classes] = square
            self.net.w["embed"][k][classes] -= self.rate * g / np.sqrt(square)


def windows(classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes of the REACH words before and after each word; CLASSES stands for none."""
    n = len(classes)
    row_start, row_end = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
    out = np.full((n, 2 * REACH), CLASSES, np.int64)
    every = np.arange(n)
    for k, step in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        at = every + step
        inside = (at >= row_start) & (at < row_end)
        out[inside, k] = classes[at[inside]]
    return out


def _count(batches):
    for batch in batches:
        for part in textwords.slices(batch, "text", 8 << 20):
            _, _, _, _, hashes, _ = textwords.words(part.column("text"))
            words, n = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


class Shard:
    """The training of one shard; what it learns depends on the words alone, not on how they come in."""

    def __init__(self, vocabulary: Vocabulary, rate: float):
        self.vocabulary, self.net = vocabulary, Network(vocabulary.unigram)
        self.adagrad, self.seen, self.held, self.context, self.target = Adagrad(self.net, rate), 0, 0, [], []

    def add(self, texts: pa.Array) -> None:
        _, _, _, _, hashes, first = textwords.words(texts)
        classes = self.vocabulary.classes(hashes)
        self.context.append(windows(classes, first))
        self.target.append(classes)
        self.held += len(classes)
        if self.held >= 16 * BATCH:
            self._learn(self.held // (16 * BATCH) * (16 * BATCH))

    def _learn(self, n: int) -> None:
        context, target = np.concatenate(self.context), np.concatenate(self.target)
        for begin in range(0, n, 16 * BATCH):
            order = begin + np.random.default_rng(self.seen).permutation(min(n - begin, 16 * BATCH))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                self.adagrad.step(context[some], target[some])
            self.seen += len(order)
        self.context, self.target, self.held = [context[n:]], [target[n:]], self.held - n

    def weights(self) -> tuple[int, bytes]:
        if self.held:
            self._learn(self.held)
        return self.seen, self.net.flat().astype("<f4").tobytes()


WEIGHTS = "shard long, n long, weights binary"


def _train(vocabulary, rate: float):
    """Weights of each shard of rows sorted by shard."""

    def row(shard, state):
        n, weights = state.weights()
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([n], pa.int64()), pa.array([weights], pa.binary())], names=["shard", "n", "weights"])

    def run(batches):
        now, state = None, None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a and shards[a] != now:
                    if state is not None:
                        yield row(now, state)
                    now, state = int(shards[a]), Shard(vocabulary.value, rate)
                for part in textwords.slices(batch.slice(a, b - a), "text"):
                    state.add(part.column("text"))
        if state is not None:
            yield row(now, state)

    return run


def _average(batches):
    """One row for each run of rows with the same shard."""
    now, total, n = None, None, 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([n], pa.int64()), pa.array([(total / max(1, n)).astype("<f4").tobytes()], pa.binary())], names=["shard", "n", "weights"])

    for batch in batches:
        for shard, k, w in zip(batch.column("slot").to_pylist(), batch.column("n").to_pylist(), batch.column("weights").to_pylist()):
            if total is not None and shard != now:
                yield row()
                total, n = None, 0
            part = np.frombuffer(w, "<f4").astype(np.float64) * k
            now, total, n = shard, (part if total is None else total + part), n + k
    if total is not None:
        yield row()


class Counts:
    """Counts of the words in buckets: the frequent ones as arrays, the table for the others."""

    def __init__(self, words: DataFrame):
        """words: (word, n), one row a word."""
        size = F.floor(F.log2("n") * 8).cast("int")
        bins = sorted(((r[0], r["count"]) for r in words.groupBy(size.alias("size")).count().collect()), reverse=True)
        least, n = bins[0][0] + 1 if bins else 0, 0
        for k, more in bins:
            if (n := n + more) > KNOWN:
                break
            least = k
        known = words.where(size >= least).toPandas().sort_values("word")
        order = np.argsort(hashes := known["word"].to_numpy(np.int64).astype(np.uint64))
        self.keys, self.logs = hashes[order], np.log(known["n"].to_numpy(np.float64)[order])
        self.others = words.where(size < least)


def count_words(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n): how often each word occurs in all texts."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    return scratch.saved(texts.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def fit(docs: DataFrame, rate: float = 0.1, counts: DataFrame | None = None) -> tuple[Vocabulary, Network]:
    """The model of ``docs(doc_id, text)``; counts: those of ``count_words``, made where absent."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    own = count_words(docs, scratch) if counts is None else None
    counts = own if counts is None else counts
    buckets = counts.groupBy(F.pmod("word", F.lit(RARE)).alias("bucket")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    top = counts.orderBy(F.desc("n"), "word").limit(CLASSES - RARE).collect()
    hashes, frequent = np.array([r["word"] for r in top], np.int64).astype(np.uint64), np.array([r["n"] for r in top], np.float64)
    in_buckets = np.zeros(RARE)
    for r in buckets:
        in_buckets[r["bucket"]] = r["n"]
    total = int(in_buckets.sum())
    in_buckets -= np.bincount((hashes % np.uint64(RARE)).astype(np.int64), frequent, RARE)
    vocabulary = Vocabulary(hashes, frequent, in_buckets, sum(r["words"] for r in buckets))
    shared = spark.sparkContext.broadcast(vocabulary)

    shards = min(MOST_SHARDS, max(1, -(-total // SHARD_WORDS)))
    place = F.xxhash64("doc_id", "text", F.lit(11))
    dealt = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text <> ''").withColumn("place", place)
    dealt = dealt.withColumn("shard", F.pmod("place", F.lit(shards))).select("shard", "place", "text")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "place", "text")
    trained = scratch.saved(dealt.select("shard", "text").mapInArrow(_train(shared, rate), WEIGHTS), "weights")
    while (rows := trained.count()) > ROUND:
        slots = -(-rows // ROUND)
        some = trained.withColumn("slot", F.pmod("shard", F.lit(slots)).cast("long")).repartition(slots, "slot").sortWithinPartitions("slot", "shard")
        before, trained = trained, scratch.saved(some.select("slot", "n", "weights").mapInArrow(_average, WEIGHTS), "weights")
        scratch.drop(before)
    net, parts = Network(vocabulary.unigram), sorted((r["shard"], r["n"], r["weights"]) for r in trained.collect())
    if n := sum(k for _, k, _ in parts):
        net.load(sum(np.frombuffer(w, "<f4").astype(np.float64) * (k / n) for _, k, w in parts))
    scratch.drop(*([own] if own is not None else []), trained)
    return vocabulary, net


def score(docs: DataFrame, vocabulary: Vocabulary, net: Network, counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob, n_single) of every row.

    counts: those of ``count_words``. n_single: the words that the whole corpus has only once (0 where
    no counts are given).
    """
    spark = docs.sparkSession
    known = Counts(counts) if counts is not None else None
    shared = spark.sparkContext.broadcast((vocabulary, net, (known.keys, known.logs) if known else None))
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        vocabulary, net, known = shared.value
        for batch in batches:
            for part in textwords.slices(batch, "text"):
                _, _, _, _, hashes, first = textwords.words(part.column("text"))
                classes = vocabulary.classes(hashes)
                context, logs, single = windows(classes, first), np.zeros(len(classes)), np.zeros(len(classes))
                for at in range(0, len(classes), BATCH):
                    logs[at : at + BATCH] = net.log_probs(context[at : at + BATCH], classes[at : at + BATCH])
                rare, others = np.flatnonzero(classes >= CLASSES - RARE), np.zeros(0, np.int64)
                if known is None:
                    logs[rare] -= vocabulary.rare_cost
                else:
                    keys, counted = known
                    single = vocabulary.once[classes]
                    logs[rare] -= np.log1p(vocabulary.in_buckets)[classes[rare] - (CLASSES - RARE)]
                    at = np.minimum(np.searchsorted(keys, hashes[rare]), max(0, len(keys) - 1))
                    found = keys[at] == hashes[rare] if len(keys) else np.zeros(len(rare), bool)
                    logs[rare[found]] += counted[at[found]]
                    single[rare[found]] = counted[at[found]] == 0
                    others = rare[~found]
                n = np.diff(first)
                row = np.repeat(np.arange(part.num_rows), n)
                sums = np.bincount(row, logs, part.num_rows).astype(np.float64)
                singles = np.bincount(row, single, part.num_rows).astype(np.int64)
                words = pa.ListArray.from_arrays(pa.array(np.searchsorted(others, first), pa.int32()), pa.array(hashes[others].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums), pa.array(singles), words], names=["doc_id", "n_words", "log_prob", "n_single", "others"])

    scored = docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, log_prob double, n_single long, others array<long>")
    if known is not None:
        scored = Scratch(spark).saved(scored.withColumn("row", F.monotonically_increasing_id()), "scored")  # fixes the row numbers
        # no count of these words is large, so no word's rows are many
        occurs = scored.select("row", F.explode("others").alias("word")).join(known.others, "word")
        logs = F.sum(F.log("n").cast("decimal(28,12)")).cast("double")  # in any order the same
        scored = scored.drop("others").join(occurs.groupBy("row").agg(logs.alias("more"), F.count_if(F.col("n") == 1).alias("once")), "row", "left")
        scored = scored.withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0))).withColumn("n_single", F.col("n_single") + F.coalesce("once", F.lit(0)))
    return scored.select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob"), "n_single")


def fit_and_score(docs: DataFrame) -> DataFrame:
    counts = count_words(docs, Scratch(docs.sparkSession))
    return score(docs, *fit(docs, counts=counts), counts)
