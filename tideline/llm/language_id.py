"""Language identification by error-correcting output codes.

Every language gets a codeword of bits. One binary classifier a bit (logistic regression over hashed
byte n-grams, fitted in numpy) predicts its bit for a text; the language whose codeword has the
least loss, bits weighted by how well they were learned, wins. The softmax of the negative losses is
the score, and a text whose two best codewords are close is flagged as ambiguous.

Fitting takes a bounded sample, chosen by a hash of the text: of the ``max_languages`` most frequent
labels (ties by code point) about ``per_lang`` rows each, fewer where that would be more than
``max_rows`` in all, and one at least. Prediction covers whole texts of all rows, with the text alone.

Cases: a null text or one without a letter is ``und`` with score 0; a row without a label is never
fitted on; with one label known all texts with letters get it, with none they are ``und``; equal
losses go to the first language in code-point order; repeated rows get equal results; a text of any
length is read in pieces of 1 MB that share three bytes, and every n-gram counts once; columns named
like a result are replaced by ``predict`` and come back unchanged from ``accepted``; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"
DIM_BITS = 12
DIM = 1 << DIM_BITS
PIECE = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_CLEAN = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed 2-, 3- and 4-gram counts."""
    letters = b" ".join(text.lower().encode("utf-8", "replace").translate(_CLEAN).split())
    letters = b" " + letters + b" " if letters else b""
    out = np.zeros(DIM, np.float32)
    for at in range(0, len(letters), PIECE):  # bounds memory; an n-gram belongs to the piece it begins in
        x = np.frombuffer(letters[at : at + PIECE + 3], np.uint8).astype(np.uint32)
        two = x[:-1] * np.uint32(0x1F1) + x[1:]
        three = two[:-1] * np.uint32(0x1F1) + x[2:]
        four = three[:-1] * np.uint32(0x1F1) + x[3:]
        for k, h in enumerate((two, three, four)):
            spread = (h[:PIECE] + np.uint32(k * 0x51ED27)) * np.uint32(0x9E3779B1)
            out += np.bincount(spread >> np.uint32(32 - DIM_BITS), minlength=DIM)
    out = np.sqrt(out)
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def codewords(n: int) -> np.ndarray:
    """n distinct codewords of +1 and -1, no bit the same for all and no split of the languages twice.

    Up to 6 languages: every split there is. Beyond that: the best separated of 100 random codes.
    """
    if n <= 6:
        splits = range(max(0, 2 ** (n - 1) - 1))  # language 0 is always +1; all ones would split nothing
        return np.array([[1 if r == 0 or b >> (r - 1) & 1 else -1 for b in splits] for r in range(n)], np.float32).reshape(n, len(splits))
    best, gap, bits = None, -1, int(np.ceil(10 * np.log2(n)))
    for seed in range(100):
        rng, columns = np.random.default_rng(seed), {}
        while len(columns) < bits:
            c = np.where(rng.random(n) < 0.5, -1, 1).astype(np.float32)
            if abs(c.sum()) < n:
                columns.setdefault((c * c[0]).tobytes(), c)
        code = np.stack(list(columns.values()), axis=1)
        near = code @ code.T - 2 * bits * np.eye(n)
        if (distance := (bits - near.max()) / 2) > gap:
            best, gap = code, distance
    return best


class Model:
    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 4.0, decay: float = 1e-5):
        """x: feature rows; y: index of each row's language."""
        self.languages, self.code = languages, codewords(max(1, len(languages)))
        target = self.code[y]
        weight = (1 / np.maximum(1, np.bincount(y, minlength=len(languages))))[y].astype(np.float32)[:, None]
        weight /= weight.sum()
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        w = np.zeros((x.shape[1], self.code.shape[1]), np.float32)
        v = w.copy()
        for k in range(steps if w.size else 0):
            slope = -target * weight / (1 + np.exp(target * (x @ v)))
            new = v - rate * (x.T @ slope + decay * v)
            v, w = new + k / (k + 3) * (new - w), new
        self.w = w
        loss = (weight * np.logaddexp(0, -target * (x @ w))).sum(axis=0) if len(x) else np.ones(w.shape[1])
        self.bit_weight = (1 / (loss + 0.05) / np.mean(1 / (loss + 0.05))).astype(np.float32) if w.size else np.ones(0, np.float32)

    def predict(self, texts: list[str | None]):
        """(language, score, ambiguous) of each text."""
        out = []
        for text in texts:
            if not self.languages or text is None or not _LETTER.search(text):
                out.append((UNDETERMINED, 0.0, True))
                continue
            z = features(text) @ self.w[:-1] + self.w[-1]
            loss = (np.logaddexp(0, -self.code * z) * self.bit_weight).sum(axis=1)
            p = np.exp(loss.min() - loss)
            p /= p.sum()
            best = int(np.argmin(loss))
            second = np.partition(p, -2)[-2] if len(p) > 1 else 0.0
            out.append((self.languages[best], float(p[best]), bool(p[best] < 2 * second)))
        return out


def _features_of(batches):
    for batch in batches:
        rows = [features(t or "") for t in batch.column("text").to_pylist()]
        at = [np.flatnonzero(r).astype(np.int32) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("h"), pa.array(at, pa.list_(pa.int32())), pa.array([r[a] for r, a in zip(rows, at)], pa.list_(pa.float32()))],
            names=["lang", "h", "at", "value"],
        )


def fit(labelled: DataFrame, per_lang: int = 300, max_rows: int = 3000, max_languages: int = 8192) -> Model:
    """A model from rows (text, lang); rows without a lang or text are left out."""
    labelled = labelled.where("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Model([], np.zeros((0, DIM), np.float32), np.zeros(0, np.int64))
    wanted = min(per_lang, max(1, max_rows // len(languages)))
    share = [(r["lang"], int(min(1.0, (1.2 * wanted + 4 * wanted**0.5) / r["n"]) * (1 << 30))) for r in counts]
    share = labelled.sparkSession.createDataFrame(share, "lang string, below long")  # max_languages rows at most
    h = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30))
    sample = labelled.withColumn("h", h).join(F.broadcast(share), "lang").where("h < below").select("text", "lang", "h")
    sample = sample.dropDuplicates(["lang", "h"])  # copies speak once
    sample = sample.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= 2 * wanted)
    rows = sample.select("text", "lang", "h").mapInArrow(_features_of, "lang string, h long, at array<int>, value array<float>").orderBy("h", "lang").toArrow()
    x = np.zeros((rows.num_rows, DIM), np.float32)
    for i, (at, value) in enumerate(zip(rows.column("at"), rows.column("value"))):
        x[i, at.values.to_numpy()] = value.values.to_numpy()
    place = {lang: k for k, lang in enumerate(languages)}
    return Model(languages, x, np.array([place[lang] for lang in rows.column("lang").to_pylist()], np.int64))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and ambiguous; columns of these names are replaced."""
    names = ["lang_pred", "score", "ambiguous"]
    docs = docs.select([c for c in docs.columns if c not in names])
    if dict(docs.dtypes)["text"] != "string":
        docs = docs.withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.limit(0).selectExpr("*", "'' as lang_pred", "cast(0 as double) as score", "false as ambiguous").schema

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = shared.value.predict(part.column("text").to_pylist())
                arrays = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=part.schema.names + names)

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True for rows that are never learned from: crc32 of the id as text divides by 5 (null: as '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), learned from the labelled rows not held out."""
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text is in one of the languages learned; others (``und``) go."""
    model = fit(docs.where(~held_out()))
    own = {c: f"_own_{c}" for c in docs.columns if c in ("lang_pred", "score", "ambiguous")}
    found = predict(docs.withColumnsRenamed(own), model).where(F.col("lang_pred") != UNDETERMINED)
    return found.select([F.col(own.get(c, c)).alias(c) for c in docs.columns])
