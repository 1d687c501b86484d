"""Secret scans with SQL functions alone: fixed patterns, and character Markov models.

The base patterns give spans of the kinds ``assign``, ``access`` and ``hex``. A further kind,
``markov``, comes from comparing two bigram models of characters, one of random strings and one of
ordinary identifiers, by their log-likelihood ratio on every long run of key characters. The models
are counted on labelled samples of at most about ``fit_rows`` documents: the values that the base
patterns find are random strings, words outside them are ordinary; both are smoothed, the random one
towards the uniform distribution. What else is ordinary, numbers, rules, ids and names in capitals, has
models of its own, counted on samples made by rule, and the one that fits a run best is compared. A run that touches a base span is left out.

Positions count code points, ends are exclusive. They follow from the lengths of the matches and of
the pieces that ``split`` leaves between them. A fold that appends copies what it has so far, so sums run
over chunks of ``CHUNK`` matches, then over the chunks' totals: a text with n matches costs
``n * (CHUNK + n / CHUNK**2)`` steps and not n squared.

Cases: a null or empty text has no spans; a table without base matches leaves the random model
uniform; ties don't occur, as spans of a kind don't overlap; repeated rows get equal results; texts of
any length are searched whole; an empty table gives no rows; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
# Fixed values of the contract.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

LONG_ACCESS, LONG_HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=\x00-])[A-Za-z0-9+/_=-]{20,}+(?!\x00)"
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z0-9_-]{4,18}+(?![A-Za-z0-9+/_=-])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SPAN = "array<struct<start:int,kind:int,stop:int>>"
CHUNK = 128
#: Stands for each character of a base span where further spans are looked for; no key has it.
MASK = "\u0000"


def _matched(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def _pieces(text: Column, pattern: str) -> tuple[Column, Column]:
    """The leftmost non-overlapping matches, and what stands before, between and after them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _with_spans(df: DataFrame, text: str, pattern: str, kind: int, keep, name: str) -> DataFrame:
    """df with the array ``name`` of the spans of the matches in ``text`` that ``keep`` accepts, in order.

    Columns of their own for what is used more than once, so that it is computed once.
    """
    found, between = _pieces(F.col(text), pattern)
    step = lambda m, p: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), keep(m).alias("keep"))
    df = df.withColumn("_steps", F.when(_matched(F.col(text), pattern), F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), step)))
    last = F.floor((F.size("_steps") - 1) / CHUNK).cast("int")
    df = df.withColumn("_chunks", F.when(F.size("_steps") > 0, F.transform(F.sequence(F.lit(0), last), lambda c: F.slice("_steps", c * CHUNK + 1, F.lit(CHUNK)))))
    totals = F.transform("_chunks", lambda c: F.aggregate(c, F.lit(0), lambda acc, s: acc + s["gap"] + s["size"]))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    bases = F.aggregate(totals, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    df = df.withColumn("_bases", bases)

    def within(chunk: Column, base: Column) -> Column:
        def add(acc, s):
            start = acc["at"] + s["gap"]
            one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + s["size"]).alias("stop")))
            return F.struct((start + s["size"]).alias("at"), F.when(s["keep"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(chunk, F.struct(base.alias("at"), F.array().cast(SPAN).alias("out")), add, lambda acc: acc["out"])

    return df.withColumn(name, F.coalesce(F.flatten(F.zip_with("_chunks", "_bases", within)), F.array().cast(SPAN))).drop("_steps", "_chunks", "_bases")


def _masked(text: str, pattern: str, keep) -> Column:
    """text with each character of the accepted matches replaced by MASK."""
    found, between = _pieces(F.col(text), pattern)
    pieces = F.zip_with(between, found, lambda p, m: F.concat(p, F.when(m.isNull(), "").when(keep(m), F.repeat(F.lit(MASK), F.length(m))).otherwise(m)))
    return F.when(_matched(F.col(text), pattern), F.array_join(pieces, "")).otherwise(F.col(text))


def _long_value(m: Column) -> Column:
    return F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8


def _always(m: Column) -> Column:
    return F.lit(True)


# a run is taken whole, so asking for its least length finds the same spans as filtering after
_BASE = ((ASSIGN, _long_value), (LONG_ACCESS, _always), (LONG_HEX, _always))


def transition_counts(docs: DataFrame, fit_rows: int) -> dict[tuple[int, int, int], int]:
    """{(label, first, second character): count}; label 1 for random strings, 0 for ordinary words."""
    share = min(1.0, fit_rows / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30)).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    values = F.concat(
        F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all(text, F.lit(LONG_ACCESS), F.lit(0)), F.regexp_extract_all(text, F.lit(LONG_HEX), F.lit(0))
    )
    rest = text
    for pattern in (ASSIGN, LONG_ACCESS, LONG_HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    words = F.regexp_extract_all(rest, F.lit(WORD), F.lit(0))
    tokens = sample.select(F.explode(F.array(F.struct(F.lit(1).alias("label"), F.filter(values, lambda v: F.length(v) >= 8).alias("s")), F.struct(F.lit(0).alias("label"), words.alias("s")))).alias("x"))
    tokens = tokens.select(F.col("x.label").alias("label"), F.col("x.s").alias("s")).select("label", F.explode("s").alias("s"))
    codes = tokens.select("label", F.transform(F.split("s", ""), lambda c: F.ascii(c)).alias("codes"))
    pairs = codes.select("label", F.explode(F.arrays_zip(F.col("codes").alias("a"), F.slice("codes", F.lit(2), F.size("codes")).alias("b"))).alias("p"))
    counted = pairs.where("p.b is not null").groupBy("label", "p.a", "p.b").count()
    return {(r["label"], r["a"], r["b"]): r["count"] for r in counted.collect()}  # at most 2 x 67 x 67 rows


def ordinary_forms(counts: dict[tuple[int, int, int], int]) -> list[dict[tuple[int, int], float]]:
    """Transition counts of forms that ordinary strings have besides words: labelled samples that are made by rule.

    Numbers in groups (dates, telephone and article numbers), rules of one or two marks, hexadecimal ids in
    either case, and the words of the text joined by marks, in capitals, and run together with capitals.
    """
    digits, marks = "0123456789", "-_/.=+"
    pairs = lambda first, second, weight: {(ord(a), ord(b)): weight for a in first for b in second}
    numbers = pairs(digits, digits, 30.0) | pairs(digits, marks, 10.0) | pairs(marks, digits, 30.0)
    rules = {(ord(c), ord(c)): 300.0 for c in ALPHABET} | {(ord(a), ord(b)): 50.0 for a in marks for b in marks if a != b}
    hexes = [pairs(h, h, 20.0) | pairs(h, "-", 20.0) | pairs("-", h, 20.0) for h in (digits + "abcdef", digits + "ABCDEF")]
    words: dict[tuple[int, int], float] = {}
    for (label, a, b), n in counts.items():
        if not label and chr(a).isalpha() and chr(b).isalpha():
            key = ord(chr(a).lower()), ord(chr(b).lower())
            words[key] = words.get(key, 0) + n
    letters: dict[int, float] = {}
    for (_, b), n in words.items():
        letters[b] = letters.get(b, 0) + n
    raised = lambda c: ord(chr(c).upper())
    total = max(1.0, sum(letters.values()))
    joined, capitals, camel = dict(words), {(raised(a), raised(b)): n for (a, b), n in words.items()}, dict(words)
    for c, n in letters.items():  # a word has seven letters or so
        for m in marks:
            for names, own in ((joined, c), (capitals, raised(c))):
                names[own, ord(m)] = names.get((own, ord(m)), 0) + n / 7 / len(marks)
                names[ord(m), own] = names.get((ord(m), own), 0) + n
        for d, k in letters.items():
            camel[c, raised(d)] = n / 7 * k / total
    camel |= {(raised(a), b): n for (a, b), n in words.items()}
    return [numbers, rules, *hexes, *([joined, capitals, camel] if words else [])]


def ratio_tables(counts: dict[tuple[int, int, int], int]) -> list[list[float]]:
    """log P(b | a, random) - log P(b | a, ordinary) at index 128 a + b, for each model of ordinary strings.

    The first is counted on the words of the text, the others on ``ordinary_forms``.
    """
    codes = [ord(c) for c in ALPHABET]
    ends = {b: 0.5 + sum(counts.get((0, a, b), 0) for a in codes) for b in codes}
    forms = ordinary_forms(counts)
    out = [[0.0] * (128 * 128) for _ in range(1 + len(forms))]
    for a in codes:
        rows = [[counts.get((label, a, b), 0) for b in codes] for label in (0, 1)]
        ordinary, random = sum(rows[0]), sum(rows[1])
        rest = max(0.05, 20 / (ordinary + 20))  # what transitions never seen share; all where few samples speak
        share = 0.5 * random / (random + 200)
        sums = [sum(f.get((a, b), 0) for b in codes) for f in forms]
        for k, b in enumerate(codes):
            q = share * (rows[1][k] + 0.5) / (random + 0.5 * len(codes)) + (1 - share) / len(codes)
            p = (1 - rest) * rows[0][k] / max(1, ordinary) + rest * (0.5 * ends[b] / sum(ends.values()) + 0.5 / len(codes))
            out[0][128 * a + b] = round(math.log(q / p), 4)
            for form, total, table in zip(forms, sums, out[1:]):
                known = total / (total + 10)
                p = 0.95 * known * form.get((a, b), 0) / max(total, 1e-9) + (1 - 0.95 * known) / len(codes) / (1 if known else 20)
                table[128 * a + b] = round(math.log(q / p), 4)
    return out


def _ratio(token: Column, tables: list[Column]) -> Column:
    """Mean log-likelihood ratio of a token's transitions, to the model of ordinary strings that fits it best."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    n = F.length(token) - 1
    places = F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * 128 + b + 1)
    mean = lambda table: F.aggregate(places, F.lit(0.0), lambda acc, i: acc + F.element_at(table, i), lambda acc: acc / n)
    return F.least(*[mean(t) for t in tables])


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def scan(docs: DataFrame, fit_rows: int = 4_000, least_mean: float = 0.6) -> DataFrame:
    """(doc_id, base, extra): arrays of spans (start, kind, stop), kind counting through KINDS."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ratios = ratio_tables(transition_counts(docs, fit_rows))
    tables = [F.split(F.lit(",".join(map(str, r))), ",").cast("array<double>") for r in ratios]  # each folded into one literal
    found = docs.withColumn("rest", F.col("text"))
    for kind, (pattern, keep) in enumerate(_BASE):
        found = _with_spans(found, "text", pattern, kind, keep, KINDS[kind])
        found = found.withColumn("rest", _masked("rest", pattern, keep))  # so that no further span touches this one
    found = _with_spans(found.drop("text"), "rest", CANDIDATE, 3, lambda m: _ratio(m, tables) >= least_mean, "extra")
    return found.select("doc_id", F.concat(*KINDS[:3]).alias("base"), "extra")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    found = scan(docs)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "extra")).alias("spans"),
        F.size("extra").cast("long").alias("n_markov"),
    )
