"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import alignment, decontaminate, html_text, language_id, line_dedup, lm_scoring, mixing, near_join, phrases, secrets, token_files, topk, vectors
from tideline.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.fit_and_score(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_join(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.report(table(spark, sf_dir, "pages"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_files": op3_token_files,
    "op6_html_text": op6_html_text,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op10_mixing": op10_mixing,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_decontamination": op5_decontamination,
    "op9_jaccard_join": op9_jaccard_join,
    "op11_topk_search": op11_topk_search,
    "op12_collocations": op12_collocations,
    "op13_alignment": op13_alignment,
}

ORACLE = {
    "op12_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
        t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
        f AS (
            SELECT lang, size, array_to_string(ws[i : i + size - 1], ' ') AS phrase, count(*) AS f
            FROM w, (SELECT unnest(range(1, 6)) AS size), unnest(range(1, len(ws) - size + 2)) AS u(i) GROUP BY ALL HAVING count(*) >= 100),
        c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE size > 1),
        held AS (
            SELECT lang, array_to_string(ws[i : i + k - 1], ' ') AS phrase, max(a) AS longer
            FROM c, (SELECT unnest(range(2, 5)) AS k), unnest(range(1, size - k + 2)) AS u(i) WHERE k < size GROUP BY ALL),
        cut AS (
            SELECT c.lang, c.phrase, k, a, x.f AS l, y.f AS r, n, (1000 * a::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
            FROM c, unnest(range(1, c.size)) AS u(k), f x, f y, t
            WHERE x.lang = c.lang AND x.phrase = array_to_string(ws[1 : k], ' ') AND y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1 : c.size], ' ') AND t.lang = c.lang),
        best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        kept AS (SELECT b.* FROM best b LEFT JOIN held h ON b.lang = h.lang AND b.phrase = h.phrase WHERE longer IS NULL OR 100 * longer < 100 * a)
        SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM kept WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY rank <= 2000""",
    "op8_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
        t AS (SELECT source, count(*) AS total FROM d GROUP BY source),
        c AS (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(list_distinct(lines)) AS line FROM d) GROUP BY source, line),
        b AS (
            SELECT c.source, list(c.line) AS bad FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
            WHERE trim(c.line) <> '' AND c.n >= 5 AND c.n > 0.02 * t.total GROUP BY c.source)
        SELECT doc_id, array_to_string(list_filter(lines, lambda x: NOT coalesce(list_contains(bad, x), false)), chr(10)) AS text,
            CAST(coalesce(len(list_filter(lines, lambda x: coalesce(list_contains(bad, x), false))), 0) AS BIGINT) AS n_dropped
        FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source""",
    "op5_decontamination": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        i AS (
            SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
        iw AS (
            SELECT DISTINCT item_id, least(10, len(words)) AS size, array_to_string(words[k : k + least(10, len(words)) - 1], ' ') AS win
            FROM i, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS u(k) WHERE len(words) > 0),
        sizes AS (SELECT DISTINCT size FROM iw),
        dw AS (
            SELECT doc_id, size, k, array_to_string(words[k : k + size - 1], ' ') AS win
            FROM w, sizes, unnest(range(1, len(words) - size + 2)) AS u(k)),
        hit AS (SELECT dw.doc_id, dw.k, dw.size, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.size = iw.size),
        hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(k, k + size)) AS u(p) GROUP BY doc_id),
        hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
}
