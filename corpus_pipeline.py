"""Documents to token files in five stages, each written as Parquet and read back for the next.

1. language_id: texts that no learned language claims (null, or without a letter) go.
2. jaccard_dedup: of each group of near copies the row with the smallest doc_id stays.
3. decontaminate: documents that hold a 10-word window of a benchmark item go.
4. mix: rows are repeated or left out so that every source meets its token target.
5. token_files: the rows become token files; their digests, read back, are the result.

Cases: a null text or one without a letter goes in stage 1, whatever its other columns; null lang, source
and doc_id are kept (a null source is a source of stage 4, rows without doc_id are never dropped as
copies); rows that repeat an id and text count as copies in stage 2; ties go to the smallest doc_id; texts
of any length are read whole; an empty table gives an empty table in every stage, and so does one without
a labelled language; the columns that came in, whatever their names, go out of stages 1 to 4 unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontaminate, language_id, mixing, near_join, token_files
from tideline.llm.common import Scratch, table
from tideline.llm.queries import tokenizer_path


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.one_per_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # workers hold what earlier stages left as well, so fewer pieces than by default
    return token_files.encode_and_read(docs, tokenizer_path("byte_bpe_50k.json"), remembered=80_000)


STAGES = [
    ("language_id", keep_languages),
    ("jaccard_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("token_files", write_tokens),
]

#: Fitted classifiers, MinHash, entropy balancing and a tokenizer have no SQL; tests compare instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.saved(stage(spark, docs, sf_dir), name)
    return docs
