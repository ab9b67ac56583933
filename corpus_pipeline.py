"""The corpus pipeline: language ID, near duplicates, decontamination, secrets, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents``. A stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import bpe
from matchloom.llm.common import table
from matchloom.llm.decontaminate import decontaminate
from matchloom.llm.language_id import keep_identified
from matchloom.llm.ngram_join import one_of_each
from matchloom.llm.queries import held_out, tokenizer_path, tokenizer_pattern
from matchloom.llm.secret_scan import redact_secrets
from matchloom.stage import staged_alone

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; ``lang`` is filled in where it was null.

    Texts without letters go, and so do those that the winning model codes no better than
    raw bytes.
    """
    kept = keep_identified(docs.select(*COLUMNS), trains=~held_out())
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of every group of near copies."""
    return one_of_each(docs.select(*COLUMNS))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced and ``n_chars`` counted again."""
    clean = redact_secrets(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    made = bpe.digests(docs, path=tokenizer_path(), pattern=tokenizer_pattern())
    return made.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: No SQL expresses language ID, string tiling, automata or merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage stages goes with it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged_alone(spark, name, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs
