"""The corpus pipeline: five operators in a row, each stage written as Parquet and read again.

In all stages equal rows go or stay together, rows that share an id are judged by their own texts, columns beside those of documents are
dropped, whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantus.llm import decontam, langid, linededup, mixing, setjoin
from cantus.llm.store import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that language identification does not reject; learns from the labelled ones. Null texts and those without a letter are no language: they go."""
    found = langid.predict(docs, langid.train_model(docs, F.lit(True)), keep=COLUMNS)
    return found.filter(~F.col("rejected")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later copies of lines; documents whose lines all went go too. Null, empty and blank texts have no lines to lose, and stay."""
    out = linededup.dedup_lines(docs)
    left = (F.col("n_lines_removed") == 0) | (F.length(F.btrim("text")) > 0)
    return out.filter(left).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that n-gram links connect. Null and empty texts are in no group, and null ids are no later copy: they stay."""
    later = setjoin.row_components(docs).filter("component_id < doc_id").select(F.col("doc_id").alias("id"), F.col("row").alias("key")).distinct()
    rows = docs.select(F.struct(*COLUMNS).alias("kept"), F.col("doc_id").cast("bigint").alias("id"), setjoin.text_key().alias("key"))
    return rows.join(later, ["id", "key"], "left_anti").select("kept.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the benchmark. Null and empty texts hold none; an empty benchmark drops nothing."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; none of null, empty and blank texts. A null source is a source."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
]

#: SQL can't express the trained and retrieving stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, in order; each is written to the shared folder and read as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
