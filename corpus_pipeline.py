"""A corpus pipeline of five operators, each on all that the one before kept.

Language ID drops rows whose language it rejects, exact dedup and the n-gram
Jaccard join keep one row of each group (the smallest id), mixing repeats or
drops rows to meet its sources' targets, and packing cuts what is left into
sequences of tokens. All stages but the last return the columns of
``documents``. A document that mixing takes twice is packed twice. Null, empty
and letterless texts go with the language they have not; null ids are never
near duplicates; repeated rows go in exact dedup. An empty table of documents
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, language, mixing, packing, partenum
from graphloom.llm.common import fold, made, new_path, release
from graphloom.llm.queries import tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = language.identify(docs, fold("doc_id", 4) != 2)
    return out.where(~F.col("rejected")).select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs).where("kept").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = partenum.near_duplicates(docs)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(mixing.mix(docs), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has neither the compressor nor the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = made()
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark, keep=(path,), since=since)  # a stage's own tables, and the one before's result
    return docs
