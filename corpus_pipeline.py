"""Corpus pipeline: from raw documents to packed sequences in five stages.

Every stage but the last returns the columns of ``documents``. Rejected
documents go in the first stage; boilerplate lines go in the second, which also
sets n_chars to the new length; of near-duplicates (five words, similarity 0.8)
the document with the smallest doc_id stays; mixing repeats documents; packing
returns the pieces with their places.

Null and empty texts have no words and go in the first stage, as base rules have
it. Rows without doc_id go through all stages: line dedup and near duplicates
leave them alone, mixing and packing treat them like others. Rows that repeat a
doc_id are one document to near duplicates and stay or go together. A null source
is a source. Columns that documents don't need pass through, whatever their names.
Very long texts are read whole. An empty table gives empty stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import jaccard, lines, mixing, packing, rules
from shelfmark.storage import materialize

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.kept_rows(docs, rules.learn_from(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedup(docs).select(docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, width=5, num=80, den=100)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(docs, TOKENIZER)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]
#: SQL can't express the learned list, the sampled mix or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
