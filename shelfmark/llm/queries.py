"""The queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize
from . import capjoin, htmltext, jaccard, lines, mixing, packing, quality, rules, secretscan, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(digests)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(secretscan.scan(table(spark, sf_dir, "documents"), secretscan.default_network()))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capjoin.join(table(spark, sf_dir, "embeddings"), least=0.93)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = rules.learn_from(docs, labels)
    return rules.judge(docs, learned, ["doc_id"])


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = materialize(quality.prepared(table(spark, sf_dir, "documents")), "features")
    return quality.score(prepared, quality.learn(prepared, table(spark, sf_dir, "labels")))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_secret_scan": op3_secret_scan,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_source_mixing": op8_source_mixing,
    "op9_warc": op9_warc,
    "op10_html_extraction": op10_html_extraction,
}
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": jaccard.ORACLE,
    "op4_embedding_near_dedup": capjoin.ORACLE,
    "op5_line_dedup": lines.ORACLE,
    "op9_warc": warc.ORACLE,
}
