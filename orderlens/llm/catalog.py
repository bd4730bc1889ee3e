"""Registered queries of this package: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderlens.llm import (
    codes,
    compress,
    decontaminate,
    exact,
    language,
    oracles,
    packing,
    pages,
    pii,
    routed,
    simhash,
    toxicity,
    turns,
    warc,
)
from orderlens.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.decontaminate(docs, benchmark))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress.score_documents(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode_vectors(table(spark, sf_dir, "embeddings"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_conversations(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_pii": op1_pii,
    "op2_language": op2_language,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_main_text": op5_main_text,
    "op6_decontamination": op6_decontamination,
    "op7_ppm": op7_ppm,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_simhash": op10_simhash,
    "op11_codes": op11_codes,
    "op12_neighbours": op12_neighbours,
    "op13_turns": op13_turns,
    "pipeline": pipeline,
}

ORACLES = oracles.ORACLES
