"""From raw documents to packed training sequences, stage by stage.

Every stage gets the rows its predecessor kept and is written to the shared folder before the
next one reads it; all but the last return the columns of `documents`:

1. toxicity: documents that the model calls toxic go;
2. exact dedup: of equal texts, the one with the smallest doc_id stays;
3. SimHash near-dedup: of each group of linked fingerprints, the smallest doc_id stays;
4. benchmark decontamination: documents that hold a benchmark window go;
5. best-fit packing: token pieces with their sequence and place.

An empty table passes through all stages; null and empty texts, repeated rows and other
columns are treated as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderlens.llm import decontaminate, exact, packing, simhash, toxicity
from orderlens.llm.common import table
from orderlens.session import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Models, tokenizer and 64-bit fingerprints are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
