"""The corpus pipeline: documents in, packed training sequences out.

Every stage works on all rows that the stage before kept, is written as parquet to the shared folder
and read back, so a lost executor costs the stage at hand at most.  The stages:

1. language ID (operator 6): documents in no recognised language go;
2. exact dedup (operator 5): of equal texts the row with the smallest id stays;
3. n-gram Jaccard join (operator 7, five words, 0.8): one document of each component stays;
4. benchmark decontamination (operator 10): documents that hold a window of a test item go;
5. packing (operator 4): the documents left, as pieces in sequences.

All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitefold.llm.common import new_dir
from sitefold.llm.decontaminate import clean
from sitefold.llm.exact_dedup import survivors
from sitefold.llm.jaccard_join import one_of_each
from sitefold.llm.language_id import recognised
from sitefold.llm.packing import pack


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recognised(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return survivors(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Token ids are not a matter of SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = new_dir(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
