"""A corpus pipeline of five stages over `documents`, each an operator of webextract.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's docs. All but
the last return the columns of documents. The mixing stage orders its files, and the last stage writes the ids in that order.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webextract.llm import decontaminate, mixing, quality_classifier, simhash, token_output
from webextract.llm.common import Workspace

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    return quality_classifier.keep_good(docs, _table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: similarity of five-word shingles of 0.8 or more."""
    return simhash.one_of_each(docs, simhash.near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order in which every stretch has the sources' target weights."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the ids of the documents in the order of their files, or of doc_id where they don't come from files, and reads them back."""
    import public_tokenizers

    try:
        place = docs.select("*", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("__file"), F.col("_metadata.file_name").alias("__name"), F.col("_metadata.row_index").alias("__row"))
        docs, order = place, [F.col("__file"), F.col("__name"), F.col("__row")]
    except AnalysisException:
        order = None
    out = Workspace(spark).path
    token_output.write_ids(docs, out, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, order=order, added=True)
    return token_output.read_ids(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mix),
    ("token_ids", token_ids),
]

#: SQL can't express the trained classifier and the tokenizer; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, space = _table(spark, sf_dir, "documents"), Workspace(spark)
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{space.path}/{name}")
        docs = spark.read.parquet(f"{space.path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
