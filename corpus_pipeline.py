"""A training-data pipeline over ``documents``: five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; it works on all rows its
predecessor kept and all but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsum.llm.bpe_codec import bpe_codec
from kinsum.llm.common import cut, table
from kinsum.llm.decontam import clean
from kinsum.llm.line_dedup import added, line_dedup
from kinsum.llm.near_dedup import near_dedup
from kinsum.llm.quality_cnn import accepted
from kinsum.llm.registry import tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; n_chars is that of what is left."""
    out = line_dedup(docs)
    (removed,) = added(docs, "_n_removed")
    n = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (shingles of five words, similarity 0.8) the document with
    the smallest id stays."""
    gone = near_dedup(docs, width=5).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    gone = cut(gone, "near-gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_id"], "left_anti")


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the identifiers and of the decoded text."""
    return bpe_codec(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", new_lines),
    ("near dedup", one_of_each),
    ("decontamination", uncontaminated),
    ("BPE encoding and decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else cut(docs, "stage"), sf_dir)
    return docs


#: The classifier is trained, which SQL cannot express; tests compare run() with brute force.
ORACLE_SQL = None
