"""The registered ``opN_*`` queries: each operator over its whole table with
production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinsum.llm.alignment import cross_alignment
from kinsum.llm.bpe_codec import bpe_codec
from kinsum.llm.common import table
from kinsum.llm.decontam import decontaminate
from kinsum.llm.exact_dedup import EXACT_SQL, exact_dedup
from kinsum.llm.line_dedup import line_digest, passage_sql
from kinsum.llm.near_dedup import near_dedup, near_sql
from kinsum.llm.ppm import ppm_scores
from kinsum.llm.quality_cnn import quality
from kinsum.llm.repeats import remove_repeats
from kinsum.llm.secrets import secret_scan
from kinsum.llm.simhash import simhash_dedup
from kinsum.llm.spelling import spelling_variants
from kinsum.llm.token_counts import token_counts


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(table(spark, sf_dir, "documents"))


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as op8_line_dedup, which has taken over its rule."""
    return op8_line_dedup(spark, sf_dir)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=4)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_alignment(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_exact_dedup, op3_token_counts, op4_ppm, op5_secret_scan, op6_bpe_codec, op7_quality_cnn,
        op8_line_dedup, op8_passage_dedup, op9_near_dedup, op10_repeats, op11_simhash, op12_alignment, op13_spelling,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": EXACT_SQL, "op8_line_dedup": passage_sql(), "op8_passage_dedup": passage_sql(), "op9_near_dedup": near_sql(4, 80)}
