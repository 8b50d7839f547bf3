"""A pipeline over `documents`: quality rules, line dedup, near duplicates, mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm import bpe, jaccard, linededup, mixing, quality
from concordia.llm.common import Scratch, fresh


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Texts stay with their rows: no join is needed to act on the verdicts by host. Columns of any name stay as they are, one named like the
    verdict too."""
    (verdict,) = fresh([*docs.columns, *quality.ADDED], "verdict")
    judged = quality.judge(docs, carry=tuple(docs.columns), verdict=verdict)
    return judged.where(F.col(verdict)).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; n_chars follows the text, if there is one. A document of which nothing is left stays, empty. Other columns stay as they are, whatever their names."""
    out = linededup.dedup_lines(docs, counts=fresh(docs.columns, "n_lines", "n_dropped"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return jaccard.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and digests of the ids and of what they decode to."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixture), ("bpe", tokens)]

#: Components of near copies and BPE are beyond SQL. tests/llm holds all rows of run() against a plain twin of the five stages, and each stage's operator against SQL, the library or brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
