"""Training pairs from match results: one positive a query, hard negatives by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import near_duplicate


def mine_pairs(ranked: DataFrame, negatives: int = 3, exclude: tuple = ()) -> DataFrame:
    """(q_id, query, positive, negatives). ranked: q_id, city, query, c_id, text, rank, verified.

    The positive is the verified row of the lowest rank. Negatives are the first `negatives` unverified rows, among the first twice as many,
    that aren't near duplicates of the positive; if all of those are, the first of them unfiltered. Queries without either give no row."""
    rows = ranked.where("rank > 0")
    if exclude:
        rows = rows.where(~F.col("city").isin(*exclude))
    positive = rows.where("verified").groupBy("q_id").agg(F.min_by("text", "rank").alias("positive"), F.min_by("query", "rank").alias("query"))
    order = Window.partitionBy("q_id").orderBy("rank")
    scan = rows.where("not verified").withColumn("n", F.row_number().over(order)).where(F.col("n") <= 2 * negatives).drop("query").join(positive, "q_id")
    scan = scan.withColumn("near", near_duplicate(F.col("positive"), F.col("text")))
    own = scan.groupBy("q_id", "query", "positive").agg(F.sort_array(F.collect_list(F.struct("n", "text", "near"))).alias("r"))
    accepted = F.filter("r", lambda x: ~x["near"])
    chosen = F.slice(F.when(F.size(accepted) > 0, accepted).otherwise(F.col("r")), 1, negatives)
    return own.withColumn("chosen", chosen).select("q_id", "query", "positive", F.col("chosen.text").alias("negatives"))


def split(df: DataFrame, key: str, percent: int = 10, seed: str = "42") -> DataFrame:
    """df with `part`: val for about percent of the keys, else train; the same on each run and at each size."""
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 7), 16, 10).cast("long") % 100
    return df.withColumn("part", F.when(bucket < percent, "val").otherwise("train"))


def ir_corpus(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, documents, relevance) of mined pairs."""
    queries = pairs.select("q_id", "query")
    texts = pairs.select(F.explode(F.concat(F.array("positive"), "negatives")).alias("text")).distinct()
    documents = texts.select(F.md5("text").alias("doc_key"), "text")
    return queries, documents, pairs.select("q_id", F.md5("positive").alias("doc_key"))
