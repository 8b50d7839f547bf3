"""Whole matching plans over canonical tables: q_id, q_name, q_addr, city, qv, truth; c_id, c_name, c_addr, city, cv."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_id
from ..functions.vectors import dot, maxsim
from ..operators import blocking, partitions, ranking


def canonical(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns by their canonical names (canonical: own); names that df lacks become null."""
    return df.select(*[(F.col(f"`{own}`") if own in df.columns else F.lit(None).cast("string")).alias(name) for name, own in columns.items()])


def dense_match(q: DataFrame, c: DataFrame, k: int, *, mode: str = "block", on_missing: str = "drop", verified: Column | None = None) -> DataFrame:
    """q_id, city, c_id, rank, similarity, verified. mode: block, tiled (block, by matrix products of tiles instead of a join of pairs), flat or metric (flat, by balls whose bounds leave out what can't be among the k best; for many candidates that lie in clusters).
    on_missing: drop, global (compare with all) or placeholder (a row of rank 0).

    Without a city column on both sides block is flat. Rows without a vector are compared with nothing. q_id names one query; candidates that share a c_id are candidates by themselves, each with
    its rank. Ids are of any type that has an order."""
    if mode in ("block", "tiled") and not ("city" in q.columns and "city" in c.columns):
        mode = "flat"
    shown = [x for x in c.columns if x not in ("cv", "city")]
    able_q, able_c = q.where("qv is not null"), c.where("cv is not null")
    row = F.xxhash64(*c.columns).alias("c_row")

    def whole(asked: DataFrame, product=partitions.metric_top_k if mode == "metric" else ranking.tiled_top_k) -> DataFrame:
        """Compared with all candidates; a join of every pair would send each candidate to each query's task. What is shown of a candidate joins the k rows by its own row, not by its id."""
        found = product(asked, able_c.select("c_id", "cv", row, *(["city"] if product is ranking.block_tiled_top_k else [])), k)
        return found.join(asked.drop("qv"), "q_id").join(able_c.select(*shown, row).dropDuplicates(["c_id", "c_row"]), ["c_id", "c_row"]).drop("c_row")

    if mode not in ("block", "tiled"):
        ranked = whole(able_q)
    else:
        if mode == "tiled":
            ranked = whole(able_q, ranking.block_tiled_top_k)
        else:
            ranked = ranking.joined_top_k(able_q, able_c, k)
        if on_missing == "global":
            ranked = ranked.unionByName(whole(blocking.without_block(able_q, c)))
    truth = F.coalesce(verified if verified is not None else canonical_id(F.col("truth")) == canonical_id(F.col("c_id")), F.lit(False))
    out = ranked.select("q_id", "c_id", "rank", F.round("sim", 6).alias("similarity"), truth.alias("verified"))
    return out.unionByName(blocking.placeholders(q, c)) if on_missing == "placeholder" else out


def pair_scores(q: DataFrame, c: DataFrame, sparse: DataFrame | None = None) -> DataFrame:
    """(q_id, c_id, dense, sparse) of every pair of a block, and nothing else of it. Without sparse, both scores are computed where a pair meets, from qv and cv and from qs and cs, token weights as
    arrays over a shared vocabulary: no pair is shuffled. With it, dense and sparse parts are added up by pair, partly in each task, so that no vector is shuffled with a pair."""
    if sparse is None:
        able = q.where("qv is not null and qs is not null"), c.where("cv is not null and cs is not null")
        return blocking.block_join(*able).select("q_id", "c_id", dot(F.col("qv"), F.col("cv")).alias("dense"), dot(F.col("qs"), F.col("cs")).alias("sparse"))
    dense = blocking.block_join(q.where("qv is not null"), c.where("cv is not null")).select("q_id", "c_id", dot(F.col("qv"), F.col("cv")).alias("dense"), F.lit(None).cast("double").alias("sparse"))
    parts = dense.unionByName(sparse.select("q_id", "c_id", F.lit(None).cast("double").alias("dense"), F.col("sparse").cast("double").alias("sparse")))
    both = parts.groupBy("q_id", "c_id").agg(F.max("dense").alias("dense"), F.coalesce(F.max("sparse"), F.lit(0.0)).alias("sparse"))
    return both.where("dense is not null")


def with_multi(pairs: DataFrame, q: DataFrame, c: DataFrame, slices=("qm", "cm")) -> DataFrame:
    """pairs with `multi`, the multi-vector score: their vectors are joined to the pairs that are left."""
    out = pairs.join(q.select("q_id", slices[0]), "q_id").join(c.select("c_id", slices[1]), "c_id")
    return out.withColumn("multi", maxsim(F.col(slices[0]), F.col(slices[1]))).drop(*slices)


def fused_match(q: DataFrame, c: DataFrame, sparse: DataFrame | None = None, *, weights=(1, 1, 1), k: int = 100, keep: int = 10, slices=("qm", "cm")) -> DataFrame:
    """Two passes: dense and sparse scores choose k, multi-vector scores are computed for those alone, the best `keep` stay. q_id and c_id name one row each."""
    wd, ws, wc = map(float, weights)
    pairs = pair_scores(q, c, sparse).withColumn("first", wd * F.col("dense") + ws * F.col("sparse"))
    held = with_multi(ranking.top_k(pairs, k, "first", rank="pass1_rank"), q, c, slices)
    return ranking.top_k(held.withColumn("fused", F.col("first") + wc * F.col("multi")), keep, "fused")
