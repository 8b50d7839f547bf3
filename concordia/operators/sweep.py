"""Weight sweeps and configuration grids: scores are computed once, and each configuration is a few columns over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import fused
from .ranking import top_k


def _first(field: str):
    """The field of the row with the highest score, ties by the smaller id: of any type that has an order."""
    return F.min_by(field, F.struct(-F.col("score"), F.col("c_id")))


def weight_grid(spark: SparkSession, weights: list[tuple[int, int, int]]) -> DataFrame:
    rows = [(i, *map(int, w)) for i, w in enumerate(weights)]
    return spark.createDataFrame(rows, "config int, wd int, ws int, wc int")


def fine_grid(best: tuple[int, int, int], tried: set[tuple[int, int, int]] = frozenset()) -> list[tuple[int, int, int]]:
    """Whole weights near the best: the dense one within 2, the others within 1; not negative, not all zero, not tried."""
    d, s, c = best
    out = [(a, b, e) for a in range(max(0, d - 2), d + 3) for b in range(max(0, s - 1), s + 2) for e in range(max(0, c - 1), c + 2)]
    return [w for w in out if any(w) and w not in tried]


def scaled_grid(best: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    """Weights around the best in steps that follow its size; none around (1, 1, 1)."""
    d, s, c = best
    if best == (1, 1, 1):
        return []
    dense, sparse = range(max(0, d - 10), d + 11, max(1, d // 5)), range(max(0, s - 5), s + 6, max(1, s // 3))
    return [(a, b, e) for a in dense for b in sparse for e in range(max(0, c - 2), c + 3) if a or b or e]


def sweep_frozen(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """Accuracy by configuration over one frozen list of candidates. scored: q_id, c_id, d, s, c, correct."""
    x = scored.crossJoin(F.broadcast(weights)).withColumn("score", fused(F.col("d"), F.col("s"), F.col("c"), F.col("wd"), F.col("ws"), F.col("wc")))
    best = x.groupBy("config", "wd", "ws", "wc", "q_id").agg(_first("correct").alias("correct"))
    return best.groupBy("config", "wd", "ws", "wc").agg(F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))


def sweep_reselect(scored: DataFrame, weights: DataFrame, k: int, refine: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """As sweep_frozen, with the k candidates chosen anew by each configuration's dense and sparse weights. refine adds c and correct to the pairs that any configuration has chosen, where
    scored hasn't them yet: each pair once."""
    x = scored.crossJoin(F.broadcast(weights)).withColumn("first", F.col("wd") * F.col("d") + F.col("ws") * F.col("s"))
    return reselected(top_k(x, k, "first", by=("config", "q_id"), rank="pass1_rank"), refine)


def reselected(held: DataFrame, refine: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """sweep_reselect of the pairs that each configuration holds: config, wd, ws, wc, q_id, c_id and first, their weighted dense and sparse scores."""
    if refine is not None:
        own = refine(held.select("q_id", "c_id").distinct()).select("q_id", "c_id", "c", "correct")
        held = held.join(own, ["q_id", "c_id"])
    held = held.withColumn("score", F.col("first") + F.col("wc") * F.col("c"))
    best = held.groupBy("config", "wd", "ws", "wc", "q_id").agg(_first("correct").alias("correct"))
    return best.groupBy("config", "wd", "ws", "wc").agg(F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))


def by_city(scored: DataFrame, weights: DataFrame, cities: DataFrame) -> DataFrame:
    """Accuracy by configuration and city over one frozen list of candidates; 0 for a city (city) that has none. scored: q_id, c_id, city, d, s, c, correct."""
    x = scored.crossJoin(F.broadcast(weights)).withColumn("score", fused(F.col("d"), F.col("s"), F.col("c"), F.col("wd"), F.col("ws"), F.col("wc")))
    best = x.groupBy("config", "city", "q_id").agg(_first("correct").alias("correct"))
    own = best.groupBy("config", "city").agg(F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))
    every = cities.select("city").distinct().crossJoin(F.broadcast(weights.select("config")))
    return every.join(own, ["config", "city"], "left").select("config", "city", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def best_config(results: DataFrame) -> DataFrame:
    """The first configuration with the highest accuracy."""
    return results.orderBy(F.desc_nulls_last("accuracy"), "config").limit(1)
