"""Verification and metrics. A query without a true candidate counts as a miss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hit_ranks(ranked: DataFrame, queries: DataFrame, keep: tuple[str, ...] = ("city",)) -> DataFrame:
    """(q_id, keep, hit_rank): the first verified rank of each query, null if none."""
    hits = ranked.where("verified and rank > 0").groupBy("q_id").agg(F.min("rank").alias("hit_rank"))
    return queries.select("q_id", *keep).join(hits, "q_id", "left")


def share(k: int):
    return F.avg(F.coalesce(F.col("hit_rank") <= k, F.lit(False)).cast("double"))


def hit_at(hits: DataFrame, ks: tuple[int, ...], by: tuple[str, ...] = ()) -> DataFrame:
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(share(k), 6).alias(f"hit_{k}") for k in ks])


def weighted(per_city: DataFrame, fields: tuple[str, ...], n: str = "n_queries", min_n: int = 5) -> DataFrame:
    """Means weighted by n over the cities with at least min_n queries; 0 without any."""
    own = per_city.where(F.col(n) >= min_n)
    return own.agg(*[F.round(F.coalesce(F.sum(F.col(f) * F.col(n)) / F.sum(n), F.lit(0.0)), 6).alias(f) for f in fields])


def score_stats(df: DataFrame, fields: tuple[str, ...], by: str = "city") -> DataFrame:
    """Least, greatest and mean of each field by city."""
    return df.groupBy(by).agg(*[F.round(f(c), 6).alias(f"{n}_{c}") for c in fields for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))])


def compare_with_file(spark, path: str, new: DataFrame, field: str, on: str = "city") -> DataFrame:
    """(city, base, new, delta_pp) against the results that an earlier run has written to path (JSON lines or Parquet)."""
    base = spark.read.json(path) if path.lower().endswith((".json", ".jsonl")) else spark.read.parquet(path)
    return compare(base, new, field, on)


def compare(base: DataFrame, new: DataFrame, field: str, on: str = "city") -> DataFrame:
    """(city, base, new, delta_pp)."""
    return differences(base.select(on, F.col(field).alias("base")).join(new.select(on, F.col(field).alias("new")), on))


def differences(x: DataFrame) -> DataFrame:
    """x, with columns base and new, and what lies between them in percentage points."""
    return x.withColumn("delta_pp", F.round((F.col("new") - F.col("base")) * 100, 6))
