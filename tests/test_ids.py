"""Engine operators on ids of two types, rows without vectors, repeated candidates and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.operators import blocking, evaluate, mining, partitions, ranking, sweep
from concordia.plans import match


def tables(spark, kind):
    """Queries and candidates of three blocks; ids are numbers, or texts in the same order."""
    rng = np.random.default_rng(9)
    name = (lambda i: i) if kind == "long" else (lambda i: f"id-{i:04d}")
    vector = lambda: [float(x) for x in rng.normal(size=6) / 3]
    q = [(name(i), "abx"[i % 3] if i % 5 else None, vector() if i % 7 else None, name(100 + i), f"query {i}") for i in range(12)]
    c = [(name(100 + i), "abc"[i % 3] if i % 6 else "nan", vector() if i % 9 else None, f"text {i % 4}") for i in range(40)]
    c += [c[1], c[2], (c[4][0], c[4][1], c[5][2], "other")]
    q = spark.createDataFrame(q, f"q_id {kind}, city string, qv array<double>, truth {kind}, q_name string")
    c = spark.createDataFrame(c, f"c_id {kind}, city string, cv array<double>, c_name string")
    return q, c


def single(c):
    """Candidates of one row an id."""
    return c.where("cv is not null").dropDuplicates(["c_id"])


def with_slices(q, c):
    cut = lambda v: F.when(F.col(v).isNotNull(), F.array(F.slice(v, 1, 3), F.slice(v, 4, 3)))
    return q.withColumn("qm", cut("qv")), c.withColumn("cm", cut("cv"))


def tokens(df, id_, v):
    return df.where(F.col(v).isNotNull()).select(id_, "city", F.posexplode(v).alias("token", "weight")).withColumn("token", F.col("token").cast("string"))


def scored(q, c):
    pairs = match.pair_scores(q, single(c), ranking.sparse_scores(tokens(q, "q_id", "qv"), tokens(single(c), "c_id", "cv")))
    out = pairs.withColumnsRenamed({"dense": "d", "sparse": "s"}).withColumn("c", F.lit(0.5))
    out = out.join(q.select("q_id", "city"), "q_id")
    return out.withColumn("correct", F.col("c_id").cast("string").endswith("1"))


def ranked(q, c):
    out = ranking.top_k(blocking.block_join(q.where("qv is not null"), single(c)).withColumn("sim", F.col("qv")[0] * F.col("cv")[0]), 5)
    return out.select("q_id", "city", F.col("q_name").alias("query"), "c_id", F.col("c_name").alias("text"), "rank", F.col("c_id").cast("string").rlike("[0-4]$").alias("verified"))


GRID = [(1, 1, 1), (3, 0, 1), (0, 1, 0)]
OPERATORS = {
    **{f"dense_match {m}": lambda s, q, c, m=m: match.dense_match(q, c, 4, mode=m) for m in ("block", "flat", "metric")},
    **{f"dense_match {o}": lambda s, q, c, o=o: match.dense_match(q, c, 4, on_missing=o) for o in ("global", "placeholder")},
    "blas": lambda s, q, c: ranking.blas_top_k(q, c, 4, salts=2).withColumn("sim", F.round("sim", 9)),
    "tiled": lambda s, q, c: ranking.tiled_top_k(q, c, 4, tile=7, part=5).withColumn("sim", F.round("sim", 9)),
    "sparse": lambda s, q, c: partitions.sparse_top_k(tokens(q, "q_id", "qv"), tokens(single(c), "c_id", "cv"), 4).withColumn("sparse", F.round("sparse", 9)),
    "late": lambda s, q, c: partitions.late_top_k(*with_slices(q, single(c)), 4).drop("scored"),
    "fused": lambda s, q, c: match.fused_match(*with_slices(q, single(c)), ranking.sparse_scores(tokens(q, "q_id", "qv"), tokens(single(c), "c_id", "cv")), k=6, keep=3).select("q_id", "c_id", "rank", F.round("fused", 9).alias("fused")),
    "sweep_frozen": lambda s, q, c: sweep.sweep_frozen(scored(q, c), sweep.weight_grid(s, GRID)),
    "sweep_reselect": lambda s, q, c: sweep.sweep_reselect(scored(q, c), sweep.weight_grid(s, GRID), 3),
    "by_city": lambda s, q, c: sweep.by_city(scored(q, c), sweep.weight_grid(s, GRID), s.createDataFrame([("a",), ("z",)], "city string")),
    "rerank": lambda s, q, c: ranking.rerank(ranked(q, c), F.length("text").cast("double"), 3).select("q_id", "c_id", "rank", "rerank"),
    "hits": lambda s, q, c: evaluate.hit_at(evaluate.hit_ranks(ranked(q, c), q), (1, 3)),
    "mining": lambda s, q, c: mining.mine_pairs(ranked(q, c), 2),
    "split": lambda s, q, c: mining.split(q.select(F.substring(F.col("q_id").cast("string"), -2, 2).cast("int").alias("k")), "k"),
    "keep_first": lambda s, q, c: blocking.keep_first(c.select("c_id", "c_name"), "c_id", ["c_name"]),
    "look_up": lambda s, q, c: blocking.look_up(q.select("q_id", F.col("truth").alias("key")), "key", c.select(F.col("c_id").alias("id"), F.col("c_name").alias("text")), "text", ["text"]).where("text like 'text%'"),
}


def plain(value):
    """Values with text ids as numbers."""
    if isinstance(value, str) and value.startswith("id-"):
        return int(value[3:])
    return [plain(v) for v in value] if isinstance(value, list) else value


def rows(df):
    return sorted((repr([plain(v) for v in r]) for r in df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_of_any_type_and_empty_tables(spark, name):
    run = OPERATORS[name]
    q, c = tables(spark, "long")
    want = rows(run(spark, q, c))
    assert want
    assert rows(run(spark, *tables(spark, "string"))) == want
    nobody = run(spark, *(t.limit(0) for t in tables(spark, "string")))
    assert all(all(v in (None, 0, 0.0) or k in ("config", "city", "wd", "ws", "wc") for k, v in r.asDict().items()) for r in nobody.collect())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_flat_modes_rank_as_one_block(spark, kind):
    """Null vectors are compared with nothing, and candidates that share an id each have a rank, in every mode."""
    q, c = (t.withColumn("city", F.lit("one")) for t in tables(spark, kind))
    block = rows(match.dense_match(q, c, 30))
    assert rows(match.dense_match(q, c, 30, mode="flat")) == block == rows(match.dense_match(q, c, 30, mode="metric"))
    assert rows(match.dense_match(q.drop("city"), c, 30)) == block  # no common city column: flat
    per = match.dense_match(q, c, 30).groupBy("q_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last")).collect()
    assert per and all(r["n"] == r["last"] == 30 for r in per)
