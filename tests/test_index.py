"""Searches that look at part of the candidates, against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia import catalogue
from concordia.operators import partitions, ranking
from concordia.plans import match


def held(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def clusters(spark, n=3000, middles=30, width=16, kind="string"):
    rng = np.random.default_rng(4)
    at = rng.normal(size=(middles, width)) / 4
    v = at[rng.integers(0, middles, n)] + rng.normal(size=(n, width)) * 0.005
    rows = [(f"x{i:05d}" if kind == "string" else i, [float(x) for x in r]) for i, r in enumerate(v)]
    c = spark.createDataFrame([*rows, *rows[:5], (rows[0][0], rows[-1][1]), (rows[1][0], None), (None, rows[2][1])], f"c_id {kind}, cv array<double>")
    q = spark.createDataFrame([(f"q{i}", [float(x) for x in at[i % middles] + 0.001 * i]) for i in range(40)] + [("null", None)], "q_id string, qv array<double>")
    return q, c


def test_metric_partitions_skip_most_tiles_of_clusters(spark):
    q, c = clusters(spark)
    work = partitions.Work()
    own = partitions.metric_top_k(q, c, 5, pivots=60, work=work)
    near = F.round("sim", 6)  # products of long vectors differ in their last digits by how they are dealt
    assert held(own, "q_id", "c_id", near, "rank") == held(ranking.tiled_top_k(q, c, 5), "q_id", "c_id", near, "rank")
    assert work.looked < 0.3 * work.all, work
    # balls that hold more than a tile are cut; queries of a tile are dealt
    cut = partitions.metric_top_k(q, c, 5, pivots=4, tile=50, part=3)
    assert held(cut, "q_id", "c_id", near, "rank") == held(own, "q_id", "c_id", near, "rank")


def test_metric_partitions_meet_in_many_tasks(spark):
    q, c = clusters(spark)
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as at size, where tasks aren't merged into one
        own = held(partitions.metric_top_k(q, c, 5, pivots=60), "q_id", "c_id", "sim", "rank")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert own == held(ranking.tiled_top_k(q, c, 5), "q_id", "c_id", "sim", "rank")


def test_metric_partitions_multiply_queries_whose_bounds_leave_out_little(spark, monkeypatch):
    rng = np.random.default_rng(2)
    q, c = clusters(spark)
    far = [(f"far{i}", rng.normal(size=16).tolist()) for i in range(30)]
    q = q.unionByName(spark.createDataFrame(far, q.schema))
    seen, own = [], partitions.tiled_top_k
    monkeypatch.setattr(partitions, "tiled_top_k", lambda asked, *rest: seen.append(sorted(r.q_id for r in asked.collect())) or own(asked, *rest))
    for sizes in ({"pivots": 60, "open_tiles": 20}, {"pivots": 20, "tile": 40, "part": 3, "open_tiles": 5, "open_share": 0.01}):
        work, seen[:] = partitions.Work(), []
        got = held(partitions.metric_top_k(q, c, 5, work=work, **sizes), "q_id", "c_id", "sim", "rank")
        assert got == held(ranking.tiled_top_k(q, c, 5), "q_id", "c_id", "sim", "rank")
        assert len(seen) == 1 and 0 < len(seen[0]) and (len(sizes) > 2 or work.looked < work.all), (seen, work)


def vectors(spark):
    """Vectors of two blocks, each several times, with components of few digits, so that sums tie or miss by a last digit; some rows without vector or block."""
    rng = np.random.default_rng(12)
    v = rng.normal(size=(60, 64)).round(1)
    rows = [(i, "ab"[i % 2], v[(i // 2) % 60].tolist()) for i in range(400)] + [(1000, "a", None), (1001, None, v[0].tolist())]
    own = spark.createDataFrame(rows, "id long, city string, v array<double>")
    q, c = own.where("id % 10 = 0 or id > 900"), own.where("id % 10 <> 0 or id > 900")
    return q.withColumnsRenamed({"id": "q_id", "v": "qv"}), c.withColumnsRenamed({"id": "c_id", "v": "cv"})


@pytest.mark.parametrize("sizes", [{}, {"tile": 30, "part": 7}])
def test_tiles_of_blocks_give_the_digits_and_ties_of_a_join(spark, sizes):
    from concordia.functions.vectors import dot
    from concordia.operators.blocking import block_join

    q, c = vectors(spark)
    plain = block_join(q.where("qv is not null"), c.where("cv is not null")).withColumn("sim", dot(F.col("qv"), F.col("cv")))
    own = ranking.block_tiled_top_k(q, c, 4, **sizes)
    assert held(own, "q_id", "c_id", "sim", "rank") == held(ranking.top_k(plain, 4), "q_id", "c_id", "sim", "rank") and own.count() == 160
    q, c = (x.withColumn(s, F.transform(v, lambda y: F.greatest(y, F.lit(0.0)))) for x, s, v in ((q, "qs", "qv"), (c, "cs", "cv")))
    pairs = match.pair_scores(q, c)
    for n, (wd, ws) in enumerate(weights := [(1, 0), (0, 1), (20, 5), (0, 0)]):
        want = ranking.top_k(pairs.withColumn("first", wd * F.col("dense") + ws * F.col("sparse")), 4, "first")
        found = ranking.first_pass(q, c, weights, 4, **sizes).where(F.col("choice") == n)
        assert held(found, "q_id", "c_id", "dense", "sparse", "pass1_rank") == held(want, "q_id", "c_id", "dense", "sparse", "rank")
    tokens = lambda df, name, v: df.select(name, "city", F.posexplode(v).alias("token", "weight")).where("weight > 0")
    listed = ranking.sparse_scores(tokens(q, "q_id", "qv"), tokens(c, "c_id", "cv")).withColumn("sparse", F.round("sparse", 9))
    assert held(ranking.all_pairs(q, c, ranking.shared_products, "sparse", **sizes).withColumn("sparse", F.round("sparse", 9)), "q_id", "c_id", "sparse") == held(listed, "q_id", "c_id", "sparse")


def test_no_pair_is_shuffled_before_it_is_chosen(spark, sf):
    for name in ("sparse_dot", "maxsim_scores", "fused_two_pass", "score_stats"):
        p = catalogue.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [q_id" not in p, name


def test_metric_partitions_of_hardly_any_rows(spark):
    q, c = clusters(spark, n=3, kind="long")
    assert held(partitions.metric_top_k(q, c, 5), "q_id", "c_id", "rank") == held(ranking.tiled_top_k(q, c, 5), "q_id", "c_id", "rank")
    assert partitions.metric_top_k(q, c.limit(0), 5).count() == 0 and partitions.metric_top_k(q.limit(0), c, 5).count() == 0
    assert partitions.metric_top_k(q, c.limit(0), 5).columns == ["q_id", "c_id", "sim", "rank"]


def counted(spark, docs=400, kind="string"):
    """Documents over a few hundred tokens, some of which all have, a few of them much longer than the others."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(docs):
        size = 3000 if i % 40 == 1 else 60
        tokens, counts = np.unique(rng.zipf(1.3, size) % 300, return_counts=True)
        rows += [(f"d{i:04d}", "a" if i % 3 else "b", f"t{t}", int(n)) for t, n in zip(tokens, counts, strict=True)]
    return spark.createDataFrame(rows, f"id {kind}, city string, token string, weight int")


@pytest.mark.parametrize(("band", "by_block"), [(50_000, False), (20, True)])
def test_sparse_bounds_skip_most_products(spark, band, by_block):
    own = counted(spark)
    q = own.where("id like '%0'").withColumnRenamed("id", "q_id")
    c = own.withColumnRenamed("id", "c_id")
    work = partitions.Work()
    found = partitions.sparse_top_k(q, c, 5, other_than_itself=True, band=band, by_block=by_block, work=work)
    plain = ranking.top_k(ranking.sparse_scores(q, c).where("q_id <> c_id"), 5, "sparse")
    assert held(found.withColumn("sparse", F.col("sparse").cast("long")), "q_id", "c_id", "rank", "sparse") == held(plain, "q_id", "c_id", "rank", "sparse")
    assert work.looked * 4 <= work.all, work


def test_sparse_bounds_with_few_and_negative_weights(spark):
    q = spark.createDataFrame([(1, "a", "x", 1.0), (1, "a", "y", -2.0), (2, "a", "x", 3.0), (3, None, "x", 1.0), (4, "b", "x", 1.0)], "q_id long, city string, token string, weight double")
    c = spark.createDataFrame([(1, "a", "x", 5.0), (2, "a", "y", -4.0), (3, "a", "y", 9.0), (4, "a", "z", 9.0), (5, "a", "x", 0.0), (6, "a", None, 1.0), (7, None, "x", 1.0)], "c_id long, city string, token string, weight double")
    out = partitions.sparse_top_k(q, c, 2)
    assert held(out, "q_id", "c_id", "sparse", "rank") == [(1, 1, 5.0, 2), (1, 2, 8.0, 1), (2, 1, 15.0, 1)]
    assert partitions.sparse_top_k(q, c.limit(0), 2).count() == 0 and partitions.sparse_top_k(q.limit(0), c, 2).count() == 0


def test_sparse_topk_forms_a_tenth_of_the_products(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("lang").alias("city"), F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")).alias("token"))
    counts = docs.groupBy("doc_id", "city", "token").agg(F.count(F.lit(1)).alias("weight"))
    work = partitions.Work()
    partitions.sparse_top_k(counts.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "q_id"), counts.withColumnRenamed("doc_id", "c_id"), 5, other_than_itself=True, work=work)
    assert work.looked * 10 <= work.all, work


def test_late_interaction_scores_few_pairs(spark):
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(24, 12)) * 3
    entities = [middles[rng.integers(0, 24, 1 + i % 5)] + rng.normal(size=(1 + i % 5, 12)) * 0.05 for i in range(600)]
    entities[7] = entities[3]
    asked = [entities[i] + 0.01 for i in range(0, 600, 30)]
    best = np.array([[(a @ e.T).max(1).sum() for e in entities] for a in asked]).round(12)
    flat, owner = np.concatenate(entities), np.repeat(np.arange(600), [len(e) for e in entities])
    rows, found, score, scored = partitions.late_scores(asked, flat, owner, 600, middles, 5)
    want = [(i, int(j), best[i, j]) for i in range(len(asked)) for j in np.lexsort((np.arange(600), -best[i]))[:5]]
    assert [(i, j) for i, j, _ in want] == list(zip(rows.tolist(), found.tolist(), strict=True)) and np.allclose(score, [s for *_, s in want])
    assert scored < 0.2 * best.size, scored
    schema = "array<array<double>>"
    c = spark.createDataFrame([(f"c{i:04d}", "a" if i % 4 else "b", [[float(x) for x in v] for v in e]) for i, e in enumerate(entities)] + [("none", "a", None), ("empty", "a", []), ("lost", None, [[1.0] * 12])], f"c_id string, city string, cm {schema}")
    q = spark.createDataFrame([(i, "ab"[i % 2], [[float(x) for x in v] for v in a]) for i, a in enumerate(asked)] + [(99, "a", None), (98, "z", [[1.0] * 12])], f"q_id long, city string, qm {schema}")
    plain = match.with_multi(q.join(c, "city").where("size(qm) > 0 and size(cm) > 0").select("q_id", "c_id"), q, c)
    plain = ranking.top_k(plain.withColumn("multi", F.round("multi", 9)), 5, "multi")
    for options in ({}, {"tile": 70, "part": 3, "middles": 30}):
        own = partitions.late_top_k(q, c, 5, **options)
        assert held(own, "q_id", "c_id", "rank") == held(plain, "q_id", "c_id", "rank")


def test_late_interaction_of_the_query_leaves_pairs_unscored(spark, sf):
    from concordia.functions.vectors import slices

    q, c = catalogue._roles(spark, sf)
    out = partitions.late_top_k(q.withColumn("qm", slices(F.col("qv"), 4, 16)), c.withColumn("cm", slices(F.col("cv"), 4, 16)), 5)
    scored = sum(dict(out.select((F.col("q_id") % 7).alias("city"), "scored").distinct().collect()).values())
    sizes = dict(q.groupBy("city").count().collect())
    pairs = sum(sizes[b] * n for b, n in c.groupBy("city").count().collect() if b in sizes)
    assert scored <= pairs


def test_first_scores_carry_no_vectors(spark, sf):
    plan = catalogue.fused_two_pass(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # below the first top-k, exchanges of pairs have ids and two numbers: the aggregate by pair has no arrays
    pairs = match.pair_scores(*catalogue._roles(spark, sf), catalogue._sparse(spark, sf))
    assert pairs.columns == ["q_id", "c_id", "dense", "sparse"] and "pass1_rank" in plan
    import re

    from tests.test_engine import plan as formatted

    for keys in re.findall(r"Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: hashpartitioning\(q_id#\d+L, c_id", formatted(pairs)):
        assert "qv" not in keys and "cv" not in keys


@pytest.mark.parametrize("name", ["weight_by_city", "weight_sweep_reselect", "score_stats", "best_weights"])
def test_chosen_pairs_are_joined_to_no_vector(spark, sf, name):
    p = catalogue.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in p and "CoGroups" in p, name


def test_pairs_get_their_third_score_where_they_are_chosen(spark, sf):
    q, c = catalogue._three(*catalogue._roles(spark, sf))
    want = match.with_multi(ranking.first_pass(q, c, [(1, 1), (3, 0)], 4), q, c).join(q.select("q_id", "city"), "q_id").join(c.select("c_id", "c_label"), "c_id")
    columns = ("choice", "q_id", "c_id", "dense", "sparse", "multi", "pass1_rank", "city", "c_label")
    for sizes in ({}, {"tile": 9, "part": 3}):
        own = ranking.first_pass(*catalogue._roles(spark, sf), [(1, 1), (3, 0)], 4, views=catalogue._views, carried=("city", "c_label"), **sizes)
        assert held(own, *columns) == held(want, *columns)


def test_baseline_and_new_list_are_ranked_once(spark, sf):
    p = catalogue.baseline_compare(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("CoGroups") == 1


@pytest.mark.parametrize("sizes", [[4], [1, 3, 2]])
def test_late_interaction_without_clusters_multiplies_queries_at_once(monkeypatch, sizes):
    rng = np.random.default_rng(3)
    entities = [rng.normal(size=(sizes[i % len(sizes)], 16)) for i in range(300)]
    entities[9] = entities[5]
    asked = [*entities[:40], entities[5] * 2]
    best = np.array([[(a @ e.T).max(1).sum() for e in entities] for a in asked]).round(12)
    seen, own = [], partitions._late_products
    monkeypatch.setattr(partitions, "_late_products", lambda asked, *rest: seen.append(len(asked)) or own(asked, *rest))
    rows, found, score, scored = partitions.late_scores(asked, np.concatenate(entities), np.repeat(np.arange(300), [len(e) for e in entities]), 300, rng.normal(size=(8, 16)), 5)
    assert [(i, int(j)) for i in range(len(asked)) for j in np.lexsort((np.arange(300), -best[i]))[:5]] == list(zip(rows.tolist(), found.tolist(), strict=True))
    assert seen == [33] and scored <= best.size


def test_sparse_sums_are_made_where_postings_are(spark):
    own = counted(spark, docs=90)
    q = own.where("id like '%0'").withColumnRenamed("id", "q_id")
    found = partitions.sparse_top_k(q, own.withColumnRenamed("id", "c_id"), 5, band=20, part=2)
    p = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroups" in p and "Aggregate [q_id" not in p
    assert held(found.select("q_id", "c_id", "rank", F.col("sparse").cast("long").alias("sparse")), "q_id", "c_id", "rank", "sparse") == held(ranking.top_k(ranking.sparse_scores(q, own.withColumnRenamed("id", "c_id")), 5, "sparse"), "q_id", "c_id", "rank", "sparse")


def listed(flat, name):
    return flat.groupBy(F.col("id").alias(name) if "id" in flat.columns else name, "city").agg(F.collect_list("token").alias("token"), F.collect_list("weight").alias("weight"))


def test_sparse_topk_shuffles_no_product(spark, sf):
    import re

    from tests.test_engine import plan as formatted

    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = formatted(catalogue.sparse_topk(spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert not re.search(r"hashpartitioning\([^)]*\bc_id", p) and "hashpartitioning(band" in p


@pytest.mark.parametrize("sizes", [{}, {"lead": 6, "tile": 7, "part": 3}])
def test_sparse_groups_give_the_same_from_few_products(spark, sizes):
    own = counted(spark)
    work = partitions.Work()
    found = partitions.sparse_grouped_top_k(F.col("c_id").like("%0"), listed(own, "c_id"), 5, other_than_itself=True, work=work, **sizes)
    plain = ranking.top_k(ranking.sparse_scores(own.where("id like '%0'").withColumnRenamed("id", "q_id"), own.withColumnRenamed("id", "c_id")).where("q_id <> c_id"), 5, "sparse")
    assert held(found, "q_id", "c_id", "rank", "sparse") == held(plain, "q_id", "c_id", "rank", "sparse")
    assert sizes == {} or work.looked * 3 <= work.all, work


def test_sparse_groups_with_few_and_negative_weights(spark):
    q = spark.createDataFrame([(1, "a", ["x", "y"], [1.0, -2.0]), (2, "a", ["x"], [3.0]), (3, None, ["x"], [1.0]), (4, "b", ["x"], [1.0]), (5, "a", [], []), (6, "a", None, None), (7, "a", ["x"], [0.0])], "q_id long, city string, token array<string>, weight array<double>")
    c = spark.createDataFrame([(1, "a", ["x"], [5.0]), (2, "a", ["y"], [-4.0]), (3, "a", ["y"], [9.0]), (4, "a", ["z"], [9.0]), (5, "a", ["x"], [0.0]), (6, "a", [None], [1.0]), (7, None, ["x"], [1.0])], "c_id long, city string, token array<string>, weight array<double>")
    for sizes in ({}, {"lead": 1}):
        out = partitions.sparse_grouped_top_k(q, c, 2, **sizes)
        assert held(out, "q_id", "c_id", "sparse", "rank") == [(1, 1, 5.0, 2), (1, 2, 8.0, 1), (2, 1, 15.0, 1), (2, 5, 0.0, 2), (7, 1, 0.0, 1), (7, 5, 0.0, 2)]
    assert partitions.sparse_grouped_top_k(q, c.limit(0), 2).count() == 0 and partitions.sparse_grouped_top_k(q.limit(0), c, 2).count() == 0
