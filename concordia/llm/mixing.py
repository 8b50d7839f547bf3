"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the keys' ranges are buckets, about as many as the square root of
the largest source's rows, so that neither one bucket nor the list of a source's buckets is long however large a source is. Sizes are
summed per bucket, bucket sums are added up along the keys, and a running sum inside each bucket gives each document's
exact place on the source's axis of words. A source's budget is then cut at its word: whole epochs first, then the documents
below the remainder.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, power_of_two, words

WEIGHTS = (5, 2, 1)


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_num: int = 3, share_den: int = 2, most: int = 2) -> DataFrame:
    """(source, source_size) with one row a source -> adds weight and target.

    Sources by code point, null last, take the weights in turn. They share share_num/share_den of all sizes by weight; a target
    stops at `most` times its source's size and the excess is reshared among the others until none is above. Filling the
    sources in the order of size by weight finds that fixed point in one pass: a source is full if its limit is below
    what the sources from it on get by weight. All sums are integers, so that reruns agree to the last bit. The one
    task that orders the sources sees one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", w.cast("long"))
    fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    ranked = ranked.select("*", total.alias("_total"), F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("_before"), F.sum("weight").over(after).alias("_w"))
    left = F.col("_total") * share_num - F.col("_before") * (most * share_den)
    full = F.col("source_size") * (most * share_den) * F.col("_w") < F.col("weight") * left
    ranked = ranked.withColumn("_full", full).withColumn("_left", left)
    # the sources that aren't full come after all full ones, and the first of them fixes the rate
    first = F.struct(F.col("_before"), -F.col("_w"), F.col("_left"))
    open_ = F.min(F.when(~F.col("_full"), first)).over(everything)
    ranked = ranked.withColumn("_open", open_)
    share = (F.col("weight") * F.col("_open")["_left"]).cast("double") / (-F.col("_open")["col2"] * share_den).cast("double")
    target = F.when(F.col("_full"), (F.col("source_size") * most).cast("double")).otherwise(F.least(share, (F.col("source_size") * most).cast("double")))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix", whole_documents: bool = False) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken. The windows over all sources see one row a source: tens of thousands of sources, such as hosts, are fine there.

    size: defaults to the number of words of `text` (null: 0). With whole_documents a document at the cut is taken whole if at
    least half of it lies below the cut; else the cut is at the word, so that a source's taken words are its target
    rounded down. Null sources are one source; null ids, ties and repeated rows are rows like others (equal rows share a
    key and any order of them is the same); empty tables give no rows; other columns are ignored."""
    size = F.size(words(F.col("text"))) if size is None else size
    scratch = Scratch(docs.sparkSession, "mixing")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = scratch.write(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.cast("long").alias("size"), key.alias("key")), "sized")
    totals = scratch.write(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "totals")
    largest = totals.agg(F.max("rows")).first()[0] or 1
    buckets = power_of_two(math.sqrt(largest))
    targets = source_targets(totals.select("source", "source_size"), weights)

    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("int")
    placed = sized.withColumn("bucket", at)
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(along), F.lit(0)).alias("offset"))
    offsets = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.*", "t.source_size", "t.target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = run.alias("d").join(offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.bucket") == F.col("o.bucket")))
    joined = joined.select("d.doc_id", "d.source", "d.size", "o.source_size", "o.target", (F.col("d.within") + F.col("o.offset")).alias("start"))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    if whole_documents:
        part = F.when(2 * F.col("start") + F.col("size") <= 2 * rest, F.col("size")).otherwise(0)
    else:
        part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return joined.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each as often as whole documents of the mix take it, with the columns of docs, whatever their names. Rows that are equal in all columns are told apart by nothing:
    they come as often as the mix takes them together. Documents without words, and null or empty texts, have no place in a mix of words and don't come. An empty table gives no rows."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(whole).cast("string"), F.xxhash64(F.lit(7), whole).cast("string"))
    keyed = docs.select(key.alias("key"), whole.alias("own"))
    mix = mix_sources(keyed.select(F.col("key").alias("doc_id"), F.col("own.source").alias("source"), F.col("own.text").alias("text")), whole_documents=True, **options)
    scratch = Scratch(docs.sparkSession, "mixed")
    copies = mix.where("size > 0").groupBy(F.col("doc_id").alias("key")).agg(F.sum(F.expr("taken div size")).cast("int").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    copies = scratch.write(copies, "copies")
    # of repeated rows one stands for all; only those are aggregated
    alone = keyed.join(copies.where("rows = 1"), "key").select("own", "copies")
    again = keyed.join(copies.where("rows > 1"), "key").groupBy("key").agg(F.any_value("own").alias("own"), F.max("copies").alias("copies")).select("own", "copies")
    return alone.unionByName(again).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("own.*")


def op1_mixing(spark, sf_dir):
    from .common import table

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM totals),
filled AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
    CAST(sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS ws FROM ranked),
marked AS (SELECT *, source_size * 4 * ws < w * (total * 3 - before * 4) AS is_full FROM filled),
rate AS (SELECT total * 3 - before * 4 AS remaining, ws FROM marked WHERE NOT is_full ORDER BY before, ws DESC LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(source_size * 2 AS DOUBLE)
    ELSE least(CAST(w * remaining AS DOUBLE) / CAST(rate.ws * 2 AS DOUBLE), CAST(source_size * 2 AS DOUBLE)) END AS target
    FROM marked LEFT JOIN rate ON TRUE),
placed AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS start
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) END AS BIGINT) AS taken
FROM placed
"""
