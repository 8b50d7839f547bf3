"""Line dedup over levelled sorted runs of line hashes.

The store of the lines seen so far is a few runs: tables of distinct 128-bit line hashes, bucketed and sorted by hash. A batch's own
hashes are merged against each run (a bucketed run takes part in the sort-merge join without being shuffled again), lines that
a run or a smaller document of the batch has are dropped, and the batch's new hashes become a run of level 0. `fan_out` runs of a level
are compacted into one of the next, so that n batches leave about fan_out * log(n) runs.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import SPACE, Scratch, hash128, lower_ascii, table

HASH = ["h1", "h2"]


class LineRuns:
    """The levelled runs. Runs are bucketed tables whose files lie in the shared folder, wherever the warehouse is."""

    def __init__(self, spark: SparkSession, buckets: int, fan_out: int = 3):
        self.spark, self.buckets, self.fan_out = spark, buckets, fan_out
        self.levels: list[list[str]] = []
        self.batches: dict[str, int] = {}  # numbers of the batches by name: a hash keeps that of the batch which had it first
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.files = Scratch(spark, self.name)
        self.made = 0

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def _save(self, hashes: DataFrame, dealt: bool = False) -> str:
        """dealt: the rows come by bucket already, and stay in their tasks."""
        self.made += 1
        name = f"{self.name}_{self.made}"
        rows = hashes.select(*HASH, "batch")
        (rows if dealt else rows.repartition(self.buckets, *HASH)).write.bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(name, format="parquet", path=f"{self.files.root}/{name}")
        return name

    def number(self, batch: str) -> int:
        return self.batches.setdefault(batch, len(self.batches))

    def add(self, hashes: DataFrame, batch: str) -> None:
        """Adds a batch's hashes that no run has; compacts the levels that are full."""
        self._put(self._save(hashes.withColumn("batch", F.lit(self.number(batch)))), 0)

    def _put(self, name: str, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fan_out:
            runs = self.levels[level]
            merged = self._save(reduce(DataFrame.unionByName, [self.spark.table(t) for t in runs]), dealt=True)
            self.levels[level] = []
            self._forget(runs)
            self._put(merged, level + 1)

    def _forget(self, names: list[str]) -> None:
        for t in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.files.drop(*names)

    def drop(self) -> None:
        for level in self.levels:
            self._forget(level)
        self.levels = []


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_key: int = 10, batches: int = 4, fan_out: int = 3, runs: LineRuns | None = None, batch: str | None = None, rows_a_bucket: int = 200_000, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with text cut down to its kept lines, and n_lines, n_dropped (long), or whatever names `counts` gives these.

    The table comes in batches of ids in ascending order (of ids that aren't whole numbers, in one), or as one batch on top of `runs` that earlier calls have filled. A line whose key
    (ASCII white space stripped, A-Z lower-cased) has at least min_key code points goes if a document with a smaller id, or an earlier
    batch, has the key; lines of the first document that has a key all stay. `batch` names the batch: one that comes again after a failure loses nothing to itself, and gives what it gave
    or would have given. Without a name each call is a batch of its own. Null or empty texts are one empty line. Rows that share an id
    are one document. Ids are of any type that has an order; a null id comes after all others. Empty tables give no rows. Extra columns stay, whatever their names; one that is named like
    an added column is replaced. Only ids, hashes and places of lines are shuffled to find what goes; texts move once, by their row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    own = runs is None
    # the caller's other columns travel in one, the text by itself and once; null ids come last. Whole numbers are aggregated as such, other ids behind a flag
    others = [c for c in docs.columns if c.lower() not in (text_col.lower(), *(x.lower() for x in counts))]
    numbers = isinstance(docs.schema[id_col].dataType, IntegralType)
    place = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)) if numbers else F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))
    rows = docs.select(place.alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row"), F.col(text_col).alias("text"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("own"))
    steps = batches if own and numbers else 1
    cuts = sorted(set(rows.select(F.percentile_approx("id", [i / steps for i in range(1, steps)], 1000)).first()[0] or [])) if steps > 1 else []
    part = reduce(lambda x, c: x + F.when(F.col("id") > c, 1).otherwise(0), cuts, F.lit(0))
    lines = rows.select("id", "row", F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_key)
    h1, h2 = hash128(F.col("key"))
    lines = scratch.write(lines.select("id", "row", "pos", h1.alias("h1"), h2.alias("h2"), part.alias("part")), "lines", partition_by="part")
    if own:
        runs = LineRuns(spark, max(4, -(-lines.count() // rows_a_bucket)), fan_out)
    gone = []
    try:
        for b in range(len(cuts) + 1):
            name = batch or f"{uuid.uuid4().hex}"
            number = runs.number(name)
            mine = lines.where(F.col("part") == b)
            firsts = mine.groupBy(*HASH).agg(F.min("id").alias("first"), F.max("id").alias("last"))
            seen = there = F.lit(False)
            for i, run in enumerate(runs.tables()):
                firsts = firsts.join(run.select(*HASH, F.col("batch").alias(f"_r{i}")), HASH, "left")
                # what a batch had when it came before is no reason for it to go, nor for a second entry
                seen, there = seen | F.coalesce(F.col(f"_r{i}") < number, F.lit(False)), there | F.col(f"_r{i}").isNotNull()
            firsts = scratch.write(firsts.select(*HASH, "first", "last", seen.alias("seen"), there.alias("there")), f"firsts{b}")
            # what goes of this batch: all lines that a run has, and those after the first document
            shared = firsts.where("seen or last > first").select(*HASH, F.when(~F.col("seen"), F.col("first")).alias("keep"))
            dropped = mine.join(shared, HASH).where("keep is null or id > keep").select("id", "row", "pos")
            gone.append(scratch.write(dropped, f"gone{b}"))
            if b < len(cuts) or not own:
                runs.add(firsts.where("not there"), name)
            scratch.drop(f"firsts{b}")
    finally:
        if own:
            runs.drop()
    places = reduce(DataFrame.unionByName, gone).groupBy("id", "row").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    out = rows.join(places, ["id", "row"], "left").withColumn("lines", text_lines(F.col("text"))).withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    # slices between the places that go: linear in the lines, where a lookup per line would not be
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    ends = F.concat(F.col("gone"), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(F.col("lines"), s + 1, e - s)))
    text = F.when(F.size("gone") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return out.select(*(F.col("own").getField(c).alias(c) for c in others), text.alias(text_col), F.size("lines").cast("long").alias(counts[0]), F.size("gone").cast("long").alias(counts[1]))


def op3_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT k.*, coalesce(f.first < k.doc_id, FALSE) AS dropped FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
