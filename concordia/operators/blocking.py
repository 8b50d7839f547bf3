"""Which candidates a query is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def named(df: DataFrame, on: str = "city") -> DataFrame:
    """The rows that are in a block: blank names and 'nan' are none."""
    return df.where(~F.coalesce(F.trim(F.col(on)), F.lit("")).isin("", "nan")) if df.schema[on].dataType.simpleString() == "string" else df.where(F.col(on).isNotNull())


def block_join(q: DataFrame, c: DataFrame, on: str = "city") -> DataFrame:
    """Pairs of one block. An equi-join: its strategy follows the sizes, and skewed blocks are split at run time."""
    return named(q, on).join(named(c, on), on)


def without_block(q: DataFrame, c: DataFrame, on: str = "city") -> DataFrame:
    """The queries whose block has no candidates, or that are in none."""
    return q.join(named(c, on).select(on).distinct(), on, "left_anti")


def placeholders(q: DataFrame, c: DataFrame, on: str = "city") -> DataFrame:
    """One row of rank 0 for each query whose block has no candidates."""
    lost = without_block(q, c, on)
    return lost.select("q_id", F.lit(None).cast(c.schema["c_id"].dataType).alias("c_id"), F.lit(0).alias("rank"), F.lit(0.0).alias("similarity"), F.lit(False).alias("verified"))


def common_blocks(q: DataFrame, c: DataFrame, on: str = "city") -> DataFrame:
    return q.select(on).intersect(c.select(on))


def block_sizes(c: DataFrame, on: str = "city") -> DataFrame:
    return c.groupBy(on).agg(F.count(F.lit(1)).alias("n"))


def keep_last(df: DataFrame, key: str, order: list) -> DataFrame:
    """The last row of each key in the given order, as a dictionary keeps what is put last."""
    last = F.max_by(F.struct(*df.columns), F.struct(*[F.col(o) for o in order]))
    return df.groupBy(F.col(key).alias("_key")).agg(last.alias("r")).select("r.*")


def look_up(df: DataFrame, key: str, table: DataFrame, out: str, order: list) -> DataFrame:
    """df with `out`: the text of the row of table (id, text, and what it is ordered by) that key names, the last of several, and the key itself where there is none or its text is blank."""
    known = keep_last(table, "id", order).select(F.col("id").alias("_id"), F.col("text").alias("_found"))
    found = F.nullif(F.trim("_found"), F.lit(""))
    return df.join(known, df[key] == F.col("_id"), "left").withColumn(out, F.coalesce(found, df[key].cast("string"))).drop("_id", "_found")


def head(df: DataFrame, n: int, order: list) -> DataFrame:
    """The first n rows in the given order: a sample to look at."""
    return df.orderBy(*order).limit(int(n))


def keep_first(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key in the given order. A min over a struct: partial in each task, so that a frequent key isn't gathered."""
    first = F.min_by(F.struct(*df.columns), F.struct(*[F.col(o) for o in order]))
    return df.groupBy(F.col(key).alias("_key")).agg(first.alias("r")).select("r.*")
