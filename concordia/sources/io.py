"""Reading and writing of tables, caches and reports."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workbook import read_workbook


#: Encodings that Spark's readers take as they are.
OWN_ENCODINGS = ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16LE", "UTF-16BE", "UTF-32")


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV file with a header; headers and fields may hold line breaks, a byte order mark is dropped. Files are read as streams, one in each task. Other
    encodings than OWN_ENCODINGS, such as GB18030, need a setting of the session that lets readers take any of Java's; it is turned on here and stays on, as
    the file is read when the rows are. Bytes that an encoding doesn't know become U+FFFD."""
    name = encoding.upper().replace("_", "-").removesuffix("-SIG")
    if name not in OWN_ENCODINGS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", name).csv(path)


def read_table(spark: SparkSession, path: str, encoding: str = "UTF-8", limit: int | None = None) -> DataFrame:
    """CSV, JSON lines, Parquet or Excel by the suffix, in any case."""
    kind = path.lower().rsplit(".", 1)[-1]
    if kind in ("xlsx", "xls"):
        df = read_excel(spark, path)
    elif kind == "csv":
        df = read_csv(spark, path, encoding)
    elif kind in ("jsonl", "json"):
        df = read_jsonl(spark, path)
    else:
        df = spark.read.parquet(path)
    return df if limit is None else df.limit(limit)


def read_excel(spark: SparkSession, path: str, sheet: str | int | None = None, columns: list[str] | None = None) -> DataFrame:
    """A sheet of a workbook, the first by default, streamed by ranges of rows; see workbook.read_workbook. The binary format of before 2007 is not read."""
    if path.lower().endswith(".xls"):
        raise ValueError("the binary .xls format is not read; save the workbook as .xlsx or CSV")
    return read_workbook(spark, path, sheet, columns)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def export_csv(df: DataFrame, path: str) -> int:
    """One file with a byte order mark, row by row from the executors; for results that a person opens."""
    import csv

    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], tag: str) -> DataFrame:
    """The table at path/tag, built and written first if it isn't there. Vectors and scores are kept by id and model tag, never by position."""
    where = f"{path}/{tag}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def _segments(spark: SparkSession, path: str) -> list[str]:
    """The folders of a table's segments that were written to their end, the oldest first."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    child = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, name)
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(f"{path}/{n}" for n in names if n.startswith("segment=") and fs.exists(child(f"{n}/_SUCCESS")))


def encoded(spark: SparkSession, path: str, texts: DataFrame, encode: Callable[[DataFrame], DataFrame], tag: str, *, id_col: str = "id", text_col: str = "text", fan_out: int = 8) -> DataFrame:
    """texts' ids with what `encode` makes of their texts, kept at path/tag as segments and brought up to date: encode sees new and changed texts alone.

    A segment has (id, hash, deleted, and what encode adds) of one update: new and changed texts with their encodings, ids that are gone as tombstones. The newest row of an id counts. Once
    there are fan_out segments they become one, without what is gone. A run that breaks off leaves a segment without an end, which is not read; running again does only what is left.
    Ids name one text each (of several, which one is open); rows without an id are left out, null texts count as empty. encode gets (id, text) and adds columns; the tag names the model."""
    where = f"{path}/{tag}"
    now = texts.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["id"])
    now = now.withColumn("hash", F.sha2("text", 256))
    found = _segments(spark, where)
    number = int(found[-1].rsplit("=", 1)[1]) + 1 if found else 0

    def newest(segments: list[str]) -> DataFrame:
        parts = [spark.read.parquet(s).withColumn("_at", F.lit(i)) for i, s in enumerate(segments)]
        rows = reduce(DataFrame.unionByName, parts)
        last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("id", "_at")]), "_at").alias("r"))
        return last.select("id", "r.*").where("not deleted")

    if found:
        kept = newest(found)
        known = kept.select("id", F.col("hash").alias("_had"))
        both = now.join(known, "id", "full")
        fresh = both.where("hash is not null and (_had is null or _had <> hash)").select("id", "text", "hash")
        gone = both.where("hash is null").select("id")
        if fresh.isEmpty() and gone.isEmpty():
            return kept.drop("hash", "deleted")
    else:
        fresh, gone = now, None
    new = encode(fresh.select("id", "text")).drop("text").join(fresh.select("id", "hash"), "id").withColumn("deleted", F.lit(False))
    if gone is not None:
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema.fields if f.name not in ("id", "deleted")]
        new = new.unionByName(gone.select("id", *empty, F.lit(True).alias("deleted")))
    new.write.mode("overwrite").parquet(f"{where}/segment={number:08d}")
    found = _segments(spark, where)
    if len(found) >= fan_out:
        newest(found).write.mode("overwrite").parquet(f"{where}/segment={number + 1:08d}")
        for s in found:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        found = _segments(spark, where)
    return newest(found).drop("hash", "deleted")


def find_column(columns: list[str], parts: tuple[str, ...] = ("地址", "addr")) -> str:
    """The first column whose lower-cased name contains one of parts."""
    for c in columns:
        if any(p in c.lower() for p in parts):
            return c
    raise ValueError(f"no column like {parts} among {columns}")


def json_report(metrics: DataFrame, path: str) -> int:
    """All rows as one JSON array, written row by row; how many."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for row in metrics.toLocalIterator():
            f.write((",\n" if n else "\n") + json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))
            n += 1
        f.write("\n]\n")
    return n


def markdown_report(metrics: DataFrame, path: str, sort: str) -> int:
    """A table of all metrics, the best first, and a line that names the best; written row by row. How many rows it has."""
    head, best, n = metrics.columns, None, 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("| " + " | ".join(head) + " |\n|" + "---|" * len(head) + "\n")
        for r in metrics.orderBy(F.desc_nulls_last(sort)).toLocalIterator():
            best, n = best or r, n + 1
            f.write("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n")
        if best:
            f.write(f"\nBest {sort}: {best[sort]} ({head[0]}: {best[0]})\n")
    return n
