"""Province, city and district of an address: patterns first, then a gazetteer for what they leave open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .divisions import segment
from .text import clean_text

#: Municipalities and the endings of provinces, cities and districts.
MUNICIPALITIES = ("北京市", "上海市", "天津市", "重庆市")
HAN = "[一-龥]"
PROVINCE = f"({HAN}{{2,8}}(?:省|自治区|特别行政区))"
CITY = f"({HAN}{{2,6}}(?:市|地区|自治州))"
DISTRICT = f"({HAN}{{2,6}}(?:区|县|旗|自治县|自治旗|新区|开发区))"
AFTER_PROVINCE, AFTER_CITY = "^.*(?:省|自治区|特别行政区)", "^.*(?:市|地区|自治州)"


def by_pattern(addr: Column) -> tuple[Column, Column, Column]:
    """(province, city, district), '' where the pattern finds nothing. A municipality is its own province and city; of several the
    first in MUNICIPALITIES counts."""
    own = F.coalesce(*[F.when(F.contains(addr, F.lit(m)), F.lit(m)) for m in MUNICIPALITIES])
    province = F.coalesce(own, F.regexp_extract(addr, PROVINCE, 1))
    city = F.coalesce(own, F.regexp_replace(F.regexp_extract(addr, CITY, 1), AFTER_PROVINCE, ""))
    district = F.regexp_replace(F.regexp_replace(F.regexp_extract(addr, DISTRICT, 1), AFTER_CITY, ""), AFTER_PROVINCE, "")
    return province, city, district


def without_city(district: Column, city: Column) -> Column:
    """A district that begins with its city's name, without it."""
    core = F.regexp_replace(city, "市+$", "")
    return F.when((core != "") & district.startswith(core), F.substr(district, F.length(core) + 1)).otherwise(district)


def contained(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """The rows of texts and names where the text contains the name: an equi-join of the texts' parts, of the lengths that names have, with the names. Empty names are in no text."""
    lengths = names.where(F.length(name) > 0).agg(F.collect_set(F.length(name)).alias("lengths"))  # a name has some tens of characters at most, so has this list
    sizes = sorted(lengths.first()["lengths"])
    parts = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(n))) for n in sizes]  # noqa: B023  called at once
    cut = F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>")
    return texts.withColumn("_part", F.explode(cut)).join(names.withColumn("_part", F.col(name)), "_part").drop("_part")


def extract_address(df: DataFrame, addr: str, gazetteer: DataFrame | None = None, *, table: DataFrame | None = None) -> DataFrame:
    """df with province, city, district, confidence and the source of each field.

    table (code, name): divisions by their codes, whose best path fills empty fields, see divisions.segment; it takes the gazetteer's place.
    gazetteer (name, province, city, district): asked for the addresses with an empty field, by the name that the address
    contains; of several the longest, then the first by code point. Only those rows are joined, and the rest pass by. confidence: none (nothing
    found), high (patterns alone), mid (the gazetteer filled a field)."""
    text = clean_text(F.col(addr))
    p, c, d = by_pattern(F.col("_text"))
    out = df.withColumn("_text", text).withColumns({"_p": p, "_c": c, "_d": d})
    if gazetteer is not None or table is not None:
        # patterns are matched once, in as many tasks as shuffles have: a file of few bytes is one task where it is read
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.withColumn("_deal", F.monotonically_increasing_id()).repartition(n, "_deal").drop("_deal")
        out = Scratch(df.sparkSession, "parsed").write(dealt.withColumn("_text", text).withColumns({"_p": p, "_c": c, "_d": d}), "parsed")
        gap = (F.col("_text") != "") & ((F.col("_p") == "") | (F.col("_c") == "") | (F.col("_d") == ""))
        asked = out.where(gap).select("_text").distinct()
        if table is not None:
            hits = segment(asked, "_text", table).select("_text", F.struct(*(F.col(f"seg_{f}").alias(f) for f in ("province", "city", "district"))).alias("_g"))
        else:
            best = F.max_by(F.struct("province", "city", "district"), F.struct(F.length("name"), F.col("name")))
            hits = contained(asked, "_text", gazetteer, "name").groupBy("_text").agg(best.alias("_g"))
        out = out.join(hits, "_text", "left")
    else:
        out = out.withColumn("_g", F.lit(None).cast("struct<province:string,city:string,district:string>"))
    fields = {}
    for name, own in (("province", "_p"), ("city", "_c"), ("district", "_d")):
        fallback = F.coalesce(F.col(f"_g.{name}"), F.lit(""))
        fields[name] = F.when(F.col(own) != "", F.col(own)).otherwise(fallback)
        fields[f"{name}_source"] = F.when(F.col(own) != "", "regex").when(fallback != "", "gazetteer").otherwise("none")
    out = out.withColumns(fields)
    # what the patterns cut too long loses its city's name; a gazetteer's names are whole
    out = out.withColumn("district", F.when(F.col("district_source") == "regex", without_city(F.col("district"), F.col("city"))).otherwise(F.col("district")))
    sources = F.array(*[F.col(f"{n}_source") for n in ("province", "city", "district")])
    confidence = F.when(F.array_contains(sources, "gazetteer"), "mid").when(F.array_contains(sources, "regex"), "high").otherwise("none")
    return out.withColumn("confidence", confidence).drop("_text", "_p", "_c", "_d", "_g")


def address_stats(df: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col(c) != "").alias(f"with_{c}") for c in ("province", "city", "district")]
    levels = [F.count_if(F.col("confidence") == v).alias(f"confidence_{v}") for v in ("high", "mid", "none")]
    return df.agg(F.count(F.lit(1)).alias("rows"), *counts, *levels)
