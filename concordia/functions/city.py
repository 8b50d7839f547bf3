"""City names: canonical form by rules and lookup tables, alignment with a candidate list, fill from a geocoder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .address import contained
from .divisions import county_table, divisions
from .text import strip

#: Words that a city's name doesn't contain; provinces by their bare names.
JUNK_WORDS = "超市 市场 广场 大厦 商城 中心 综合 门市 城市 农贸 菜市 集市 商贸 装饰 眼镜 生鲜 配件 负一 一楼 小区 茶叶 副食 钟表 华联 大润发 永辉 佳惠 宝龙 光彩 收件 地址 帮忙 号".split()
JUNK_NAMES = "永辉超市 邻你超市 爱家超市 百姓超市 玖多超市 生鲜超市 汇工眼镜 佳惠超市 生鲜市 层超市 号门市 间门市".split()
JUNK_PARTS = "街道 镇 路 乡 村 小区 一楼 负一 铺 院 苑 楼".split()
#: Zones whose name stands before a city's.
ZONES = "试验区 开发区 自贸区 高新区 经济区 合作区".split()
PROVINCES = "北京 天津 上海 重庆 河北 山西 辽宁 吉林 黑龙江 江苏 浙江 安徽 福建 江西 山东 河南 湖北 湖南 广东 广西 海南 四川 贵州 云南 西藏 陕西 甘肃 青海 宁夏 新疆 内蒙古".split()


def _lookup(df: DataFrame, table: DataFrame | None, key: str, out: str) -> DataFrame:
    """Adds out: the `target` of the row of table (name, target) that key names. The size of the table decides on how to join."""
    if table is None:
        return df.withColumn(out, F.lit(None).cast("string"))
    return df.join(table.select(F.col("name").alias(key), F.col("target").alias(out)), key, "left")


def normalize_city(df: DataFrame, city: str, counties: DataFrame | None = None, fixes: DataFrame | None = None, *, strict: bool = False, out: str = "city_norm") -> DataFrame:
    """df with `out`, the canonical name; '' for null, blank and junk.

    counties (name, target): what belongs to a prefecture; by default what the division codes say, see divisions.county_table. fixes (name, target): truncated names. strict=False departs from
    plain rule order in two ways: names that are a key or a target of a table are never junk, and 省 or 自治区 after a
    province's name goes with it. strict=True doesn't."""
    counties = county_table(divisions(df.sparkSession)) if counties is None else counties
    tables = [t for t in (counties, fixes) if t is not None]
    df = df.withColumn("_c", strip(F.coalesce(F.col(city), F.lit(""))))
    if strict:
        df = df.withColumn("_known", F.lit(False))
    else:
        names = reduce(DataFrame.union, [t.select("name").union(t.select("target")) for t in tables]).distinct()
        df = df.join(names.select(F.col("name").alias("_c"), F.lit(True).alias("_known")), "_c", "left")
    c = F.col("_c")
    junk = c.endswith("市") & (F.length(c) > 4) & c.rlike("|".join(JUNK_WORDS))
    junk = junk | (c == "县") | (c.startswith("号") & (F.length(c) <= 6)) | c.isin(JUNK_NAMES) | c.rlike("|".join(JUNK_PARTS))
    df = df.withColumn("_c", F.when(junk & ~F.coalesce("_known", F.lit(False)), "").otherwise(c)).drop("_known")
    # the first zone, in the order of the list, with something behind it
    rest = lambda z: F.when(F.locate(z, F.col("_c")) > 0, F.nullif(F.substr(F.col("_c"), F.locate(z, F.col("_c")) + len(z)), F.lit("")))
    df = df.withColumn("_c", F.coalesce(*[rest(z) for z in ZONES], F.col("_c")))
    df = _lookup(df, fixes, "_c", "_fix")
    tail = "" if strict else "(?:省|自治区|壮族自治区|回族自治区|维吾尔自治区)?"
    short = F.regexp_replace("_c", f"^(?:{'|'.join(PROVINCES)}){tail}(?!市$)(?=.)", "")
    short = F.regexp_replace(short, "市市+$", "市")
    df = df.withColumn("_s", short)
    inner = F.regexp_extract("_s", "^.+?区(.+市)$", 1)
    df = df.withColumn("_s", F.when(F.length(inner) >= 3, inner).otherwise(F.col("_s")))
    head = F.regexp_extract("_s", "^(.+?市)(.+?[区县市].*)$", 1)
    df = df.withColumn("_s", F.when((head != "") & (F.length(head) <= 5), head).otherwise(F.col("_s")))
    df = _lookup(df, counties, "_s", "_county")
    bare = ~F.col("_s").rlike("(市|地区|州|盟)$")
    df = df.withColumn("_s2", F.when(bare, F.concat("_s", F.lit("市"))))
    df = _lookup(df, counties, "_s2", "_county2")
    return df.withColumn(out, F.coalesce("_fix", "_county", "_county2", "_s")).drop("_c", "_fix", "_s", "_s2", "_county", "_county2")


def valid_cities(df: DataFrame, city: str, min_support: int = 0) -> DataFrame:
    """(city, n): trimmed names that end with 市, the longest first where order matters."""
    named = df.select(strip(F.coalesce(F.col(city), F.lit(""))).alias("city")).where(F.col("city").endswith("市"))
    return named.groupBy("city").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_support)


def align_city(df: DataFrame, city: str, cities: DataFrame, out: str = "city") -> DataFrame:
    """df with `out`: the name as it is, with 市, or without it, whichever first is among cities (city); else as it is. Three equi-joins."""
    base = strip(F.coalesce(F.col(city), F.lit("")))
    df = df.withColumns({"_a": base, "_b": F.concat(base, F.lit("市")), "_d": F.regexp_replace(base, "市$", "")})
    known = cities.select("city").distinct()
    for k in ("_a", "_b", "_d"):
        df = df.join(known.select(F.col("city").alias(k), F.lit(True).alias(f"{k}_hit")), k, "left")
    found = F.coalesce(*[F.when(F.col(f"{k}_hit"), F.col(k)) for k in ("_a", "_b", "_d")], F.col("_a"))
    return df.withColumn(out, found).drop("_a", "_b", "_d", "_a_hit", "_b_hit", "_d_hit")


def city_from_address(df: DataFrame, addr: str, cities: DataFrame, key: str, out: str = "city") -> DataFrame:
    """df with `out`: the longest of cities (city) that the address contains (ties: the greatest), '' if none. Each distinct address is looked up once."""
    asked = df.select(F.col(addr).alias("_addr")).distinct()
    best = F.max_by("city", F.struct(F.length("city"), F.col("city")))
    hits = contained(asked, "_addr", cities.select("city"), "city").groupBy("_addr").agg(best.alias(out))
    return df.join(hits, df[addr] == hits["_addr"], "left").drop("_addr").withColumn(out, F.coalesce(out, F.lit("")))


def needs_geocode(city: Column) -> Column:
    return F.coalesce(strip(city), F.lit("")).isin("", "nan")


def geocode_fill(city: Column, found_city: Column, found_province: Column) -> Column:
    """A blank city takes the geocoder's city, or its province where that is a municipality and the city is empty."""
    found_city = F.coalesce(found_city, F.lit(""))
    own = F.when(~found_city.isin("", "[]"), found_city).when((found_city == "") & found_province.rlike("北京|上海|天津|重庆"), found_province)
    return F.when(needs_geocode(city), F.coalesce(own, F.lit(""))).otherwise(city)
