"""Administrative divisions by their codes: a tree that is walked upwards, addresses segmented along it, and lookups of counties made from it.

A code has six digits: two of the province, two of the prefecture, two of the county. A division's parent is the nearest one above it that the table has; counties that a province
governs itself (third and fourth digit 90) have it as their parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Official codes and names of provinces, of prefectures, and of county-level cities and districts that names in registers are often cut down to. A table of the user's own, with
#: all divisions, takes its place.
DIVISIONS = """
110000 北京市 110105 朝阳区 110108 海淀区 120000 天津市 120101 和平区 120104 南开区 130000 河北省 130100 石家庄市 130102 长安区 130181 辛集市 130200 唐山市 130281 遵化市 130283 迁安市
130600 保定市 130682 定州市 130684 高碑店市 140000 山西省 140100 太原市 140700 晋中市 140781 介休市 150000 内蒙古自治区 150100 呼和浩特市 150102 新城区 150900 乌兰察布市 150981 丰镇市
210000 辽宁省 210100 沈阳市 210102 和平区 210200 大连市 210281 瓦房店市 210700 锦州市 210782 北镇市 211000 辽阳市 211002 白塔区 220000 吉林省 220100 长春市 220200 吉林市
230000 黑龙江省 230100 哈尔滨市 310000 上海市 310101 黄浦区 310106 静安区 310115 浦东新区 320000 江苏省 320100 南京市 320106 鼓楼区 320200 无锡市 320281 江阴市 320282 宜兴市
320300 徐州市 320302 鼓楼区 320400 常州市 320481 溧阳市 320500 苏州市 320581 常熟市 320582 张家港市 320583 昆山市 320585 太仓市 321100 镇江市 321181 丹阳市 321200 泰州市 321283 泰兴市
330000 浙江省 330100 杭州市 330106 西湖区 330182 建德市 330200 宁波市 330281 余姚市 330282 慈溪市 330300 温州市 330381 瑞安市 330382 乐清市 330400 嘉兴市 330481 海宁市 330482 平湖市
330483 桐乡市 330600 绍兴市 330681 诸暨市 330700 金华市 330781 兰溪市 330782 义乌市 330783 东阳市 330784 永康市 331000 台州市 331004 路桥区 331081 温岭市 331082 临海市
340000 安徽省 340100 合肥市 350000 福建省 350100 福州市 350102 鼓楼区 350181 福清市 350500 泉州市 350581 石狮市 350582 晋江市 350583 南安市 360000 江西省 360100 南昌市 360103 西湖区
370000 山东省 370100 济南市 370200 青岛市 370281 胶州市 370800 济宁市 370883 邹城市 371400 德州市 371482 禹城市 370900 泰安市 370983 肥城市 410000 河南省 410100 郑州市 410181 巩义市
410200 开封市 410204 鼓楼区 410700 新乡市 410782 辉县市 419001 济源市 420000 湖北省 420100 武汉市 429004 仙桃市 429005 潜江市 429006 天门市 430000 湖南省 430100 长沙市 430124 宁乡市
430181 浏阳市 430300 湘潭市 430381 湘乡市 440000 广东省 440100 广州市 440113 番禺区 440300 深圳市 440305 南山区 450000 广西壮族自治区 450100 南宁市 460000 海南省 460100 海口市
500000 重庆市 500103 渝中区 510000 四川省 510100 成都市 510181 都江堰市 510182 彭州市 510183 邛崃市 510184 崇州市 510185 简阳市 511300 南充市 511381 阆中市 520000 贵州省 520100 贵阳市
520181 清镇市 520300 遵义市 520382 仁怀市 530000 云南省 530100 昆明市 530181 安宁市 540000 西藏自治区 540100 拉萨市 610000 陕西省 610100 西安市 620000 甘肃省 620100 兰州市 630000 青海省
640000 宁夏回族自治区 650000 新疆维吾尔自治区
"""  # fmt: skip

SCHEMA = "code string, name string"


def divisions(spark: SparkSession) -> DataFrame:
    """(code, name) of DIVISIONS."""
    parts = DIVISIONS.split()
    return spark.createDataFrame(list(zip(parts[::2], parts[1::2], strict=True)), SCHEMA)


def tree(table: DataFrame) -> DataFrame:
    """(code, name, level, ancestor, ancestor_name, ancestor_level): each division with itself and all that are above it. table: code, name; rows of other than six digits, without a name, or
    of a code that came before are left out. Levels: 1 province, 2 prefecture, 3 county. The codes above a code are known from it, so that one equi-join finds those that the table has."""
    own = table.select(F.trim("code").alias("code"), F.trim("name").alias("name")).where(F.col("code").rlike("^[0-9]{6}$") & (F.length("name") > 0))
    own = own.groupBy("code").agg(F.min("name").alias("name"))
    level = F.when(F.col("code").endswith("0000"), 1).when(F.col("code").endswith("00"), 2).otherwise(3)
    own = own.withColumn("level", level)
    above = F.array_distinct(F.array("code", F.concat(F.substring("code", 1, 4), F.lit("00")), F.concat(F.substring("code", 1, 2), F.lit("0000"))))
    up = own.select("code", "name", "level", F.explode(above).alias("ancestor"))
    return up.join(own.select(F.col("code").alias("ancestor"), F.col("name").alias("ancestor_name"), F.col("level").alias("ancestor_level")), "ancestor").select("code", "name", "level", "ancestor", "ancestor_name", "ancestor_level")


def county_table(table: DataFrame) -> DataFrame:
    """(name, target): each county-level city, by name, with the nearest division above it that is a city: its prefecture, or the municipality. Prefectures and municipalities have themselves.
    Counties of a province's own have no city above them and are left out, as are names that several cities have: a name alone doesn't settle those."""
    t = tree(table)
    cities = t.where("ancestor_level = 2 or (ancestor_level = 1 and ancestor_name like '%市')")
    up = cities.where("level = 3 and name like '%市' or level < 3 and code = ancestor").groupBy("code", "name").agg(F.max_by("ancestor_name", "ancestor_level").alias("target"))
    return up.groupBy("name").agg(F.min("target").alias("target"), F.count_distinct("target").alias("n")).where("n = 1").select("name", "target")


def gazetteer_names(table: DataFrame) -> DataFrame:
    """(code, level, name, part): the names that a division goes by in addresses: its own, and for provinces and prefectures the name without its ending, of two characters or more."""
    own = tree(table).where("code = ancestor").select("code", "level", "name")
    short = F.regexp_replace("name", "(特别行政区|维吾尔自治区|壮族自治区|回族自治区|自治区|自治州|地区|省|市|盟)$", "")
    parts = F.when(F.col("level") < 3, F.array_distinct(F.array("name", short))).otherwise(F.array("name"))
    return own.withColumn("part", F.explode(parts)).where(F.length("part") > 1)


def segment(df: DataFrame, addr: str, table: DataFrame) -> DataFrame:
    """df with seg_province, seg_city, seg_district: the best path of the tree through the names that the address contains; '' where there is none. table: code, name.

    A path is a division and those above it. It is as good as the number of its levels whose names come in the address, one behind the other, then as its deepest level found, the length of the
    names found, how early it begins, and the smaller code: a district's name that several cities have is settled by the city or province before it. A prefecture's place in a municipality, 市辖区 or nothing,
    is the municipality itself. Null and blank addresses have ''. Each distinct address is segmented once; its parts meet the names by equality, and its paths their ancestors by code."""
    names = gazetteer_names(table).select("code", "part")
    asked = df.select(F.col(addr).alias("_addr")).where(F.length(F.trim("_addr")) > 0).distinct()
    # dealt by address, in parts that aren't merged by their few bytes: each has some hundred parts of its own
    asked = asked.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_addr")
    sizes = sorted(names.select(F.collect_set(F.length("part")).alias("s")).first()["s"])  # some tens of lengths
    places = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_addr") - n + 1, F.lit(1))), lambda i: F.struct(i.alias("at"), F.substring(F.col("_addr"), i, F.lit(n)).alias("part")))
    cut = F.concat(*[places(n) for n in sizes]) if sizes else F.array().cast("array<struct<at:int,part:string>>")
    # names and paths are a country's divisions, some thousands: they go to where the parts are, and no part is shuffled
    met = asked.withColumn("p", F.explode(cut)).select("_addr", F.col("p.at").alias("at"), F.col("p.part").alias("part")).join(F.broadcast(names), "part")
    # of a division's names the longest at its first place counts
    found = met.groupBy("_addr", "code").agg(F.min(F.struct("at", (-F.length("part")).alias("n"))).alias("m")).select("_addr", "code", F.col("m.at").alias("at"), (-F.col("m.n")).alias("n"))
    up = tree(table).select("code", "level", "ancestor", "ancestor_level")
    every = found.groupBy("_addr").agg(F.collect_list(F.struct("code", "at", "n")).alias("_all")).select("_addr", "_all", F.explode("_all").alias("f"))
    path = every.select("_addr", "_all", F.col("f.code").alias("code"), F.col("f.at").alias("at")).join(F.broadcast(up), "code")
    path = path.withColumn("a", F.get(F.filter("_all", lambda x: x["code"] == F.col("ancestor")), F.lit(0))).where("a is not null").select("_addr", "code", "level", "ancestor", "at", F.col("a.at").alias("a_at"), F.col("a.n").alias("a_n"))
    # what is above stands before; names may share characters only with themselves
    path = path.where("code = ancestor or a_at + a_n <= at")
    best = path.groupBy("_addr", "code").agg(F.count(F.lit(1)).alias("levels"), F.max("level").alias("level"), F.sum("a_n").alias("size"), F.min("a_at").alias("begin"))
    chosen = best.groupBy("_addr").agg(F.min_by("code", F.struct(-F.col("levels"), -F.col("level"), -F.col("size"), F.col("begin"), F.col("code"))).alias("code"))
    whole = tree(table).groupBy("code").agg(*(F.max(F.when(F.col("ancestor_level") == i, F.col("ancestor_name"))).alias(f"l{i}") for i in (1, 2, 3)))
    city = F.coalesce("l2", F.when(F.col("l1").endswith("市"), F.col("l1")), F.lit(""))
    out = chosen.join(F.broadcast(whole), "code").select("_addr", F.coalesce("l1", F.lit("")).alias("seg_province"), F.when(city == "市辖区", F.col("l1")).otherwise(city).alias("seg_city"), F.coalesce("l3", F.lit("")).alias("seg_district"))
    filled = {c: F.coalesce(c, F.lit("")) for c in ("seg_province", "seg_city", "seg_district")}
    return df.join(out, df[addr] == out["_addr"], "left").drop("_addr").withColumns(filled)
