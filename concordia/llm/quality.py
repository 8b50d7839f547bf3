"""Quality rules with verdicts by host.

Each document is measured against rules. Failures of each rule are counted by host (pre-aggregated in each task); the host's rate is shrunk towards the mean of all hosts by a
beta prior fitted to the hosts' rates by moments, so that a host with few documents isn't judged by them alone. Verdicts come from the posterior: a host whose rate is surely above what
hosts have on average is suspect for that rule, and a host of which surely most documents break a base rule is rejected. They are joined back to the host's documents: a rejected host loses
all of them, a suspect one those that break its rule. Elsewhere a soft rule alone rejects nothing: a clean document isn't dropped for its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, table, words

SYMBOLS = "#*$%&|<>"


def measures(text: Column) -> dict[str, Column]:
    """Columns by name for a chain of projections, each on those before; see measure()."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    without = text
    for c in SYMBOLS:
        without = F.replace(without, F.lit(c), F.lit(""))
    return {"_words": words(text), "_lines": lines, "n_symbols": (F.octet_length(text) - F.octet_length(without)).cast("long")}


def measure(docs: DataFrame, text_col: str = "text", window: int = 5) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_text_lines, n_dup_lines, n_repeat_words (long) to docs; null texts have none of any.

    n_repeat_words: words inside some window of five words that the text has twice or more, the first included. Windows are hashed, sorted
    with their places, and neighbours compared; the words that the places found cover are then a sum over the gaps between them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumns(measures(text))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_text_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    })
    at = lambda i, k: F.get(F.col("_hashes"), i + k)
    windows = F.when(F.size("_hashes") > window, F.transform(F.sequence(F.lit(0), F.size("_hashes") - window), lambda i: F.xxhash64(*[at(i, k) for k in range(window)])))
    out = out.withColumn("_windows", F.coalesce(windows, F.array().cast("array<bigint>"))).drop("_words", "_lines", "_hashes")
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    here = F.col("_sorted")
    n = F.size(here)
    found = F.filter(
        F.transform(here, lambda x, i: F.when((x["h"] == F.get(here, i - 1)["h"]) | (x["h"] == F.get(here, i + 1)["h"]), x["i"])), lambda p: p.isNotNull()
    )
    out = out.withColumn("_found", F.when(n > 0, F.sort_array(found))).drop("_windows", "_sorted")
    places = F.col("_found")
    gaps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), lambda p, q: F.least(F.coalesce(q - p, F.lit(window)), F.lit(window)))
    covered = F.aggregate(gaps, F.lit(0), lambda a, g: a + g)
    return out.withColumn("n_repeat_words", F.when(F.size(places) > 0, covered).otherwise(0).cast("long")).drop("_found")


#: A document breaks a rule where its expression is true. Base rules reject by themselves, soft ones where their host is suspect.
BASE_RULES = {"too_short": "n_words < 10", "repetitive": "100 * n_repeat_words > 20 * n_words"}
SOFT_RULES = {"symbols": "10 * n_symbols > n_words", "duplicate_lines": "10 * n_dup_lines > 3 * n_text_lines", "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words"}
#: Deviations of the posterior that make a verdict sure; the share of failing documents above which a host is rejected.
SURE, MOST = 2, 0.5


#: What judge adds to the columns that it carries, but for the verdict.
ADDED = ("n_words", "word_chars", "n_symbols", "n_text_lines", "n_dup_lines", "n_repeat_words", "base_failed", *(f"fails_{r}" for r in SOFT_RULES), "host", "host_ok")


def host_verdicts(measured: DataFrame) -> DataFrame:
    """(host, n_docs, host_ok, suspect_<rule>), one row a host. measured: host, base_failed, and fails_<rule> for each soft rule.

    For each count, with m and v the mean and variance of the hosts' rates (each host once), the prior's strength is m (1 - m) / v - 1, kept within 1 and 1000; it is 1000
    where all rates agree. With p = (failed + strength * m) / (docs + strength) and d its posterior deviation, a host is suspect for a rule where p - SURE * d > m, and rejected where
    that of its base failures exceeds MOST. A host that is null is one host."""
    rules = ["base", *SOFT_RULES]
    failed = {"base": F.col("base_failed")} | {r: F.col(f"fails_{r}") for r in SOFT_RULES}
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *(F.sum(c.cast("long")).alias(f"k_{r}") for r, c in failed.items()))
    rate = lambda r: F.col(f"k_{r}") / F.col("n_docs")
    prior = hosts.agg(*(f(rate(r)).alias(f"{n}_{r}") for r in rules for n, f in (("m", F.avg), ("v", F.var_pop)))).first()  # a few numbers, however many hosts there are

    def least(r):
        """The rate that the host surely has, and the mean."""
        m, v = prior[f"m_{r}"] or 0.0, prior[f"v_{r}"]
        strength = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v and v > 1e-12 else 1000.0
        p = (F.col(f"k_{r}") + F.lit(strength * m)) / (F.col("n_docs") + F.lit(strength))
        return p - SURE * F.sqrt(p * (1 - p) / (F.col("n_docs") + F.lit(strength + 1))), m

    suspect = [(least(r)[0] > F.lit(least(r)[1])).alias(f"suspect_{r}") for r in SOFT_RULES]
    return hosts.select("host", "n_docs", (least("base")[0] <= MOST).alias("host_ok"), *suspect)


def judge(docs: DataFrame, *, text_col: str = "text", host: Column | None = None, carry: tuple[str, ...] = ("doc_id",), verdict: str = "kept") -> DataFrame:
    """One row a document: carry, the measures, base_failed, fails_<rule>, host_ok, kept, or whatever name `verdict` gives that last one.

    A document goes if it breaks a base rule, if its host is rejected, or if it breaks a soft rule that its host is suspect for. Null text: no words, so base_failed. Null hosts are one
    host; empty tables give no rows; repeated rows count each; a carried column that is named like a measure, or the verdict, takes its place: name the verdict so that none is (common.fresh). Texts are read once: their measures are written and the rest works on those."""
    host = F.col("source") if host is None else host
    scratch = Scratch(docs.sparkSession, "quality")
    # the caller's columns travel in one, whatever their names
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_own"), host.alias("host"), F.col(text_col).alias("_text"))
    measured = measure(base, "_text").drop("_text")
    measured = measured.withColumn("base_failed", F.expr(" or ".join(f"({r})" for r in BASE_RULES.values())))
    measured = measured.withColumns({f"fails_{k}": F.expr(r) for k, r in SOFT_RULES.items()})
    measured = scratch.write(measured, "measured")
    verdicts = scratch.write(host_verdicts(measured), "hosts")
    out = measured.alias("d").join(verdicts.alias("h"), F.col("d.host").eqNullSafe(F.col("h.host")))
    breaks = F.expr(" or ".join(f"(fails_{r} and suspect_{r})" for r in SOFT_RULES))
    found = out.select("_own", *(F.col(f"d.{c}") for c in measured.columns if c not in ("_own", "host")), F.col("d.host").alias("host"), "host_ok", (~F.col("base_failed") & F.col("host_ok") & ~breaks).alias(verdict))
    clash = {c.lower() for c in carry}
    return found.select(*(F.col("_own").getField(c).alias(c) for c in carry), *(c for c in found.columns if c != "_own" and c.lower() not in clash))


def op9_quality(spark, sf_dir):
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
   list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
windows AS (SELECT doc_id, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM hits) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
   CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
   CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
   CAST(len(ls) AS BIGINT) AS n_text_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
   FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, 10 * n_symbols > n_words AS f1, 10 * n_dup_lines > 3 * n_text_lines AS f2,
   (word_chars < 2 * n_words OR word_chars > 15 * n_words) AS f3 FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS k0, sum(f1::INT) AS k1, sum(f2::INT) AS k2, sum(f3::INT) AS k3 FROM f GROUP BY source),
r AS (SELECT source, n, unnest([0, 1, 2, 3]) AS rule, unnest([k0, k1, k2, k3]) AS k FROM h),
p AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) AS v FROM r GROUP BY rule),
s AS (SELECT rule, m, CASE WHEN v > 1e-12 THEN least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS strength FROM p),
q AS (SELECT source, rule, n, m, strength, (k + strength * m) / (n + strength) AS p FROM r JOIN s USING (rule)),
b AS (SELECT source, rule, p - 2 * sqrt(p * (1 - p) / (n + strength + 1)) > CASE WHEN rule = 0 THEN 0.5 ELSE m END AS bad FROM q),
ok AS (SELECT source, max(bad::INT) FILTER (WHERE rule = 0) = 1 AS r0, max(bad::INT) FILTER (WHERE rule = 1) = 1 AS r1, max(bad::INT) FILTER (WHERE rule = 2) = 1 AS r2, max(bad::INT) FILTER (WHERE rule = 3) = 1 AS r3
   FROM b GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR r0 OR (f1 AND r1) OR (f2 AND r2) OR (f3 AND r3)) AS kept
FROM f JOIN ok ON f.source IS NOT DISTINCT FROM ok.source
"""
