"""Operators and stages on odd tables: null ids, empty and long texts, ties, repeated rows, no rows, and columns named like those that the operators make."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from concordia.llm import bpe, chat, html, importance, jaccard, linededup, mixing, packing, pii, quality, tokencount

CLASHING = {"kept": False, "verdict": "mine", "n_lines": "mine", "n_dropped": "mine", "host": "h", "copies": 7, "component_id": -5, "key": "k", "own": 1, "id": "x", "part": 0, "chunk": 0, "n_words": "w", "hash": 3, "node": 1, "label": "l", "size": 2, "a.b": "dot"}
LONG = " ".join(f"word{i * 7919 % 5003} of{i % 11}" for i in range(70_000))  # about a megabyte


def clashing(docs):
    """docs with the columns of CLASHING."""
    return docs.withColumns({c: F.lit(v) for c, v in CLASHING.items()})


def documents(spark):
    texts = ["", None, " \n ", "a b c", LONG, LONG + " end", "same line of text here\nother line of text\n" * 3, "Same line of text here \nkept", "x <|endoftext|> \\ y <|im_end|> on 1985-03-14T10:00:00Z", "twelve words are in this one so that it is kept by all rules"]
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[9], (None, "a b c", None, "s1", None), (None, texts[9], None, None, None), (20, texts[9], "en", "s1", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def pages(docs):
    body = F.when(F.col("text").isNotNull(), F.concat(F.lit("<html><body><nav>Home</nav><article><p>"), F.left(F.col("text"), F.lit(5000)), F.lit("</p></article></body></html>")))
    return docs.select(F.col("doc_id").alias("page_id"), F.when(F.col("source").isNotNull(), F.concat(F.lit("http://"), "source", F.lit("/x"))).alias("url"), body.alias("html"), *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "source")))


def vocab(name):
    return pytest.importorskip("public_tokenizers").path(name)


def conversation(docs):
    return docs.select(F.col("doc_id").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.col("lang").alias("role"), "text", *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "lang")))


OPERATORS = {
    "mixing": lambda d: mixing.mix_sources(d),
    "chat": lambda d: chat.format_chat(conversation(d)).select("conv_id", F.md5("formatted").alias("f"), F.to_json("spans").alias("s")),
    "line_dedup": lambda d: linededup.dedup_lines(d, counts=("n1", "n2")).select("doc_id", F.md5("text").alias("t"), "n1", "n2"),
    "bpe": lambda d: bpe.digests(d, vocab("byte_bpe_50k.json")),
    "html": lambda d: html.extract(pages(d)),
    "pii": lambda d: pii.pseudonymize(d, key="k").select("doc_id", F.md5("text").alias("t"), "n_pii", "n_date"),
    "token_counts": lambda d: tokencount.count_tokens(d, vocab("byte_bpe_50k.json")),
    "jaccard": lambda d: jaccard.jaccard_components(d),
    "quality": lambda d: quality.judge(d, carry=("doc_id",)).select("doc_id", "n_words", "n_repeat_words", "base_failed", "kept"),
    "importance": lambda d: importance.resample(d, d.select("text").limit(3), percent=50),
    "packing": lambda d: packing.pack(d, vocab("word_bpe_49k.json"), size=64).groupBy("doc_id").agg(F.sum("length").alias("n")),
}
#: Rows that the operators give for the odd documents: one a row, but for conversations and packed documents by id.
BY_ID = {"chat": 12, "packing": 12}


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_bear_odd_tables(spark, name):
    docs = documents(spark)
    plain = rows(OPERATORS[name](docs))
    assert len(plain) == BY_ID.get(name, docs.count())
    assert rows(OPERATORS[name](clashing(docs))) == plain
    assert OPERATORS[name](clashing(docs).limit(0)).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_bear_odd_tables(spark, sf, stage):
    _, run = corpus_pipeline.STAGES[stage]
    docs = documents(spark)
    if stage == 4:
        vocab("byte_bpe_50k.json")
    plain = run(spark, docs, sf)
    mine = clashing(docs).withColumn("Kept", F.lit("text")) if stage else clashing(docs)
    own = run(spark, mine, sf)
    shown = [c for c in plain.columns if c in own.columns]
    dotted = lambda c: F.col(f"`{c}`")
    if stage != 3:  # a row's place in the mix follows from all that it has
        assert rows(own.select(*map(dotted, shown))) == rows(plain.select(*map(dotted, shown)))
    if stage < 4:
        assert own.columns == mine.columns
        assert {tuple(r) for r in own.select(*map(dotted, CLASHING)).collect()} <= {tuple(r) for r in mine.select(*map(dotted, CLASHING)).collect()}
        assert (own.count() > 0) == (plain.count() > 0) and (stage == 0 or own.count() > 0)  # the first one's host fails as a whole
    assert run(spark, mine.limit(0), sf).count() == 0


@pytest.mark.parametrize("kind", ["boolean", "string"])
def test_a_column_named_kept_loses_no_document(spark, sf, kind):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, sf).select("doc_id").collect()}
    own = docs.withColumn("Kept", F.lit(False).cast(kind))
    assert {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, own, sf).select("doc_id").collect()} == want and len(want) > 100


def test_dates_with_a_time_behind_them(spark):
    df = spark.createDataFrame([(1, "at 1985-03-14T10:00:00Z, 1985-03-14 10:00 and 1985-03-14. Not 1985-03-14x or 1985-03-14T.")], "doc_id long, text string")
    (row,) = pii.pseudonymize(df, key="k").collect()
    import re

    found = re.match(r"at (\S+)T10:00:00Z, (\S+) 10:00 and (\S+)\. Not 1985-03-14x or 1985-03-14T\.$", row["text"])
    assert found and len(set(found.groups())) == 1 and found.group(1) != "1985-03-14" and row["n_date"] == 3


def test_runs_lie_in_the_shared_folder(spark):
    runs = linededup.LineRuns(spark, 4)
    linededup.dedup_lines(documents(spark), runs=runs).count()
    (run,) = runs.tables()
    shared = spark.conf.get("spark.checkpoint.dir")
    assert run.inputFiles() and all(f.startswith(shared.replace("file://", "file:").rstrip("/").replace("file:/", "file:///")) or shared.split("file://")[-1] in f for f in run.inputFiles())
    files = runs.files.root
    runs.drop()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert not fs.exists(p) or not [f for f in fs.listStatus(p)]


def test_a_record_too_long_is_no_silent_loss(spark, monkeypatch):
    monkeypatch.setattr(chat, "LONGEST_RECORD", 200)
    df = spark.createDataFrame([(1, '{"prompt": "' + "x" * 300 + '", "completion": "y"}')], "conv_id long, record string")
    with pytest.raises(Exception, match="200 bytes"):
        chat.json_turns(df).collect()
    turns = spark.createDataFrame([(i, 0, "user", "x" * 300 if i % 2 else "short") for i in range(12)], "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, chat.through_layouts(turns).select("conv_id", "text").collect())) == sorted(map(tuple, turns.select("conv_id", "text").collect()))
