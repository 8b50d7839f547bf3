"""Interfaces for what a model or a network service computes, and stand-ins that need neither."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PairScorer(Protocol):
    def __call__(self, query: Column, candidate: Column) -> Column: ...


class Geocoder(Protocol):
    """An address, and a city that it is likely in or '': what is found, or None. A GeocodeError tells what went wrong, and whether asking again may help."""

    def __call__(self, address: str, city: str) -> dict | None: ...


class GeocodeError(Exception):
    def __init__(self, kind: str, again: bool = False, stop: bool = False):
        """kind: a few words, such as 'timeout'. stop: the service answers nobody any more, as when a day's calls are used up."""
        super().__init__(kind)
        self.kind, self.again, self.stop = kind, again, stop


def budget_batches(lengths: list[int], budget: int) -> Iterator[list[int]]:
    """Places of texts by length, the longest first, in batches whose padded size, the longest length times their number, is within budget; a longer text is a batch of its own."""
    batch: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if batch and lengths[batch[0]] * (len(batch) + 1) > budget:
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def in_batches(texts: list[str], model: Callable[[list], list], budget: int, tokens: Callable[[str], list] = list, most: int = 256, join: Callable[[list], str] | None = None) -> list:
    """model's answers for all texts, in their order. tokens cuts a text into what the model counts; of more than `most` the rest is left out, as encoders do. join makes a text of tokens again
    for models that take texts; without it the model gets lists of tokens."""
    cut = [tokens(t)[:most] for t in texts]
    out: list = [None] * len(texts)
    for batch in budget_batches([max(1, len(t)) for t in cut], budget):
        for i, answer in zip(batch, model([join(cut[i]) if join else cut[i] for i in batch]), strict=True):
            out[i] = answer
    return out


def encode(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], out: str = "vector", *, budget: int | None = None, tokens: Callable[[str], list] = list, join: Callable[[list], str] = "".join, most: int = 256) -> DataFrame:
    """df with a vector for each text. load() is called once in each Python worker and returns a function from texts to unit vectors. With a budget, texts of an Arrow batch go to the model by
    length, in batches of at most so many tokens, padding counted, and cut at `most` tokens; tokens and join say what a token is (a character by default). Rows keep their order."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            texts = texts.fillna("").tolist()
            yield pd.Series(model(texts) if budget is None else in_batches(texts, model, budget, tokens, most, join))

    return df.withColumn(out, run(F.col(text)))


def hashing_encoder(width: int = 64):
    """Letter trigrams hashed to a unit vector: an encoder for tests."""
    import zlib

    import numpy as np

    def model(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), width), np.float32)
        for row, t in zip(out, texts, strict=True):
            for i in range(len(t) - 2):
                row[zlib.crc32(t[i : i + 3].encode()) % width] += 1
            row /= max(1e-9, float(np.linalg.norm(row)))
        return out.tolist()

    return lambda: model


def tri_encode(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], tuple[list, list, list]]]) -> DataFrame:
    """df with three encodings of each text by one pass of a model: dense (a unit vector), sparse (token to weight) and multi (a vector a token)."""
    @F.pandas_udf("struct<dense array<float>, sparse map<string,float>, multi array<array<float>>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            dense, sparse, multi = model(texts.fillna("").tolist())
            yield pd.DataFrame({"dense": dense, "sparse": sparse, "multi": multi})

    return df.withColumn("_encoded", run(F.col(text))).select(*df.columns, "_encoded.dense", "_encoded.sparse", "_encoded.multi")


#: Fixed value: what a reranking model is asked.
YES_PROMPT = "Given a query A and a passage B, determine whether the passage contains an answer to the query by providing a prediction of either 'Yes' or 'No'."


def yes_token_scorer(load: Callable[[], tuple[Callable[[str], list], Callable[[list[list]], list[float]]]], *, side: int = 256, most: int = 512) -> PairScorer:
    """A pair scorer that asks a language model: the logit of its token Yes after 'A: query', 'B: candidate' and YES_PROMPT, in lines. load() returns (tokens, yes): tokens of a text, and
    the Yes logit behind each of several lists of tokens. Each side has `side` tokens at most and all of it `most`. Pairs of one length go to the model together, so that none is padded."""

    def scores():
        tokens, yes = load()
        end, asked = tokens("\n"), tokens(YES_PROMPT)

        def score(pairs: list[tuple[str, str]]) -> list[float]:
            made = [[*tokens(f"A: {a}")[:side], *end, *tokens(f"B: {b}")[:side], *end, *asked][:most] for a, b in pairs]
            out, by_size = [0.0] * len(made), {}
            for i, m in enumerate(made):
                by_size.setdefault(len(m), []).append(i)
            for same in by_size.values():
                for i, s in zip(same, yes([made[i] for i in same]), strict=True):
                    out[i] = float(s)
            return out

        return score

    return udf_scorer(scores)


def geocode_dry_run(df: DataFrame, address: str, n: int = 5) -> tuple[int, list[str]]:
    """How many calls geocode() would make, and the first addresses in order; no call is made."""
    return df.count(), [r[0] for r in df.select(address).orderBy(address).limit(n).collect()]


def udf_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> PairScorer:
    """A pair scorer that calls a model on Arrow batches; put it above the top-k filter."""
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in batches:
            yield pd.Series(model(list(zip(a, b, strict=True))), dtype="float64")

    return lambda query, candidate: run(query, candidate)


#: What is found of an address.
FOUND = ("province", "city", "district", "adcode")


def _asked(geocoder: Geocoder, address: str | None, city: str | None, pause: float, retries: int, wait: float) -> tuple[dict, str | None, bool]:
    """(what was found, kind of error or None, whether to stop) of one address, after `retries` more calls at most; each waits twice as long as the one before."""
    import time

    if not (address or "").strip():
        return {}, "blank", False
    for i in range(retries + 1):
        time.sleep(pause if not i else max(pause, wait * 2 ** (i - 1)))
        try:
            found = geocoder(address, city or "")
            return found or {}, None if found else "not found", False
        except GeocodeError as e:
            if not e.again or i == retries:
                return {}, e.kind, e.stop
        except Exception as e:  # noqa: BLE001  what a service's client raises
            return {}, type(e).__name__, False
    raise AssertionError


def geocode(df: DataFrame, address: str, geocoder: Geocoder, pause: float = 0.05, callers: int = 1, *, city: str | None = None, retries: int = 2, wait: float = 0.5) -> DataFrame:
    """Adds found_province, found_city, found_district, found_adcode and found_error (null where something was found, else its kind: blank, not found, or the error's) by `callers` tasks, each
    of which waits `pause` before a call and longer before one that it repeats. city: a column that hints at the city. Once the service stops, the caller's other rows say 'stopped'.
    The rows are dealt to the callers, so that what makes them keeps its own tasks. Pass distinct rows that need it alone, or use geocode_table."""
    names = df.columns

    def run(batches):
        stopped = False
        for pdf in batches:
            rows, errors = [], []
            for a, c in zip(pdf[address], pdf[city] if city else [""] * len(pdf), strict=True):
                found, error, stop = ({}, "stopped", True) if stopped else _asked(geocoder, a, c, pause, retries, wait)
                stopped = stopped or stop
                rows.append(found)
                errors.append(error)
            for f in FOUND:
                pdf[f"found_{f}"] = [None if r.get(f) is None else str(r.get(f)) for r in rows]
            pdf["found_error"] = errors
            yield pdf[[*names, *(f"found_{f}" for f in FOUND), "found_error"]]

    schema = ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + [f"found_{f} string" for f in FOUND] + ["found_error string"])
    return df.repartition(callers).mapInPandas(run, schema)


def geocode_table(df: DataFrame, address: str, geocoder: Geocoder, path: str, *, city: str | None = None, rate: float = 20.0, callers: int = 4, batch: int = 1000, retries: int = 2, wait: float = 0.5) -> DataFrame:
    """df with found_* and found_error, by a table of answers at path that each run adds to: (key, address, city, found_*, found_error), where key is a hash of address and city.

    Each distinct address and city is asked once, whatever the rows that have it; what the table answers is not asked again, 'not found' included, other errors are. Calls go out at `rate` a second
    over all callers, and answers are written after each `batch` of them: a run that breaks off loses the batch in flight at most, and the next one goes on behind it. When the service
    stops, no further batch begins."""
    spark = df.sparkSession
    where = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    hint = where(city) if city else F.lit("")
    key = F.sha2(F.concat_ws("\n", where(address), hint), 256)
    asked = df.select(key.alias("key"), where(address).alias("address"), hint.alias("city")).where("address <> ''").distinct()
    columns = [f"found_{f}" for f in FOUND]

    def answers() -> DataFrame | None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return spark.read.parquet(path) if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else None

    final, run_id = "found_error is null or found_error = 'not found'", uuid.uuid4().hex
    while True:
        known = answers()
        todo = asked if known is None else asked.join(known.where(final).select("key"), "key", "left_anti")
        # what failed in this run isn't asked again by it
        todo = todo if known is None else todo.join(known.where(f"not ({final}) and run = '{run_id}'").select("key"), "key", "left_anti")
        part = todo.orderBy("key").limit(batch)
        if part.isEmpty():
            break
        geocode(part, "address", geocoder, callers / rate, callers, city="city", retries=retries, wait=wait).withColumn("run", F.lit(run_id)).write.mode("append").parquet(path)
        if not answers().where(f"run = '{run_id}' and found_error = 'stopped'").isEmpty():
            break
    known = answers()
    if known is None:
        return df.select("*", *(F.lit(None).cast("string").alias(c) for c in columns), F.lit("blank").alias("found_error"))
    best = known.groupBy("key").agg(F.min_by(F.struct(*columns, "found_error"), F.struct(F.col("found_error").isNotNull(), F.coalesce(F.col("found_error") != "not found", F.lit(False)))).alias("_a"))
    out = df.withColumn("_key", key).join(best.withColumnRenamed("key", "_key"), "_key", "left")
    missing = F.when(where(address) == "", "blank").when(F.col("_a").isNull(), "stopped").otherwise(F.col("_a.found_error"))
    return out.select(*(out[f"`{c}`"] for c in df.columns), *(F.col(f"_a.{c}") for c in columns), missing.alias("found_error"))


def http_geocoder(key: str, url: str, timeout: float = 10.0) -> Geocoder:
    """The first result of a web service that answers {status, geocodes: [{province, city, district, adcode}]}; None where it knows none. What goes wrong is a GeocodeError: a server's error, a
    lost connection or a time-out may go away, a refused key or quota (status 0, 401, 403, 429 after retries) stops."""

    def ask(address: str, city: str = "") -> dict | None:
        import urllib.error
        import urllib.parse
        import urllib.request
        from json import load

        asked = {"address": address, "key": key, "output": "JSON"} | ({"city": city} if city else {})
        try:
            with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(asked)}", timeout=timeout) as r:
                answer = load(r)
        except urllib.error.HTTPError as e:
            raise GeocodeError(f"http {e.code}", again=e.code >= 500 or e.code == 429, stop=e.code in (401, 403, 429)) from e
        except TimeoutError as e:
            raise GeocodeError("timeout", again=True) from e
        except OSError as e:
            raise GeocodeError("connection", again=True) from e
        except ValueError as e:
            raise GeocodeError("no JSON") from e
        if str(answer.get("status", "1")) != "1":
            raise GeocodeError(f"refused: {answer.get('info', '')}".strip(": "), stop=True)
        found = answer.get("geocodes") or []
        return found[0] if found else None

    return ask


def finetune(pairs_path: str, train: Callable[..., object], *, processes: int = 1, gpu: bool = True, local: bool = False, **options):
    """Runs train(pairs_path, **options), which tunes an encoder on the mined pairs written to pairs_path, in `processes` processes by TorchDistributor. An ImportError where torch isn't there."""
    import torch  # noqa: F401
    from pyspark.ml.torch.distributor import TorchDistributor

    return TorchDistributor(num_processes=processes, local_mode=local, use_gpu=gpu).run(train, pairs_path, **options)
