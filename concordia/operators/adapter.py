"""A low-rank adapter on frozen vectors, tuned on mined pairs: y = x + x A B, scaled to length 1.

Pairs are dealt into batches by a hash of their query; the other positives and hard negatives of its batch are a query's negatives. In each step every task computes the gradients of its batches at
the same weights, they are added up, and the driver, which holds the weights alone, moves them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Adapter:
    """a: width times rank, b: rank times width; b is zero before tuning, so that vectors begin as they are."""

    a: np.ndarray
    b: np.ndarray

    def __call__(self, vectors) -> np.ndarray:
        x = np.asarray(vectors, dtype=np.float64)
        y = x + x @ self.a @ self.b
        return y / np.maximum(np.sqrt((y * y).sum(-1, keepdims=True)), 1e-12)


def begin(width: int, rank: int = 16, seed: int = 42) -> Adapter:
    return Adapter(np.random.default_rng(seed).normal(0, 1 / np.sqrt(width), (width, rank)), np.zeros((rank, width)))


def gradients(adapter: Adapter, q: np.ndarray, p: np.ndarray, n: np.ndarray, scale: float = 20.0) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient of a, gradient of b) of a batch, summed over its queries: the cross entropy of each query's positive among all positives and negatives of the batch. n may have fewer rows."""
    x = np.concatenate([q, p, n])
    inner = x @ adapter.a
    y = x + inner @ adapter.b
    size = np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-12)
    z = y / size
    m = len(q)
    s = scale * z[:m] @ z[m:].T
    s -= s.max(1, keepdims=True)
    e = np.exp(s)
    chance = e / e.sum(1, keepdims=True)
    at = np.arange(m)
    loss = float((np.log(e.sum(1)) - s[at, at]).sum())
    chance[at, at] -= 1
    dz = np.concatenate([scale * chance @ z[m:], scale * chance.T @ z[:m]])
    dy = (dz - z * (z * dz).sum(1, keepdims=True)) / size
    return loss, x.T @ (dy @ adapter.b.T), inner.T @ dy


def rate_at(step: int, steps: int, rate: float, warmup: float) -> float:
    """The rate rises over the warm-up's share of the steps, then falls to nothing."""
    rise = int(steps * warmup)
    return rate * ((step + 1) / rise if step < rise else max(0.0, (steps - step) / max(1, steps - rise)))


def tune(pairs: DataFrame, *, batch: int = 64, steps: int = 30, rate: float = 0.5, warmup: float = 0.1, rank: int = 16, seed: int = 42, scale: float = 20.0) -> tuple[Adapter, list[float]]:
    """(adapter, loss a query at each step). pairs: q_id, qv, pv, and nv (a hard negative's vector or null), all of one width and frozen; a few numbers a pair, which are kept between steps.

    Batches are groups of about `batch` queries by hash: the same in every run and step. Pairs without a query's or a positive's vector are left out; without any pair the adapter is as it began.
    A step is one pass over the pairs; what comes back is one sum for each task's group."""
    pairs = pairs.where("qv is not null and pv is not null").select("q_id", "qv", "pv", "nv")
    n = pairs.count()
    if not n:
        return begin(0, rank, seed), []
    groups = max(1, n // batch)
    dealt = pairs.withColumn("batch", F.pmod(F.xxhash64(F.lit(seed), F.col("q_id").cast("string")), F.lit(groups)).cast("int")).repartition("batch").sortWithinPartitions("batch", "q_id").persist()
    width = len(dealt.first()["qv"])
    adapter, losses = begin(width, rank, seed), []

    def run(batches, now: Adapter):
        total = [0.0, np.zeros_like(now.a), np.zeros_like(now.b)]

        def add(rows):
            pdf = pd.concat(rows)
            hard = pdf["nv"].dropna()
            stack = lambda v: np.stack(v.to_numpy()) if len(v) else np.zeros((0, width))
            for i, g in enumerate(gradients(now, stack(pdf["qv"]), stack(pdf["pv"]), stack(hard), scale)):
                total[i] = total[i] + g

        held: list = []  # the rows of one batch, which may come in several frames
        for pdf in batches:
            for _, rows in pdf.groupby("batch", sort=True):
                if held and held[0]["batch"].iloc[0] != rows["batch"].iloc[0]:
                    add(held)
                    held = []
                held.append(rows)
        if held:
            add(held)
        yield pd.DataFrame({"loss": [total[0]], "a": [total[1].ravel()], "b": [total[2].ravel()]})

    try:
        for step in range(steps):
            parts = dealt.mapInPandas(lambda batches, now=adapter: run(batches, now), "loss double, a array<double>, b array<double>")
            # one row a task: twice width times rank numbers each, added up on the executors
            sums = parts.select("loss", *(F.posexplode(F.concat("a", "b")).alias("i", "g") for _ in (0,))).groupBy("i").agg(F.sum("g").alias("g"), F.sum("loss").alias("loss"))
            rows = sums.collect()
            grad = np.zeros(2 * width * rank)
            for r in rows:
                grad[r["i"]] = r["g"]
            losses.append(rows[0]["loss"] / n)
            move = rate_at(step, steps, rate, warmup) / n
            adapter = Adapter(adapter.a - move * grad[: width * rank].reshape(width, rank), adapter.b - move * grad[width * rank :].reshape(rank, width))
    finally:
        dealt.unpersist()
    return adapter, losses


def adapted(load, adapter: Adapter):
    """A loader for models.encode: the model that `load` gives, with the adapter behind it."""

    def loaded():
        model = load()
        return lambda texts: adapter(model(texts)).astype(np.float32).tolist()

    return loaded
