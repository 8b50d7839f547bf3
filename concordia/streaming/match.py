"""Matching of a stream of queries against a static candidate table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.match import dense_match


def match_stream(queries: DataFrame, candidates: DataFrame, k: int, path: str, checkpoint: str, **options):
    """Starts a query that appends each micro-batch's matches to path. Top-k by row number isn't defined over a stream, but is over each batch;
    a batch that is repeated after a failure overwrites its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        dense_match(batch, candidates, k, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
