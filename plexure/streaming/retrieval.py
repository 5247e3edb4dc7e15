"""Retrieval for a stream of query vectors against a fixed reference: an addition of ours, not an operator of the survey."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plexure.operators.retrieval import query_edges


def stream_edges(queries: DataFrame, reference: DataFrame, path: str, checkpoint: str, threshold: float = 0.3, k: int = 10) -> StreamingQuery:
    """Write the edges of each micro-batch of ``queries`` (vec_id, embedding) under ``path``, a folder a batch.

    A batch that is run again overwrites its own folder, so what was written stays whole after a failure.
    """

    def put(batch: DataFrame, number: int) -> None:
        query_edges(batch, reference, threshold, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
