"""Queries that arrive as a stream, answered against a static index micro-batch by micro-batch (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.sharded import search


def answer_stream(queries: DataFrame, index: DataFrame, k: int, out_path: str, checkpoint: str, **how) -> StreamingQuery:
    """queries: a stream of (query_id, embedding). Results are appended as Parquet, one folder a batch, so a batch run again replaces itself."""

    def answer(batch: DataFrame, batch_id: int) -> None:
        search(index, batch, k, **how).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
