"""Matching a stream of records against targets that stand still."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocking import TrigramBlocker


def block_stream(stream: DataFrame, blocker: TrigramBlocker, out: str, checkpoint: str, k: int = 20) -> StreamingQuery:
    """Candidates of each micro-batch, one folder a batch, so a repeated batch replaces its own rows."""

    def one(batch: DataFrame, number: int) -> None:
        blocker.query(batch, k).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
