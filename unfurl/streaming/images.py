"""Unwrapping of images as they arrive: each micro-batch of volume rows is
unwrapped like a table and appended to a Parquet sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.grow import Options, unwrap_volumes


def unwrap_stream(volumes: DataFrame, out: str, checkpoint: str, options: Options = Options(), available_now: bool = True) -> StreamingQuery:
    """volumes: a streaming DataFrame of single-echo volume rows. The write of a
    batch is keyed by its number, so a replayed batch replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        unwrap_volumes(batch, options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = volumes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
