"""Streaming use of the row-local functions.

The column functions of ``ferrowick.functions`` are plain expressions and run on streaming frames as
they are. Operators that need a total order over the whole table do not apply to streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(stream: DataFrame, time: str, keys: list[str], every: str, late: str, **columns: Column) -> DataFrame:
    """Aggregates per key and tumbling window; rows later than ``late`` are left out and state is dropped behind it."""
    out = stream.withWatermark(time, late).groupBy(F.window(time, every), *keys).agg(*[c.alias(n) for n, c in columns.items()])
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *columns)


def each_batch(stream: DataFrame, f: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch operator on every micro-batch and writes its result; a repeated batch overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        f(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
