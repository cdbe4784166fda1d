"""Hourly bars as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly_stream(ticks: DataFrame, order: list[str], late: str = "0 seconds", unit: str = "1 hour") -> DataFrame:
    """Bars of a stream of ticks (symbol, ts, price, quantity), each once, when its hour is over for certain.

    Ticks that come after the watermark passed their hour drop out.
    """
    key = F.struct("ts", *order)
    bars = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", unit).alias("w")).agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"),
        F.sum("quantity").alias("volume"), F.sum(F.col("price") * F.col("quantity")).alias("quote"),
    )
    return bars.select("symbol", F.col("w.start").alias("t"), "open", "high", "low", "close", "volume", F.try_divide(F.col("quote"), F.col("volume")).alias("vwap"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all there is and write the finished bars as Parquet, exactly once for each checkpoint."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def refresh(stream: DataFrame, checkpoint: str, update: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Call ``update(new bars, batch)`` for each batch: row-frame factors are evaluated again over their look-back there."""
    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).outputMode("append").start()
