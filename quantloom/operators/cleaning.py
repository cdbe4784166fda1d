"""Flags that say which bars can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.windows import history, whole


def rolling(x: Column, w: int, f, least: int | None = None) -> Column:
    """``f`` over the last ``w`` rows, NULL with under ``least`` (default: all) values."""
    rows = history().rowsBetween(-(w - 1), 0)
    return F.when(F.count(x).over(rows) >= (w if least is None else least), f(x).over(rows))


def gaps(bars: DataFrame, limit: int = 3605, cooldown: str = "2 hours") -> DataFrame:
    """gap_seconds, under_maintenance, cooldown_no_trade (from a gap's end for two hours, both ends in) and trade_allowed."""
    gap = F.coalesce((F.col("t").cast("double") - F.lag("t").over(history()).cast("double")), F.lit(0.0))
    flagged = bars.withColumn("gap_seconds", gap).withColumn("under_maintenance", (F.col("gap_seconds") > limit).cast("int"))
    last = F.max(F.when(F.col("under_maintenance") == 1, F.col("t"))).over(history().rowsBetween(Window.unboundedPreceding, 0))
    cool = F.coalesce(last >= F.col("t") - F.expr(f"interval {cooldown}"), F.lit(False))
    return flagged.withColumn("cooldown_no_trade", cool.cast("int")).withColumn("trade_allowed", (~cool & (F.col("under_maintenance") == 0)).cast("int"))


def is_spike(limit: float = 0.5) -> Column:
    ret = F.ln(F.try_divide(F.col("close"), F.lag("close").over(history())))
    return F.coalesce(F.abs(ret) > limit, F.lit(False))


def is_volume_spike(w: int = 168, least: int = 24, limit: float = 5.0) -> Column:
    v = F.col("volume")
    z = (v - rolling(v, w, F.avg, least)) / (rolling(v, w, F.stddev_samp, least) + 1e-8)
    return F.coalesce(z > limit, F.lit(False))


def winsor_upper(x: Column, q: float = 0.99) -> Column:
    """At most the symbol's quantile over its whole history (linear)."""
    return F.least(x, F.percentile(x, q).over(whole()))


def is_mature(least: int = 24) -> Column:
    return F.row_number().over(history()) - 1 >= least


def missing_hours(bars: DataFrame) -> DataFrame:
    """symbol, expected, actual, missing: hours between a symbol's first and last bar."""
    g = bars.groupBy("symbol").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.countDistinct("t").alias("actual"))
    expected = F.floor((F.col("b").cast("double") - F.col("a").cast("double")) / 3600).cast("long") + 1
    return g.select("symbol", expected.alias("expected"), "actual", (expected - F.col("actual")).alias("missing"))


def neutral_fill(columns: dict[str, str]) -> dict[str, Column]:
    """What stands for a missing value: zero (volumes), ffill (prices), half (ratios)."""
    fills = {"zero": lambda x: F.coalesce(x, F.lit(0.0)), "half": lambda x: F.coalesce(x, F.lit(0.5)), "ffill": lambda x: F.last(x, True).over(history().rowsBetween(Window.unboundedPreceding, 0))}
    return {c: fills[how](F.col(c)) for c, how in columns.items()}
