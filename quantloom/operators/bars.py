"""Bars from ticks and from finer bars, and joins of sparse side series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.windows import history


def hour() -> Column:
    return F.date_trunc("hour", F.col("t"))


def ticks_to_bars(ticks: DataFrame, unit: str, order: list[str]) -> DataFrame:
    """symbol, t, open, high, low, close, volume, quote, vwap, n of ticks (symbol, ts, price, quantity, and a total order)."""
    key, value = F.struct("ts", *order), F.col("price") * F.col("quantity")
    return ticks.groupBy("symbol", F.date_trunc(unit, F.col("ts")).alias("t")).agg(
        F.min_by("price", key).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", key).alias("close"),
        F.sum("quantity").alias("volume"),
        F.sum(value).alias("quote"),
        F.try_divide(F.sum(value), F.sum("quantity")).alias("vwap"),
        F.count(F.lit(1)).alias("n"),
    )


def typical(high: str = "high", low: str = "low", close: str = "close") -> Column:
    return (F.col(high) + F.col(low) + F.col(close)) / 3


def hourly(bars: DataFrame, floor_volume: float | None = None) -> DataFrame:
    """symbol, t, open, high, low, close, volume, vwap by hour; vwap by typical price.

    ``floor_volume``: the denominator's least value (the streamed variant), else no volume gives NULL.
    """
    volume = F.sum("volume")
    under = F.greatest(volume, F.lit(floor_volume)) if floor_volume else volume
    return bars.groupBy("symbol", hour().alias("t")).agg(
        F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "t").alias("close"),
        volume.alias("volume"), F.try_divide(F.sum(typical() * F.col("volume")), under).alias("vwap"),
    )


def hourly_micro(bars: DataFrame) -> DataFrame:
    """Hourly vwap, vwap_dev, rv (deviation of minute returns, which cross hours, by sqrt 60) and volume_cv."""
    ret = F.try_divide(F.col("close"), F.lag("close").over(history())) - 1
    out = bars.withColumn("ret", ret).groupBy("symbol", hour().alias("t")).agg(
        F.max_by("close", "t").alias("close"), F.try_divide(F.sum(typical() * F.col("volume")), F.sum("volume")).alias("vwap"),
        (F.stddev_samp("ret") * F.sqrt(F.lit(60.0))).alias("rv"), F.try_divide(F.stddev_samp("volume"), F.avg("volume")).alias("volume_cv"),
    )
    return out.select("symbol", "t", "vwap", (F.try_divide(F.col("close"), F.col("vwap")) - 1).alias("vwap_dev"), "rv", "volume_cv")


def minute_orderflow(trades: DataFrame, order: list[str], whale: float = 50_000.0, retail: float = 1_000.0) -> DataFrame:
    """One-minute order flow of trades (symbol, ts, price, quantity, maker: the buyer is)."""
    quote, buy = F.col("price") * F.col("quantity"), ~F.col("maker")
    total = lambda keep, x: F.sum(F.when(keep, x).otherwise(F.lit(0.0)))
    key, sides = F.struct("ts", *order), {"buy": buy, "sell": ~buy}
    out = [F.count(F.lit(1)).alias("trade_count"), F.sum("quantity").alias("base_volume"), F.sum(quote).alias("quote_volume")]
    for name, side in sides.items():
        out += [
            total(side, F.col("quantity")).alias(f"taker_{name}_qty"), total(side, quote).alias(f"taker_{name}_quote"),
            total(side, quote * quote).alias(f"taker_{name}_quote_sq"), F.count(F.when(side, 1)).alias(f"taker_{name}_trade_count"),
            total(side & (quote >= whale), quote).alias(f"whale_{name}_quote"), total(side & (quote <= retail), quote).alias(f"retail_{name}_quote"),
        ]
    out += [F.min_by("price", key).alias("price_first"), F.max_by("price", key).alias("price_last"), F.max("price").alias("price_high"), F.min("price").alias("price_low")]
    return trades.groupBy("symbol", F.date_trunc("minute", "ts").alias("t")).agg(*out)


def hourly_orderflow(minutes: DataFrame, tw_norm: str = "fixed") -> DataFrame:
    """Hourly order flow of :func:`minute_orderflow`; the time-weighted flow is over 1830, or the weights of the minutes there are."""
    cvd = F.col("taker_buy_quote") - F.col("taker_sell_quote")
    weight = F.minute("t") + 1
    s = lambda c: F.sum(c)
    under = F.lit(1830.0) if tw_norm == "fixed" else F.sum(weight)
    g = minutes.groupBy("symbol", hour().alias("t")).agg(
        s("trade_count").alias("trades"), s("base_volume").alias("base_volume"), s("quote_volume").alias("quote_volume"), s(cvd).alias("cvd"),
        s(F.col("whale_buy_quote") - F.col("whale_sell_quote")).alias("whale_cvd"), s(F.col("retail_buy_quote") - F.col("retail_sell_quote")).alias("retail_cvd"),
        s("taker_buy_quote").alias("buy"), s("taker_sell_quote").alias("sell"), s("taker_buy_trade_count").alias("buys"), s("taker_sell_trade_count").alias("sells"),
        s(F.col("taker_buy_quote_sq") + F.col("taker_sell_quote_sq")).alias("squares"), (s(weight * cvd) / under).alias("tw_cvd"),
        F.min_by("price_first", "t").alias("first"), F.max_by("price_last", "t").alias("last"),
    )
    change = F.col("last") - F.col("first")
    return g.select(
        "symbol", "t", "trades", "base_volume", "quote_volume", "cvd", "whale_cvd", "retail_cvd", "tw_cvd",
        F.try_divide(F.col("quote_volume"), F.col("base_volume")).alias("vwap"),
        F.try_divide(F.col("buy"), F.col("buys")).alias("avg_buy"), F.try_divide(F.col("sell"), F.col("sells")).alias("avg_sell"),
        F.try_divide(F.col("squares"), F.col("quote_volume") * F.col("quote_volume")).alias("hhi"),
        F.try_divide(F.col("cvd"), F.col("quote_volume")).alias("imbalance"), change.alias("price_change"),
        F.try_divide(F.col("cvd"), F.abs(change)).alias("cvd_per_move"),
    )


def last_by_hour(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The last value that is there of each column, by hour."""
    return rows.groupBy("symbol", hour().alias("t")).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("t"))).alias(c) for c in columns))


def asof_backward(bars: DataFrame, series: DataFrame, column: str) -> DataFrame:
    """Each bar with the series' last value at or before it, on or off the bars' grid: one exchange by symbol."""
    rows = bars.select("symbol", "t", F.lit(None).cast("double").alias(column), F.lit(1).alias("_bar"), F.struct(*bars.columns).alias("_row"))
    side = series.select("symbol", "t", F.col(column).cast("double").alias(column), F.lit(0).alias("_bar"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    upto = Window.partitionBy("symbol").orderBy("t", "_bar").rowsBetween(Window.unboundedPreceding, 0)
    return side.unionByName(rows).withColumn(column, F.last(column, True).over(upto)).where("_bar = 1").select("_row.*", column)


def asof_exact(bars: DataFrame, series: DataFrame, column: str) -> DataFrame:
    """Each bar with the series' value at its own time, carried forward; stamps off the grid are lost."""
    joined = bars.join(series.select("symbol", "t", column), ["symbol", "t"], "left")
    return joined.withColumn(column, F.last(column, True).over(history().rowsBetween(Window.unboundedPreceding, 0)))


def funding_grid(funding: DataFrame, end) -> DataFrame:
    """symbol, t, rate on every hour from a symbol's first funding time to ``end``, carried forward."""
    hours = funding.groupBy("symbol").agg(F.date_trunc("hour", F.min("t")).alias("a")).select("symbol", F.explode(F.sequence("a", F.lit(end).cast("timestamp"), F.expr("interval 1 hour"))).alias("t"))
    return asof_backward(hours, funding, "rate")


def funding_features(funded: DataFrame, rate: str = "rate", extreme: float = 0.30) -> DataFrame:
    """annualised (three payments a day), its change, and whether it is extreme."""
    year = F.col(rate) * 1095
    return funded.withColumns({"annualised": year, "annualised_diff": year - F.lag(year).over(history()), "extreme": F.abs(year) > extreme})


def liquidations(orders: DataFrame) -> DataFrame:
    """Hourly long (sold) and short (bought) liquidated quantity and notional; repeated rows count once."""
    notional = F.col("price") * F.col("quantity")
    side = lambda s, x: F.sum(F.when(F.col("side") == s, x).otherwise(0.0))
    return orders.dropDuplicates().groupBy("symbol", hour().alias("t")).agg(
        side("SELL", F.col("quantity")).alias("long_qty"), side("SELL", notional).alias("long_notional"),
        side("BUY", F.col("quantity")).alias("short_qty"), side("BUY", notional).alias("short_notional"), F.count(F.lit(1)).alias("n"),
    )


def liquidation_summary(orders: DataFrame) -> DataFrame:
    """Hourly liq_amount (sum), liq_price (mean) and liq_long_count (sold) of liquidation orders; hours without any are not there."""
    return orders.groupBy("symbol", hour().alias("t")).agg(F.sum("quantity").alias("liq_amount"), F.avg("price").alias("liq_price"), F.count_if(F.col("side") == "SELL").alias("liq_long_count"))


def taker_ratio(trades: DataFrame) -> DataFrame:
    """Hourly share of bought quantity; 0.5 without any."""
    bought = F.sum(F.when(~F.col("maker"), F.col("quantity")).otherwise(0.0))
    return trades.groupBy("symbol", F.date_trunc("hour", "ts").alias("t")).agg(F.coalesce(F.try_divide(bought, F.sum("quantity")), F.lit(0.5)).alias("taker_ratio"))


def adjust_forward(prices: DataFrame, factor: str = "factor", as_of=None) -> DataFrame:
    """Prices by their factor over the symbol's last one, volume the other way round; a missing factor carries on, then is 1.

    ``as_of``: over the factor of the last bar at or before that time (NULL prices if there is none).
    """
    own = F.coalesce(F.last(factor, True).over(history().rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    df = prices.withColumn("_f", own)
    every = history().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last("_f") if as_of is None else F.last(F.when(F.col("t") <= F.lit(as_of), F.col("_f")), True)
    df = df.withColumn("_r", F.col("_f") / last.over(every))
    scaled = {c: F.col(c) * F.col("_r") for c in ("open", "high", "low", "close") if c in prices.columns}
    return df.withColumns(scaled | ({"volume": F.try_divide(F.col("volume"), F.col("_r"))} if "volume" in prices.columns else {})).drop("_f", "_r")
