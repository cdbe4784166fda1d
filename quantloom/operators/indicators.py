"""Indicators over a dense panel's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.operators.cleaning import rolling
from quantloom.operators.windows import cross, history


def log_return(price: str = "close", k: int = 1) -> Column:
    return F.ln(F.try_divide(F.col(price), F.lag(price, k).over(history())))


def simple_return(price: str = "close", k: int = 1) -> Column:
    return F.try_divide(F.col(price), F.lag(price, k).over(history())) - 1


def _root(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def realised_vol(ret: Column, w: int) -> Column:
    """Of a staged return column: deviation by the root of the window."""
    return rolling(ret, w, F.stddev_samp) * float(w) ** 0.5


def parkinson(w: int) -> Column:
    import math

    hl = F.ln(F.try_divide(F.col("high"), F.col("low")))
    return _root(rolling(hl * hl, w, F.avg) / (4 * math.log(2))) * float(w) ** 0.5


def garman_klass(w: int) -> Column:
    import math

    hl, co = F.ln(F.try_divide(F.col("high"), F.col("low"))), F.ln(F.try_divide(F.col("close"), F.col("open")))
    return _root(rolling(0.5 * hl * hl - (2 * math.log(2) - 1) * co * co, w, F.avg)) * float(w) ** 0.5


def true_range() -> Column:
    """The largest of the bar's range and its distances to the close before; the first bar has its range."""
    before = F.lag("close").over(history())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(range_: Column, w: int) -> Column:
    """Of a staged true range."""
    return rolling(range_, w, F.avg)


def volume_weighted_vol(ret: Column, w: int) -> Column:
    """Root of the volume-weighted mean square of a staged return."""
    v = F.when(ret.isNotNull(), F.col("volume"))
    return _root(F.try_divide(rolling(ret * ret * v, w, F.sum), rolling(v, w, F.sum))) * float(w) ** 0.5


def bollinger_width(w: int, k: float = 2.0) -> Column:
    return F.try_divide(2 * k * rolling(F.col("close"), w, F.stddev_samp), rolling(F.col("close"), w, F.avg))


def rolling_vwap(w: int = 24, least: int = 1) -> Column:
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    return F.try_divide(rolling(tp * F.col("volume"), w, F.sum, least), rolling(F.col("volume"), w, F.sum, least))


def turnover_ratio(w: int) -> Column:
    return F.try_divide(F.col("volume"), rolling(F.col("volume"), w, F.avg))


def price_efficiency(vol: Column, atr_: Column) -> Column:
    """A staged volatility over the staged average true range as a share of the close."""
    return F.try_divide(vol, F.try_divide(atr_, F.col("close")))


def vol_regime(vol: Column, w: int) -> Column:
    """A staged volatility over its own mean of ``w`` bars."""
    return F.try_divide(vol, rolling(vol, w, F.avg))


def change(x: str) -> Column:
    """From the bar before."""
    return F.col(x) - F.lag(x).over(history())


def open_interest(df: DataFrame, oi: str = "oi_open_interest", usd: str = "oi_open_interest_usd") -> DataFrame:
    """Append oi_delta and oi_delta_usd, and these over the bar's volume and over its quote volume."""
    out = df.withColumns({"oi_delta": change(oi), "oi_delta_usd": change(usd)})
    return out.withColumns({"oi_delta_over_volume": F.col("oi_delta") / (F.col("volume") + 1e-12), "oi_delta_usd_over_quote_volume": F.col("oi_delta_usd") / (F.col("close") * F.col("volume") + 1e-12)})


def availability(df: DataFrame, bar: str = "1 hour") -> DataFrame:
    """Append bar_end_time and feature_time: a bar is known a millisecond after its end."""
    end = F.col("t") + F.expr(f"interval {bar}")
    return df.withColumns({"bar_end_time": end, "feature_time": end + F.expr("interval 1 millisecond")})


def universe_size(dates: DataFrame, n_symbols: int) -> DataFrame:
    """t, cs_universe_size, cs_coverage_frac of a calendar with counts."""
    return dates.select("t", F.col("n_symbols").alias("cs_universe_size"), (F.col("n_symbols") / n_symbols).alias("cs_coverage_frac"))


def relative_volume() -> Column:
    return F.try_divide(F.col("volume"), F.avg("volume").over(cross()))


def funding_pressure(rate: str = "rate") -> Column:
    """A symbol's funding rate less the median of all at that time."""
    return F.col(rate) - F.median(rate).over(cross())


def basis(price: str, index: str) -> Column:
    return F.try_divide(F.col(price) - F.col(index), F.col(index))
