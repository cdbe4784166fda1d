"""Statistics of the minutes inside an hour.

All functions take one-minute bars (symbol, t, open, high, low, close, volume) and return symbol, h
(the hour) and their columns. Returns start at 0 in every hour.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.windows import by_minute, in_hour

EPS = 1e-12
KEYS = ("symbol", "h")


def minutes(bars: DataFrame, max_ratio: float = 1.2, least: int = 10) -> DataFrame:
    """Minutes with their hour, place i, log return r (0 at the first), minute of the hour m.

    Minutes with high over low above ``max_ratio`` go, unless fewer than ``least`` would stay. kept and
    all_n, max_ratio carry what the hour had.
    """
    ratio = F.try_divide(F.col("high"), F.col("low"))
    df = bars.withColumn("h", F.date_trunc("hour", "t")).withColumn("ratio", ratio).withColumn("good", F.coalesce(F.col("ratio") <= max_ratio, F.lit(False)))
    df = df.withColumns({"all_n": F.count(F.lit(1)).over(in_hour()), "good_n": F.sum(F.col("good").cast("int")).over(in_hour()), "ratio_max": F.max("ratio").over(in_hour())})
    df = df.where(F.col("good") | (F.col("good_n") < least))
    r = F.ln(F.try_divide(F.col("close"), F.lag("close").over(by_minute())))
    i = F.row_number().over(by_minute()) - 1
    return df.withColumns({"i": i, "m": F.minute("t"), "r": r}).withColumns({"r1": F.col("r"), "r": F.coalesce("r", F.lit(0.0))})


def _by_hour(df: DataFrame, *columns: Column) -> DataFrame:
    return df.groupBy(*KEYS).agg(*columns)


def _share(keep: Column, x: str = "volume") -> Column:
    return F.try_divide(F.sum(F.when(keep, F.col(x)).otherwise(0.0)), F.sum(x))


def _corrected(x: Column, least: int) -> tuple[Column, Column]:
    """Bias-corrected skewness and excess kurtosis; NULL under ``least`` values."""
    n = F.count(x).cast("double")
    skew = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    return F.when(n >= least, skew), F.when(n >= least, kurt)


def _corr(x: Column, y: Column, least: int = 10) -> Column:
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    scale = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.count(x) >= least) & (scale > 0), F.try_divide(F.covar_pop(x, y), scale))


def volume_moments(df: DataFrame) -> DataFrame:
    mean, std = F.avg("volume"), F.stddev_pop("volume")
    return _by_hour(df, F.max("all_n").alias("n_minutes"), F.count(F.lit(1)).alias("n_minutes_kept"), F.max("ratio_max").alias("min_range_ratio_max"), mean.alias("vol_1m_mean"), std.alias("vol_1m_std"), (std / (mean + EPS)).alias("vol_1m_cv"), F.stddev_pop("ratio").alias("range_ratio_1m_std"), F.stddev_pop(F.ln("ratio")).alias("log_range_1m_std"))


def up_down(df: DataFrame) -> DataFrame:
    sq = F.col("r") * F.col("r")
    up, down = F.sum(F.when(F.col("r") > 0, sq).otherwise(0.0)), F.sum(F.when(F.col("r") < 0, sq).otherwise(0.0))
    total = F.sum(sq)
    return _by_hour(df, F.sqrt(up).alias("up_vol_l2"), F.sqrt(down).alias("down_vol_l2"), F.try_divide(up, total).alias("up_var_share"), F.try_divide(down, total).alias("down_var_share"))


def realised(df: DataFrame) -> DataFrame:
    l2 = F.sqrt(F.sum(F.col("r") * F.col("r")))
    return _by_hour(df, (F.stddev_pop("r") * 60**0.5).alias("rv_std_sqrt60"), l2.alias("rv_l2"), (l2 / (F.avg("volume") + EPS)).alias("rv_per_vol"))


def shape(df: DataFrame) -> DataFrame:
    out = []
    for name, x in (("", F.col("r1")), ("Vol", F.col("volume"))):
        skew, kurt = _corrected(x, 10)
        out += [skew.alias(f"shape_skew{name}"), kurt.alias(f"shape_kurt{name}"), (skew / (F.abs(kurt) + EPS)).alias(f"shape_skratio{name}")]
    return _by_hour(df, *out)


def amihud(df: DataFrame) -> DataFrame:
    under = F.greatest(F.col("volume") * F.col("close"), F.lit(EPS))
    return _by_hour(df, F.avg(F.abs("r1") / F.greatest("volume", F.lit(EPS))).alias("liq_amihud"), F.sum(F.col("r") / under).alias("amihud_signed"), F.sum(F.abs("r") / under).alias("amihud_abs"))


def shares(df: DataFrame) -> DataFrame:
    m = F.col("m")
    return _by_hour(df, _share(m >= 55).alias("liq_last_5min_R"), _share((m < 5) | (m >= 55)).alias("liq_funding_impact"), _share(m < 10).alias("liq_top_of_hour_ratio"), F.max(F.hour("h").isin(0, 8, 16).cast("int")).alias("is_funding_hour"), F.avg(F.try_divide(F.col("high") - F.col("low"), F.col("volume"))).alias("liq_range_vol_ratio"), F.stddev_pop(F.try_divide(F.col("high") - F.col("low"), F.col("close"))).alias("liq_spread_std"))


def tail(df: DataFrame, start: int = 50) -> DataFrame:
    sq = F.col("r") * F.col("r")
    late = F.sum(F.when(F.col("m") >= start, sq).otherwise(0.0))
    return _by_hour(df, F.try_divide(F.sqrt(late), F.sqrt(F.sum(sq))).alias("liq_tail_risk"), F.try_divide(late, F.sum(sq)).alias("liq_tail_var_share"))


def correlations(df: DataFrame) -> DataFrame:
    before_v, before_c = F.lag("volume").over(by_minute()), F.lag("close").over(by_minute())
    d = df.withColumns({"v0": before_v, "c0": before_c}).withColumn("dv", F.greatest(F.least(F.try_divide(F.col("volume"), F.col("v0")) - 1, F.lit(10.0)), F.lit(-10.0)))
    c, v = F.col("close"), F.col("volume")
    return _by_hour(d, _corr(F.col("r1"), v).alias("corr_prv"), _corr(F.col("r1"), F.col("dv")).alias("corr_prvr"), _corr(c, v).alias("corr_pv"), _corr(c, F.col("v0")).alias("corr_pvd"), _corr(F.col("c0"), v).alias("corr_pvl"), _corr(c, F.col("dv")).alias("corr_pvr"))


def weighted_quantiles(df: DataFrame, least: int = 12) -> DataFrame:
    """doc_vol_pdf*: the first return at which volume, summed in the order of returns, reaches a share; bi: of |return|."""
    d = df.withColumn("kept", F.count(F.lit(1)).over(in_hour())).where(F.col("r1").isNotNull() & (F.col("volume") > 0)).withColumn("a", F.abs("r1"))
    total = F.sum("volume").over(in_hour())
    upto = lambda c: F.sum("volume").over(in_hour().orderBy(c, "t").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumns({"cr": upto("r1"), "ca": upto("a"), "w": total})
    cut = lambda x, cum, q: F.when(F.max("kept") >= least, F.min(F.when(F.col(cum) >= q * F.col("w"), F.col(x))))
    return _by_hour(d, *(cut("r1", "cr", q / 100).alias(f"doc_vol_pdf{q}") for q in (60, 70, 80, 90, 95)), cut("a", "ca", 0.9).alias("doc_vol_pdf90bi"))


def volume_profile(df: DataFrame, bins: int = 25, least: int = 12) -> DataFrame:
    """doc_std, doc_skew, doc_kurt, doc_vol{5,10,50}_ratio of an hour's volume in equal bins of its returns; empty bins count."""
    d = df.withColumn("kept", F.count(F.lit(1)).over(in_hour())).where(F.col("r1").isNotNull() & (F.col("kept") >= least))
    low, high = F.min("r1").over(in_hour()), F.max("r1").over(in_hour())
    flat = high <= low
    d = d.withColumns({"lo": F.when(flat, low - 1e-8).otherwise(low), "hi": F.when(flat, high + 1e-8).otherwise(high)})
    b = F.least(F.floor((F.col("r1") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    one = d.withColumn("b", b).groupBy(*KEYS).agg(*(F.sum(F.when(F.col("b") == k, F.greatest("volume", F.lit(0.0))).otherwise(0.0)).alias(f"b{k}") for k in range(bins)))
    one = one.select(*KEYS, F.array(*(f"b{k}" for k in range(bins))).alias("v"))
    total = lambda f: F.aggregate(F.transform("v", f), F.lit(0.0), lambda a, x: a + x)
    one = one.withColumn("sum", total(lambda x: x)).withColumn("mu", F.col("sum") / bins)
    power = lambda p: lambda x: reduce(lambda a, b: a * b, [x - F.col("mu")] * p)
    one = one.withColumns({f"m{p}": total(power(p)) / bins for p in (2, 3, 4)})
    std, some = F.sqrt("m2"), F.col("m2") > 0
    top = lambda k: F.when(F.col("sum") > 0, F.aggregate(F.slice(F.sort_array("v", asc=False), 1, min(k, bins)), F.lit(0.0), lambda a, x: a + x) / F.col("sum"))
    return one.select(*KEYS, std.alias("doc_std"), F.when(some, F.col("m3") / (std * std * std + EPS)).alias("doc_skew"), F.when(some, F.col("m4") / (std * std * std * std + EPS) - 3).alias("doc_kurt"), *(top(k).alias(f"doc_vol{k}_ratio") for k in (5, 10, 50)))


def segments(df: DataFrame, cut: int = 45) -> DataFrame:
    """seg_head_logret, seg_tail_logret (open of the part to its close), their difference and the tail's share of the sum of both sizes."""
    late = F.col("m") >= cut
    part = lambda keep: F.ln(F.max_by("close", F.when(keep, F.col("t"))) + EPS) - F.ln(F.min_by("open", F.when(keep, F.col("t"))) + EPS)
    d = _by_hour(df, part(~late).alias("seg_head_logret"), part(late).alias("seg_tail_logret"))
    head, tail_ = F.col("seg_head_logret"), F.col("seg_tail_logret")
    return d.withColumns({"seg_tail_minus_head": tail_ - head, "seg_tail_share": F.abs(tail_) / (F.abs(head) + F.abs(tail_) + EPS)})


def us_open(bars: DataFrame) -> DataFrame:
    """symbol, h, seg_us_open_60m_logret: New York 09:30's open to 10:29's close, on the UTC hour of the latter."""
    local = F.from_utc_timestamp("t", "America/New_York")
    clock = F.date_format(local, "HH:mm")
    d = bars.withColumns({"day": F.to_date(local), "clock": clock}).where(F.col("clock").isin("09:30", "10:29"))
    g = d.groupBy("symbol", "day").agg(F.max(F.when(F.col("clock") == "09:30", F.col("open"))).alias("a"), F.max(F.when(F.col("clock") == "10:29", F.col("close"))).alias("b"), F.max(F.when(F.col("clock") == "10:29", F.col("t"))).alias("at"))
    return g.where("a is not null and b is not null").select("symbol", F.date_trunc("hour", "at").alias("h"), F.ln(F.try_divide(F.col("b"), F.col("a"))).alias("seg_us_open_60m_logret"))


def top_volume(df: DataFrame, q: float = 0.8) -> DataFrame:
    d = df.withColumn("cut", F.percentile("volume", q).over(in_hour()))
    top = F.col("volume") >= F.col("cut")
    return _by_hour(d, _share(top).alias("vol_top20_frac"), F.sum(F.when(top, F.col("r")).otherwise(0.0)).alias("vol_top20_logret_sum"))


def trends(df: DataFrame, columns: tuple[str, ...] = ("close", "high", "low")) -> DataFrame:
    """qrs_beta (an hour's slope of the log price), qrs_r2 and their product; 0 fit without spread; three minutes at least."""
    out = []
    for c in columns:
        y, x = F.ln(c), F.col("i").cast("double")
        enough, spread = F.count(y) >= 3, F.var_pop(y)
        beta = F.when(enough, F.try_divide(F.covar_pop(x, y), F.var_pop(x)) * 60)
        cov = F.covar_pop(x, y)
        r2 = F.when(enough, F.when(spread > 1e-18, F.least(F.greatest(F.try_divide(cov * cov, F.var_pop(x) * spread), F.lit(0.0)), F.lit(1.0))).otherwise(0.0))
        out += [beta.alias(f"qrs_beta_{c}_per_hour"), r2.alias(f"qrs_r2_{c}"), (beta * r2).alias(f"qrs_{c}")]
    return _by_hour(df, *out)


def stability(hours: DataFrame, rv: str = "rv_std_sqrt60", w: int = 24) -> DataFrame:
    """rv_stability: an hour's realised volatility over its mean of the last ``w`` hours."""
    rows = Window.partitionBy("symbol").orderBy("h").rowsBetween(-(w - 1), 0)
    return hours.withColumn(f"rv_stability_{w}h", F.when(F.count(rv).over(rows) == w, F.col(rv) / (F.avg(rv).over(rows) + EPS)))
