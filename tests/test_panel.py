"""Panels, gates and small helpers on odd inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.operators import backtest, cleaning, cross_section, intrahour, panel, pool

H = [dt.datetime(2024, 1, 1, k) for k in range(12)]


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(H[k], s, float(10 * s + k) if (k + s) % 3 else None, 1.0 * k) for k in range(12) for s in range(1, 4) if not (s == 3 and k > 5)]
    return spark.createDataFrame(rows, "t timestamp, symbol int, close double, volume double").cache()


def test_grid_and_fills(bars):
    dates = panel.calendar(bars, 1.0, "backtest")
    assert [r["t"] for r in dates.orderBy("t").collect()] == H[:6]
    dense = panel.densify(bars, panel.calendar(bars))
    assert dense.count() == 36
    own = {(r["t"], r["symbol"]): r["close"] for r in dense.collect()}
    assert own[H[11], 3] == 35.0 and own[H[0], 3] is None and own[H[2], 1] == 11.0
    limited = panel.densify(bars, panel.calendar(bars), []).withColumn("f", panel.forward_fill(F.col("close"), 1)).where("symbol = 3 and t > '2024-01-01 06:30:00'")
    assert {r["f"] for r in limited.collect()} == {None}
    assert panel.densify(bars.limit(0), bars.limit(0).select("t")).collect() == []


def test_margins_universe_and_append(spark, bars):
    dates = bars.select("t").distinct()
    assert sorted({r["t"] for r in panel.margins(bars, dates, 3, 2).collect()}) == H[3:10]
    cover = spark.createDataFrame([(1, "ok", H[11]), (2, "ok", H[3]), (3, "bad", H[11])], "symbol int, status string, max_ts timestamp")
    assert {r["symbol"] for r in panel.universe(bars, cover, H[5]).collect()} == {1}
    old = bars.where(F.col("t") < F.lit(H[4]))
    assert panel.append_new(old, bars).count() == bars.count()
    assert panel.fixed_schema(bars, {"symbol": "string", "none": "double"}).dtypes == [("symbol", "string"), ("none", "double")]


def test_gates(spark, bars):
    df = panel.labels(panel.densify(bars, panel.calendar(bars)), [1]).withColumn("f", F.col("close"))
    assert pool.subset(df, 1.0).count() == df.count() and pool.subset(df, 0.0).count() == 0
    assert isinstance(pool.gate(df, "f", "y_ret_fwd_1h", 0.0), bool) and not pool.gate(df, "f", "y_ret_fwd_1h", 2.0)
    assert pool.robust_gate(df, "f", "y_ret_fwd_1h", 2.0) is False
    rest = df.withColumn("r", pool.residual("close", {"f": 1.0, "volume": 0.1}, 1)).where("close is not null")
    assert {r["r"] for r in rest.collect()} == {0.0}
    log = spark.createDataFrame([(1, 0.1), (2, 0.3), (3, 0.2)], "step int, objective double")
    got = [round(r["reward"], 6) for r in pool.shape_reward(log, "delta_best").orderBy("step").collect()]
    assert got == [0.1, 0.2, 0.0]
    assert [round(r["reward"], 6) for r in pool.shape_reward(log, "delta_obj").orderBy("step").collect()] == [0.1, 0.2, -0.1]


def test_scores_of_constant_and_missing_symbols(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (2, "a", None), (2, "b", 1.0), (3, "a", 1.0), (3, "b", 3.0)], "t int, symbol string, x double")
    z = {p: {(r["t"], r["symbol"]): r["z"] for r in df.withColumn("z", cross_section.zscore(F.col("x"), p)).collect()} for p in ("strict", "guard", "zero")}
    assert z["strict"][1, "a"] is None and z["guard"][1, "a"] == 0 and z["guard"][2, "a"] is None and z["zero"][2, "a"] == 0 and z["guard"][3, "b"] == 1


def test_neutral_fills_and_timeframes(bars):
    filled = bars.withColumns(cleaning.neutral_fill({"close": "ffill", "volume": "zero"}))
    assert filled.where("volume is null").count() == 0
    assert backtest.periods_per_year("1h") == 8760 and backtest.periods_per_year("15m") == 35040 and backtest.periods_per_year("1d") == 365


def test_intra_hour_on_a_thin_and_a_wild_hour(spark):
    start = dt.datetime(2024, 1, 1)
    calm = [("a", start + dt.timedelta(minutes=k), 10.0, 10.1, 9.9, 10.0 + (k % 5) / 10, 1.0 + k) for k in range(30)]
    wild = [("a", start + dt.timedelta(minutes=40), 10.0, 20.0, 9.0, 15.0, 1.0)]
    thin = [("a", start + dt.timedelta(hours=1, minutes=k), 1.0, 2.0, 1.0, 1.0, 0.0) for k in range(3)]
    kept = intrahour.minutes(spark.createDataFrame([*calm, *wild, *thin], "symbol string, t timestamp, open double, high double, low double, close double, volume double"))
    n = {r["h"].hour: (r["n_minutes"], r["n_minutes_kept"]) for r in intrahour.volume_moments(kept).collect()}
    assert n == {0: (31, 30), 1: (3, 3)}
    for f in (intrahour.shape, intrahour.correlations, intrahour.shares, intrahour.realised, intrahour.tail, intrahour.up_down, intrahour.trends, intrahour.top_volume, intrahour.segments, intrahour.amihud):
        assert f(kept).count() == 2
    assert intrahour.shape(kept).where("h = timestamp '2024-01-01 01:00:00'").first()["shape_skew"] is None
    assert intrahour.volume_profile(kept).count() == 1
