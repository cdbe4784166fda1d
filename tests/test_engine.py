"""Operators outside the expression language, and every query against its SQL twin on the smallest tables."""

import datetime as dt
import json
import math
import struct
import zipfile
import zlib
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quantloom.functions import surrogate
from quantloom.operators import backtest, bars, cross_section, hygiene, panel, pool
from quantloom.queries import QUERIES, SQL
from quantloom.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(value):
    return round(float(value), 4) if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    cursor = sql.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str([normal(v) for v in r]) for r in cursor.fetchall())
    got = sorted(str([normal(r[c]) for c in columns]) for r in rows)
    assert rows
    for k, c in enumerate(columns):  # nothing is shown by rows of nulls
        assert any(x[c] is not None for x in rows), f"{c} is null everywhere"
    assert [p for p in zip(got, want, strict=True) if p[0] != p[1]][:3] == []


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def frame(spark, scores, rets):
    rows = [(dt.datetime(2024, 1, 1 + t), s, v, r) for t, (vs, rs) in enumerate(zip(scores, rets, strict=True)) for s, (v, r) in enumerate(zip(vs, rs, strict=True))]
    return spark.createDataFrame(rows, "t timestamp, symbol int, score double, ret double")


def test_long_short(spark):
    rng = np.random.default_rng(0)
    scores = [rng.normal(size=11).tolist() for _ in range(6)]
    scores[1][0] = None
    scores[2] = [None] * 10 + [1.0]
    scores[3] = [1.0, 2.0, 3.0] + [None] * 8
    rets = [rng.normal(size=11).tolist() for _ in range(6)]
    w = backtest.long_short_weights(frame(spark, scores, rets), 0.6, 0.6)
    by_day = {}
    for r in w.collect():
        by_day.setdefault(r["t"].day - 1, {})[r["symbol"]] = r["w"]
    for day, own in by_day.items():
        n = sum(v is not None for v in scores[day])
        assert math.isclose(sum(own.values()), 0, abs_tol=1e-12)
        assert math.isclose(sum(map(abs, own.values())), 1.0 if n >= 2 else 0.0, abs_tol=1e-12)
    assert [sum(v > 0 for v in by_day[d].values()) for d in (0, 3)] == [5, 1]  # 11 // 2 are long when both sides would overlap,
    assert [sum(v < 0 for v in by_day[d].values()) for d in (0, 3)] == [6, 1]  # and the rest are short; 3 symbols have room for one each
    curve = backtest.long_short_curve(w, 10).orderBy("t").collect()
    assert math.isclose(curve[0]["turnover"], 0.5) and math.isclose(curve[0]["net"], curve[0]["gross"] - 5e-4)


def test_quantile_groups_differ_by_one(spark):
    groups = backtest.quantile_returns(frame(spark, [[float(k) for k in range(23)], [1.0] * 3 + [None] * 20], [[1.0] * 23] * 2), 5).orderBy("t").collect()
    assert groups[0]["q1"] == 1.0 and groups[1]["q1"] is None
    with pytest.raises(ValueError):
        backtest.quantile_returns(frame(spark, [], []), 1)
    with pytest.raises(ValueError):
        backtest.quantile_spreads(frame(spark, [], []), 5, 3, 3)


def test_summary_of_a_hand_worked_curve(spark):
    net, turnover = [0.01, -0.02, 0.03, 0.0], [0.5, 0.1, 0.2, 0.0]
    bars = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(zip(net, turnover, strict=True))], "t int, net double, turnover double")
    got = backtest.summarise(backtest.equity(bars, "net"), F.col("net"), 12, F.col("turnover")).first()
    year, vol = 1.005**12 - 1, math.sqrt((0.005**2 + 0.025**2 + 0.025**2 + 0.005**2) / 4) * math.sqrt(12)
    assert math.isclose(got["ann_return"], year) and math.isclose(got["ann_vol"], vol) and math.isclose(got["sharpe"], year / vol)
    assert math.isclose(got["max_drawdown"], -0.02) and math.isclose(got["avg_turnover"], 0.2) and math.isclose(got["final_equity"], 1.01 * 0.98 * 1.03) and got["n"] == 4


def test_bars_without_valid_symbols_stay(spark):
    groups = backtest.quantile_returns(frame(spark, [[1.0, 2.0], [None, None]], [[0.1, 0.3], [0.5, 0.5]]), 2).orderBy("t").collect()
    assert [(r["q1"], r["q2"]) for r in groups] == [(0.1, 0.3), (None, None)]


def test_swap_step():
    signal = {"a": 3.0, "b": 2.0, "c": 1.0}
    assert backtest.swap_step(signal, {}, 2, 1) == (["a", "b"], [])
    assert backtest.swap_step(signal, {"b": 3, "c": 3}, 2, 1) == ([], [])  # nothing bought yet: no swap
    assert backtest.swap_step(signal, {"b": 3, "c": 3}, 2, 0) == (["a"], ["c"])
    assert backtest.swap_step(signal, {"b": 3, "c": 0}, 2, 0, min_hold=1) == (["a"], ["b"])


def test_information_coefficients_of_odd_days(spark):
    rows = [(1, 1.0, 2.0), (1, 2.0, 4.0), (1, 3.0, 1.0), (2, 5.0, 1.0), (3, 1.0, 1.0), (3, 1.0, 3.0), (4, None, 1.0)]
    df = spark.createDataFrame(rows, "t int, x double, y double")
    ic = {r["t"]: r["ic"] for r in cross_section.ic_daily(df, "x", "y").collect()}
    assert math.isclose(ic[1], np.corrcoef([1, 2, 3], [2, 4, 1])[0, 1]) and ic[2] == 0 and ic[3] == 0 and ic[4] is None
    assert cross_section.ic_mean(cross_section.ic_daily(df, "x", "y"), strict=True).first()[0] is None
    ranks = df.where("t = 1").union(spark.createDataFrame([(1, 2.0, 0.0)], df.schema)).select(cross_section.average_rank(F.col("x")).alias("r"))
    assert sorted(r["r"] for r in ranks.collect()) == [0, 1.5, 1.5, 3]


def test_pool():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(6, 6))
    m = a @ a.T / 6 + np.eye(6)
    m /= np.sqrt(np.outer(np.diag(m), np.diag(m)))
    r = np.array([0.05, 0.04, 0.03, 0.02, 0.01, 0.06])
    assert np.allclose(pool.optimise(r, m, np.zeros(6), l1=0), np.linalg.solve(m, r))
    loss = lambda w: w @ m @ w - 2 * w @ r + 5e-3 * np.abs(w).sum()
    assert loss(pool.optimise(r, m, r.copy(), rate=1e-3)) <= loss(r) + 1e-9
    p = pool.Pool(3, ic_lower=0.015, max_mutual=0.9)
    for k in range(6):
        p.offer(f"e{k}", r[k], m[k, [int(n[1:]) for n in p.names]])
    assert len(p.names) <= 3 and "e4" not in p.names and p.mutual.shape == (len(p.names),) * 2
    assert not p.offer("bad", float("nan"), np.zeros(len(p.names)))
    weak = pool.Pool(2, ic_lower=0.05)
    assert weak.offer("low", 0.01, []) and weak.weights.tolist() == [0.01]  # alone: not refitted
    assert weak.offer("next", 0.02, [0.3]) and weak.names == ["next"]  # a sole member under the bound is replaced
    assert not weak.offer_if_better("worse", 0.03, [0.2], lambda x: -len(x.names) - float(x.single.sum())) and weak.names == ["next"] and weak.failed == {"worse"}
    p.prune(1, "both")
    assert len(p.state()["exprs"]) == 1
    s = pool.linear_schedule(0.0, 1.0, 110, 10)
    assert [s(0), s(10), s(60), s(1000)] == [0, 0, 0.5, 1]


def test_asof_takes_the_last_before_or_at(spark):
    day = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    b = spark.createDataFrame([("a", day(k), float(k)) for k in range(5)] + [("b", day(1), 9.0)], "symbol string, t timestamp, close double")
    f = spark.createDataFrame([("a", day(1), 0.1), ("a", day(2, 30), 0.2), ("a", day(3), None)], "symbol string, t timestamp, rate double")
    back = {(r["symbol"], r["t"].hour): r["rate"] for r in bars.asof_backward(b, f, "rate").collect()}
    assert back == {("a", 0): None, ("a", 1): 0.1, ("a", 2): 0.1, ("a", 3): 0.2, ("a", 4): 0.2, ("b", 1): None}
    exact = {r["t"].hour: r["rate"] for r in bars.asof_exact(b, f, "rate").where("symbol = 'a'").collect()}
    assert exact == {0: None, 1: 0.1, 2: 0.1, 3: 0.1, 4: 0.1}


def test_pruning(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    rows = [(float(a), float(2 * a + 1), float(b), 1.0, float(b) if k < 60 else None) for k, (a, b) in enumerate(zip(x, rng.normal(size=300), strict=True))]
    df = spark.createDataFrame(rows, "b double, a double, c double, flat double, thin double")
    out = {r["feature"]: r["reason"] for r in hygiene.prune_greedy(df, ["b", "a", "c", "flat", "thin"])}
    assert out == {"a": "", "b": "correlated", "c": "", "flat": "constant", "thin": "coverage"}
    old = {r["feature"]: r["kept"] for r in hygiene.prune_pairwise(df, ["b", "a", "c"])}
    assert old == {"b": True, "a": False, "c": True}


def test_feature_ids(spark):
    ids = surrogate.feature_ids(F.lit("Mean(Add($close,$open),10)"), 512)
    names = ["len:3", "ops_cnt:2", "feats_cnt:2", "op:Mean", "op:Add", "feat:close", "feat:open", "int:10", *(f"x:{o}|{c}" for o in ("Mean", "Add") for c in ("close", "open"))]
    assert spark.range(1).select(ids.alias("i")).first()["i"] == sorted({zlib.crc32(n.encode()) % 512 for n in names})
    w, b = surrogate.train([[1, 2], [2, 3], [1, 3]] * 30, np.array([1.0, 0.0, 0.5] * 30), 8, epochs=30)
    assert w[1] + w[2] + b > w[2] + w[3] + b


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("agg_id,price,quantity,first_id,last_id,transact_time,is_buyer_maker\n1,10.5,2,1,1,1704067200000,true\n2,x,2,1,1,1704067200000,true\n3,11,1,1,1,2024-01-01 00:00:05,False\n")
    got = files.trades(files.read_csv(spark, str(tmp_path / "t.csv"), files.TRADE_COLUMNS)).orderBy("ts").collect()
    assert [(r["price"], r["maker"]) for r in got] == [(10.5, True), (11.0, False)] and got[1]["ts"] == dt.datetime(2024, 1, 1, 0, 0, 5)
    with zipfile.ZipFile(tmp_path / "k.zip", "w") as z:
        z.writestr("k.csv", "1704067200000,1,2,0.5,1.5,10,1704067259999,15,3,5,7,0\n")
    k = files.klines(files.read_zip(spark, str(tmp_path), files.KLINE_COLUMNS), "last_").first()
    assert (k["t"], k["last_close"], k["last_volume"]) == (dt.datetime(2024, 1, 1), 1.5, 10.0)
    (tmp_path / "f.json").write_text(json.dumps({"factors": ["$close"], "weights": [0.5]}))
    (tmp_path / "f.csv").write_text("exprs,weight\n$close,0.5\nensemble,1\n")
    assert files.read_factors(str(tmp_path / "f.json")) == files.read_factors(str(tmp_path / "f.csv")) == [("$close", 0.5)]
    (tmp_path / "w.json").write_text('{"a": true}')
    with pytest.raises(ValueError):
        files.read_weights(str(tmp_path / "w.json"))
    (tmp_path / "trials.jsonl").write_text('{"expr": "$x", "ic": 0.1}\nbroken\n')
    assert files.read_trials(spark, str(tmp_path / "trials.jsonl"), "expr string, ic double").collect()[0]["ic"] == 0.1
    assert panel.sanitize(["a-b", "1x", "A_B", "é"]) == ["A_B", "F_1X", "A_B_2", "_"]


def test_float32_store_layout(spark):
    days = [dt.datetime(2024, 1, 1 + k) for k in range(4)]
    p = spark.createDataFrame([(days[1], "a", 1.5), (days[3], "a", 2.5)], "t timestamp, symbol string, close double")
    row = files.to_float32_store(p, spark.createDataFrame([(d,) for d in days], "t timestamp"), ["close"]).first()
    values = struct.unpack("<4f", row["data"])
    assert row["start"] == 1 and values[:2] == (1.0, 1.5) and math.isnan(values[2]) and values[3] == 2.5
