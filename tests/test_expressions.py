"""Every operator against a NumPy calculation written from its definition."""

import datetime as dt

import numpy as np
import pytest

from quantloom.functions import expression as ex
from quantloom.functions.parser import Builder, action_mask, from_rpn, library, parse, to_rpn
from quantloom.plans.compiler import between, evaluate, stages

T, S, W = 40, 5, 7
DAYS = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=k) for k in range(T)]


def data(seed=0):
    rng = np.random.default_rng(seed)
    x, y = np.round(rng.normal(size=(T, S)), 1), np.round(rng.normal(size=(T, S)), 1)
    x[rng.random((T, S)) < 0.05] = np.nan
    x[:, 1] = 2.0  # constant
    x[5] = np.nan  # no symbol
    x[8, 2:] = np.nan
    y[rng.random((T, S)) < 0.05] = np.nan
    return x, y


def windows(f, *arrays, w=W):
    out = np.full((T, S), np.nan)
    for t in range(w - 1, T):
        for s in range(S):
            part = [a[t - w + 1 : t + 1, s] for a in arrays]
            if not any(np.isnan(p).any() for p in part):
                out[t, s] = f(*part)
    return out


def moments(p, k):
    return ((p - p.mean()) ** k).mean()


def corr(a, b):
    a, b = a - a.mean(), b - b.mean()
    sa, sb = (a * a).sum(), (b * b).sum()
    return (a * b).sum() / (1 if sa < 1e-6 or sb < 1e-6 else np.sqrt(sa * sb))


def rank(p):
    above, least = (p > p[-1]).sum(), (p >= p[-1]).sum()
    return (above + least + (least > above)) / (2 * len(p))


def ema(p):
    a = 1 - 2 / (1 + len(p))
    k = a ** np.arange(len(p), 0, -1)
    return (k * p).sum() / k.sum()


def cs_rank(x):
    out = np.full((T, S), np.nan)
    for t in range(T):
        ok = np.flatnonzero(~np.isnan(x[t]))
        for k, s in enumerate(sorted(ok, key=lambda s: (x[t, s], s))):
            out[t, s] = k / len(ok)
    return out


def cs_zscore(x):
    with np.errstate(all="ignore"):
        import warnings

        warnings.simplefilter("ignore")
        sd = np.nanstd(x, axis=1, keepdims=True)
        return (x - np.nanmean(x, axis=1, keepdims=True)) / np.where(sd > 1e-6, sd, 1)


def shift(x, k):
    out = np.full((T, S), np.nan)
    if k >= 0:
        out[k:] = x[: T - k]
    else:
        out[:k] = x[-k:]
    return out


def clean(x):
    return np.where(np.isfinite(x), x, np.nan)


REFERENCE = {
    "Abs($x)": lambda x, y: np.abs(x),
    "Sign($x)": lambda x, y: np.sign(x),
    "Log($x)": lambda x, y: np.where(x > 0, np.log(np.where(x > 0, x, 1)), np.nan),
    "Add($x,$y)": lambda x, y: x + y,
    "Sub($x,1.5)": lambda x, y: x - 1.5,
    "Mul($x,$y)": lambda x, y: x * y,
    "Div($x,$y)": lambda x, y: clean(np.divide(x, y)),
    "Pow($x,$y)": lambda x, y: clean(np.power(x, y)),
    "Greater($x,$y)": np.maximum,
    "Less($x,$y)": np.minimum,
    "Ref($x,3)": lambda x, y: shift(x, 3),
    "Ref($x,-2)": lambda x, y: shift(x, -2),
    "Delta($x,4)": lambda x, y: x - shift(x, 4),
    f"Mean($x,{W})": lambda x, y: windows(np.mean, x),
    f"Sum($x,{W})": lambda x, y: windows(np.sum, x),
    f"Std($x,{W})": lambda x, y: windows(lambda p: p.std(ddof=1), x),
    f"Var($x,{W})": lambda x, y: windows(lambda p: p.var(ddof=1), x),
    f"Skew($y,{W})": lambda x, y: windows(lambda p: moments(p, 3) / moments(p, 2) ** 1.5, y),
    f"Kurt($y,{W})": lambda x, y: windows(lambda p: moments(p, 4) / p.var(ddof=1) ** 2 - 3, y),
    f"Max($x,{W})": lambda x, y: windows(np.max, x),
    f"Min($x,{W})": lambda x, y: windows(np.min, x),
    f"Med($x,{W})": lambda x, y: windows(lambda p: np.sort(p)[(W - 1) // 2], x),
    "Med($x,6)": lambda x, y: windows(lambda p: np.sort(p)[2], x, w=6),
    f"Mad($x,{W})": lambda x, y: windows(lambda p: np.abs(p - p.mean()).mean(), x),
    f"Rank($x,{W})": lambda x, y: windows(rank, x),
    f"WMA($x,{W})": lambda x, y: windows(lambda p: (np.arange(W) * p).sum() / (W * (W - 1) / 2), x),
    "WMA($x,1)": lambda x, y: np.full((T, S), np.nan),
    f"EMA($x,{W})": lambda x, y: windows(ema, x),
    f"Cov($x,$y,{W})": lambda x, y: windows(lambda a, b: np.cov(a, b)[0, 1], x, y),
    f"Corr($x,$y,{W})": lambda x, y: windows(corr, x, y),
    "CSRank($x)": lambda x, y: cs_rank(x),
    "CSZScore($x)": lambda x, y: cs_zscore(x),
    "Mean(Ref($x,3),5)": lambda x, y: windows(np.mean, shift(x, 3), w=5),
    "Mean(CSRank(Mean($y,3)),5)": lambda x, y: windows(np.mean, cs_rank(windows(np.mean, y, w=3)), w=5),
    "Corr(Delta($y,1),CSZScore($y),5)": lambda x, y: windows(corr, y - shift(y, 1), cs_zscore(y), w=5),
}


@pytest.fixture(scope="module")
def panel(spark):
    x, y = data()
    rows = [(DAYS[t], s, None if np.isnan(x[t, s]) else float(x[t, s]), None if np.isnan(y[t, s]) else float(y[t, s])) for t in range(T) for s in range(S)]
    return spark.createDataFrame(rows, "t timestamp, symbol int, x double, y double").cache()


def collect(df, names):
    out = {n: np.full((T, S), np.nan) for n in names}
    for r in df.collect():
        for n in names:
            if r[n] is not None:
                out[n][DAYS.index(r["t"]), r["symbol"]] = r[n]
    return out


def test_operators(panel):
    with np.errstate(all="ignore"):
        names = {f"e{k}": text for k, text in enumerate(REFERENCE)}
        got = collect(evaluate(panel, {n: parse(t) for n, t in names.items()}), names)
        x, y = data()
        for n, text in names.items():
            np.testing.assert_allclose(got[n], REFERENCE[text](x, y), rtol=1e-9, atol=1e-9, err_msg=text)


def test_training_profile_divides_by_n(panel):
    got = collect(evaluate(panel, {"a": parse(f"Std($x,{W})")}, ddof=0), ["a"])["a"]
    np.testing.assert_allclose(got, windows(np.std, data()[0]), atol=1e-9)


def test_nothing_looks_ahead(spark, panel):
    from pyspark.sql import functions as F

    e = {"v": parse("EMA(CSRank(Corr($x,$y,5)),4)")}
    cut = DAYS[25]
    changed = panel.withColumn("x", F.when(F.col("t") > F.lit(cut), F.col("x") * -3 + 1).otherwise(F.col("x")))
    a, b = (collect(evaluate(p, e), ["v"])["v"][:26] for p in (panel, changed))
    np.testing.assert_array_equal(a, b)


def test_between_reads_a_margin_only(panel):
    e = {"v": parse("Mean(Ref($x,3),5)"), "y": parse("Ref($x,-2)")}
    whole = {(r["t"], r["symbol"]): (r["v"], r["y"]) for r in evaluate(panel, e).collect()}
    part = between(panel, panel.select("t").distinct(), e, DAYS[20], DAYS[30]).collect()
    assert len(part) == 11 * S and all(whole[r["t"], r["symbol"]] == (r["v"], r["y"]) for r in part)


def test_one_exchange_for_each_change_of_key(panel):
    def plan(*texts):
        df = evaluate(panel, {f"v{k}": parse(t) for k, t in enumerate(texts)})
        return df._jdf.queryExecution().sparkPlan().toString().count("Window"), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert plan("Mean($x,5)", "Std($x,7)", "Mean(Ref($x,3),5)")[1] == 1
    assert plan("Mean(CSRank(Mean($x,5)),5)")[1] == 3
    shared = parse("Div(Sub($x,Mean($x,5)),Mean($x,5))")
    assert [len(nodes) for _, nodes in stages([shared, parse("Mean($x,5)")])] == [1]


def test_user_operators(panel):
    from pyspark.sql import functions as F

    ex.register_operator("Range", "rolling", lambda x, f: f.agg(x, F.max(x)) - f.agg(x, F.min(x)))
    try:
        got = collect(evaluate(panel, {"v": parse("Range($x,4)")}), ["v"])["v"]
        np.testing.assert_allclose(got, windows(np.ptp, data()[0], w=4))
    finally:
        del ex.REGISTRY["Range"]


@pytest.mark.parametrize("text", [*REFERENCE, "Div(Mean($close, 5d), Max($high, 10))", "Mul($x,Constant(-0.5))"])
def test_text_and_tokens_round_trip(text):
    e = parse(text)
    assert parse(str(e)) == e and from_rpn(to_rpn(e)) == e


@pytest.mark.parametrize("text", ["", "$x $y", "Mean($x)", "Mean($x,$y)", "Mean(5,5)", "Foo($x)", "Add(1,2)", "Mean($x,0)", "Corr($x,3,5)", "Add($x,", "10d", "Abs($x))", "Add($x 1)", "Greater"])
def test_bad_text(text):
    with pytest.raises(ex.InvalidExpression):
        parse(text)


def test_names_and_profiles():
    with pytest.raises(ex.InvalidExpression):
        parse("Abs($z)", {"x"})
    with pytest.raises(ex.InvalidExpression):
        parse("CSRank($x)", profile="factor_file")
    assert len(ex.PROFILES["search"]()) == 22 and len(ex.PROFILES["factor_file"]()) == 23


def test_operators_of_python_build_the_same_tree():
    x, y = ex.Feature("x"), ex.Feature("y")
    assert str(-(x + 1) / y**2) == "Div(Sub(Constant(0.0),Add($x,Constant(1.0))),Pow($y,Constant(2.0)))"
    assert str(abs(2 - x)) == "Abs(Sub(Constant(2.0),$x))"


def test_reach_adds_up():
    assert ex.reach(parse("Mean(Ref($x,3),5)")) == (7, 0)
    assert ex.reach(parse("Add(Ref($x,-2),Delta($x,4))")) == (4, 2)
    assert ex.within(parse("Mean($x,5)"), 4, 0) and not ex.within(parse("Mean($x,5)"), 3, 0)
    assert ex.features(parse("Corr($x,Add($y,$x),5)")) == {"x", "y"}


def test_masks_leave_only_what_can_be_finished():
    vocabulary = ["$x", "5d", "0.5", "Abs", "Add", "Mean", "Corr"]
    rng = np.random.default_rng(3)
    for _ in range(100):
        tokens = []
        while True:
            mask = action_mask(tokens, vocabulary, max_tokens=9)
            assert any(mask), tokens
            k = int(rng.choice(np.flatnonzero(mask)))
            if k == len(vocabulary):
                break
            tokens.append(vocabulary[k])
        assert from_rpn(tokens).featured and len(tokens) <= 9
    assert not Builder().allows("Abs")


def test_library_is_fixed_and_within_budget():
    assert [*map(str, library(["x", "y"], budget=10))] == [*map(str, library(["x", "y"], budget=10))]
    assert len(library(["x", "y"], budget=10)) == 10 and len(set(library(["x", "y", "z"]))) == len(library(["x", "y", "z"]))
