"""Queries of the expression language: one for each operator, and nested ones."""

from __future__ import annotations

from quantloom.functions.parser import from_rpn, parse
from quantloom.plans.compiler import evaluate
from quantloom.queries.base import DAILY, FIELDS, WEEKLY, T, daily, query, r, show, weekly

_W = "window w as (partition by symbol order by t), w5 as (w rows between 4 preceding and current row), w10 as (w rows between 9 preceding and current row)".replace("(w rows", "(partition by symbol order by t rows")


def _sql(formula: str, digits: int = 4, panel: str = WEEKLY, inner: str = "panel") -> str:
    return f"{panel} select {T}, symbol, {r(formula, digits)} from {inner} {_W}"


def _full(formula: str, x: str = "close", n: int = 10) -> str:
    return f"case when count({x}) over w{n} = {n} then {formula} end"


def _list(body: str) -> str:
    """A formula over the frame's values l, their mean m."""
    return _full(f"list_transform([{{'l': list(close) over w10, 'm': avg(close) over w10, 'x': close}}], lambda f: {body})[1]")


_EXPONENTS = [(1 - 2 / 11) ** k for k in range(10, 0, -1)]
_EMA = [e / sum(_EXPONENTS) for e in _EXPONENTS]
_CENTRED = "list_avg(list_transform(f.l, lambda v: power(v - f.m, {p})))"
_PAIR = "10 * (covar_pop(close, volume) over w10)"
_SX, _SY = "10 * (var_pop(close) over w10)", "10 * (var_pop(volume) over w10)"

#: name: (expression, SQL formula, digits)
OPERATORS = {
    "expr_abs": ("Abs(Sub($open,$close))", "abs(open - close)", 4),
    "expr_sign": ("Sign(Sub($close,$open))", "sign(close - open) * 1.0", 4),
    "expr_log": ("Log($close)", "case when close > 0 then ln(close) end", 6),
    "expr_add": ("Add($close,$open)", "close + open", 4),
    "expr_sub": ("Sub($high,$low)", "high - low", 4),
    "expr_mul": ("Mul($close,Constant(0.5))", "close * 0.5", 4),
    "expr_div": ("Div($close,Sub($close,$open))", "close / nullif(close - open, 0)", 4),
    "expr_pow": ("Pow($close,Constant(0.5))", "power(close, 0.5)", 6),
    "expr_greater": ("Greater($close,$open)", "case when close is not null and open is not null then greatest(close, open) end", 4),
    "expr_less": ("Less($close,$open)", "case when close is not null and open is not null then least(close, open) end", 4),
    "expr_ref": ("Ref($close,3)", "lag(close, 3) over w", 4),
    "expr_ref_fwd": ("Ref($close,-2)", "lead(close, 2) over w", 4),
    "expr_mean": ("Mean($close,10)", _full("avg(close) over w10"), 4),
    "expr_sum": ("Sum($close,10)", _full("sum(close) over w10"), 4),
    "expr_std": ("Std($close,10)", _full("stddev_samp(close) over w10"), 4),
    "expr_std_pop": ("Std($close,10)", _full("stddev_pop(close) over w10"), 4),
    "expr_var": ("Var($close,10)", _full("var_samp(close) over w10"), 2),
    "expr_skew": ("Skew($close,10)", _list(f"{_CENTRED.format(p=3)} / nullif(power({_CENTRED.format(p=2)}, 1.5), 0)"), 6),
    "expr_kurt": ("Kurt($close,10)", _list(f"{_CENTRED.format(p=4)} / nullif(power({_CENTRED.format(p=2)} * 10 / 9.0, 2), 0) - 3"), 6),
    "expr_max": ("Max($close,10)", _full("max(close) over w10"), 4),
    "expr_min": ("Min($close,10)", _full("min(close) over w10"), 4),
    "expr_med": ("Med($close,10)", _full("quantile_disc(close, 0.5) over w10"), 4),
    "expr_mad": ("Mad($close,10)", _list("list_avg(list_transform(f.l, lambda v: abs(v - f.m)))"), 4),
    "expr_rank": ("Rank($close,10)", _list("(len(list_filter(f.l, lambda v: v > f.x)) + len(list_filter(f.l, lambda v: v >= f.x)) + case when len(list_filter(f.l, lambda v: v >= f.x)) > len(list_filter(f.l, lambda v: v > f.x)) then 1 else 0 end) / 20.0"), 6),
    "expr_delta": ("Delta($close,4)", "close - lag(close, 4) over w", 4),
    "expr_wma": ("WMA($close,10)", _list("list_sum(list_transform(f.l, lambda v, i: v * (i - 1))) / 45.0"), 4),
    "expr_ema": ("EMA($close,10)", _list(f"list_sum(list_transform(list_zip(f.l, {_EMA}), lambda p: p[1] * p[2]))"), 4),
    "expr_cov": ("Cov($close,$volume,10)", _full("covar_samp(close, volume) over w10"), 2),
    "expr_corr": ("Corr($close,$volume,10)", _full(f"({_PAIR}) / case when {_SX} < 1e-6 or {_SY} < 1e-6 then 1 else sqrt(({_SX}) * ({_SY})) end"), 6),
}


def _register(name: str, text: str, formula: str, digits: int) -> None:
    ddof = 0 if name.endswith("_pop") else 1

    @query(name, _sql(formula, digits))
    def run(spark, sf_dir):
        return show(evaluate(weekly(spark, sf_dir), {"value": parse(text, set(FIELDS))}, ddof), digits, value="value")


for _name, (_text, _formula, _digits) in OPERATORS.items():
    _register(_name, _text, _formula, _digits)


def _daily(text: str):
    return lambda spark, sf_dir: show(evaluate(daily(spark, sf_dir), {"value": parse(text)}), 6, value="value")


query("cs_rank", f"{DAILY} select {T}, symbol, {r('case when close is not null then (row_number() over (partition by t order by close asc nulls last, symbol) - 1) * 1.0 / count(close) over (partition by t) end')} from panel")(_daily("CSRank($close)"))
_STD = "stddev_pop(close) over (partition by t)"
query("cs_zscore", f"{DAILY} select {T}, symbol, {r(f'(close - avg(close) over (partition by t)) / case when {_STD} > 1e-6 then {_STD} else 1 end')} from panel")(_daily("CSZScore($close)"))


@query("expr_nested_ts", _sql(f"case when count(x) over w5 = 5 then avg(x) over w5 end", 4, inner="(select *, lag(close, 3) over (partition by symbol order by t) as x from panel)"))
def nested(spark, sf_dir):
    return show(evaluate(weekly(spark, sf_dir), {"value": parse("Mean(Ref($close,3),5)")}), 4, value="value")


_CS = """(select *, case when m is not null then (row_number() over (partition by t order by m asc nulls last, symbol) - 1) * 1.0 / count(m) over (partition by t) end as x
from (select *, case when count(close) over (partition by symbol order by t rows between 4 preceding and current row) = 5 then avg(close) over (partition by symbol order by t rows between 4 preceding and current row) end as m from panel))"""


@query("expr_ts_cs_ts", _sql("case when count(x) over w5 = 5 then avg(x) over w5 end", 6, inner=_CS))
def ts_cs_ts(spark, sf_dir):
    return show(evaluate(weekly(spark, sf_dir), {"value": parse("Mean(CSRank(Mean($close,5)),5)")}), 6, value="value")


@query("expr_rpn_equiv", _sql(f"({_full('avg(close) over w5', n=5)}) - close"))
def rpn(spark, sf_dir):
    return show(evaluate(weekly(spark, sf_dir), {"value": from_rpn(["$close", "5d", "Mean", "$close", "Sub"])}), 4, value="value")


@query("expr_parse_roundtrip", _sql(f"({_full('avg(close) over w5', n=5)}) / nullif({_full('max(high) over w10', 'high')}, 0)", 6))
def roundtrip(spark, sf_dir):
    e = parse(str(parse("Div(Mean($close, 5d), Max($high, 10))")))
    return show(evaluate(weekly(spark, sf_dir), {"value": e}), 6, value="value")


@query("expr_shared", f"{WEEKLY} select {T}, symbol, {r(_full('avg(close) over w10'), 4, 'a')}, {r('close - ' + _full('avg(close) over w10'), 4, 'b')}, {r('(close - ' + _full('avg(close) over w10') + ') / nullif(' + _full('stddev_samp(close) over w10') + ', 0)', 6, 'c')} from panel {_W}")
def shared(spark, sf_dir):
    """Three expressions over one shared subtree, planned together."""
    texts = {"a": "Mean($close,10)", "b": "Sub($close,Mean($close,10))", "c": "Div(Sub($close,Mean($close,10)),Std($close,10))"}
    df = evaluate(weekly(spark, sf_dir), {k: parse(v) for k, v in texts.items()})
    from quantloom.queries.base import rounded, stamp

    return df.select(stamp(), "symbol", rounded("a", 4).alias("a"), rounded("b", 4).alias("b"), rounded("c", 6).alias("c"))
