"""Queries of panels, information coefficients, bars, cleaning, indicators, hygiene and backtests."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from quantloom.functions.parser import parse
from quantloom.operators import backtest, bars, cleaning, cross_section, hygiene, indicators, panel
from quantloom.operators.windows import history
from quantloom.plans import backtest_files
from quantloom.plans.compiler import evaluate
from quantloom.queries.base import DAILY, FIELDS, HOURLY, TICKS, WEEKLY, WEEKLY_BARS, T, bars_sql, daily, event_bars, hourly, query, r, read, rounded, shared_folder, show, ticks, weekly, weekly_bars
from quantloom.sources import files

# --- cross-section

query("cs_zscore_strict", f"{DAILY} select {T}, symbol, {r('(close - avg(close) over (partition by t)) / nullif(stddev_pop(close) over (partition by t), 0)')} from panel")(lambda s, d: show(daily(s, d).withColumn("value", cross_section.zscore(F.col("close"), "strict")), value="value"))
query("cs_normalize_zero", f"{DAILY} select {T}, symbol, {r('coalesce((close - avg(close) over (partition by t)) / case when stddev_pop(close) over (partition by t) > 0 then stddev_pop(close) over (partition by t) else 1 end, 0)')} from panel")(lambda s, d: show(daily(s, d).withColumn("value", cross_section.zscore(F.col("close"), "zero")), value="value"))

# --- factors and targets on the weekly panel

FACTORS = {"f1": "Sub(Mean($close,5),$close)", "f2": "Div($close,Ref($close,4))", "f3": "Div($volume,Mean($volume,10))"}
TARGET = {"y": "Sub(Div(Ref($close,-1),$close),Constant(1))"}


def factors(spark, sf_dir, names=("f1", "f2", "f3"), keep=()):
    """t, symbol, factors, y: all in one plan."""
    return evaluate(weekly(spark, sf_dir), {n: parse(FACTORS[n]) for n in names} | {"y": parse(TARGET["y"])}, keep=keep)


_P = "partition by symbol order by t"
_ROLL = lambda x, n: f"case when count({x}) over ({_P} rows between {n - 1} preceding and current row) = {n} then avg({x}) over ({_P} rows between {n - 1} preceding and current row) end"
FACTOR_SQL = f"""{WEEKLY}, fac as (
  select t, symbol, close, ({_ROLL('close', 5)}) - close as f1, close / nullif(lag(close, 4) over ({_P}), 0) as f2,
    volume / nullif({_ROLL('volume', 10)}, 0) as f3, lead(close, 1) over ({_P}) / nullif(close, 0) - 1 as y from panel)"""


def _ic_sql(x: str, y: str) -> str:
    a, b = (f"case when {x} is not null and {y} is not null then {c} end" for c in (x, y))
    return f"covar_pop({a}, {b}) / case when stddev_pop({a}) < 1e-3 or stddev_pop({b}) < 1e-3 then 1 else stddev_pop({a}) * stddev_pop({b}) end"


_DAY = f"{FACTOR_SQL}, day as (select t, count(case when f1 is not null and y is not null then 1 end) as n, {_ic_sql('f1', 'y')} as ic from fac group by t)"
_RANKS = """, pairs as (select t, case when f1 is not null and y is not null then f1 end as a, case when f1 is not null and y is not null then y end as b from fac),
ranked as (select t, case when a is not null then rank() over (partition by t order by a asc nulls last) - 1 + (count(a) over (partition by t, a) - 1) / 2.0 end as a,
  case when b is not null then rank() over (partition by t order by b asc nulls last) - 1 + (count(b) over (partition by t, b) - 1) / 2.0 end as b from pairs)"""
_RANK_DAY = f"{FACTOR_SQL}{_RANKS}, day as (select t, count(a) as n, {_ic_sql('a', 'b')} as ic from ranked group by t)"

query("ic_daily", f"{_DAY} select {T}, n, {r('ic', 6, 'ic')} from day")(lambda s, d: show(cross_section.ic_daily(factors(s, d, ("f1",)), "f1", "y"), keys=("t", "n"), ic="ic"))
query("ic_mean", f"{_DAY} select {r('avg(ic)', 6, 'mean_ic')} from day")(lambda s, d: show(cross_section.ic_mean(cross_section.ic_daily(factors(s, d, ("f1",)), "f1", "y")), keys=(), mean_ic="mean_ic"))


@query("ic_mean_strict", f"{_DAY} select 'all' as bars, {r('case when count(ic) = count(*) then avg(ic) end', 6, 'mean_ic')} from day union all select 'with pairs', {r('case when count(ic) = count(*) then avg(ic) end', 6, 'mean_ic')} from day where n > 0")
def ic_mean_strict(spark, sf_dir):
    """NULL over all bars, as the first and last have no pairs; a number over those that have."""
    days = cross_section.ic_daily(factors(spark, sf_dir, ("f1",)), "f1", "y")
    means = [cross_section.ic_mean(own, True).withColumn("bars", F.lit(name)) for name, own in (("all", days), ("with pairs", days.where("n > 0")))]
    return show(means[0].unionByName(means[1]), keys=("bars",), mean_ic="mean_ic")


query("rank_ic_daily", f"{_RANK_DAY} select {T}, n, {r('ic', 6, 'ic')} from day")(lambda s, d: show(cross_section.rank_ic_daily(factors(s, d, ("f1",)), "f1", "y"), keys=("t", "n"), ic="ic"))
query("rank_ic_mean", f"{_RANK_DAY} select {r('avg(ic)', 6, 'mean_ic')} from day")(lambda s, d: show(cross_section.ic_mean(cross_section.rank_ic_daily(factors(s, d, ("f1",)), "f1", "y")), keys=(), mean_ic="mean_ic"))
query("icir", f"{_DAY} select {r('avg(ic)', 6, 'mean_ic')}, {r('stddev_samp(ic)', 6, 'ic_std')}, {r('avg(ic) / nullif(stddev_samp(ic), 0)', 6, 'icir')} from day")(lambda s, d: show(cross_section.icir(cross_section.ic_daily(factors(s, d, ("f1",)), "f1", "y")), keys=(), mean_ic="mean_ic", ic_std="ic_std", icir="icir"))
query("ic_objective_lcb", f"{_DAY} select {r('avg(ic) - 0.5 * stddev_samp(ic)', 6, 'objective')} from day")(lambda s, d: show(cross_section.mean_std(cross_section.ic_daily(factors(s, d, ("f1",)), "f1", "y"), 0.5), keys=(), objective="objective"))
query("ic_screen", f"""{FACTOR_SQL}, long as (select t, feature, x, y from (select t, y, f1, f2, f3 from fac) unpivot (x for feature in (f1, f2, f3)) where y is not null),
day as (select feature, t, covar_pop(x, y) as c, stddev_pop(x) as sx, stddev_pop(y) as sy, count(*) as n from long where x is not null group by 1, 2)
select feature, {r('avg(c / (sx * sy))', 6, 'ic')} from day where n >= 2 and sx > 0 and sy > 0 group by feature""")(lambda s, d: show(cross_section.ic_screen(factors(s, d), ["f1", "f2", "f3"], "y"), keys=("feature",), ic="ic"))
_MUTUAL = " union all ".join(f"select '{a}' as a, '{b}' as b, avg(p{a}{b}) as ic from day" for a, b in combinations(("f1", "f2", "f3"), 2))
query("mutual_ic_matrix", f"{FACTOR_SQL}, day as (select t, {', '.join(f'{_ic_sql(a, b)} as p{a}{b}' for a, b in combinations(('f1', 'f2', 'f3'), 2))} from fac group by t) select a, b, {r('ic', 6, 'ic')} from ({_MUTUAL})")(lambda s, d: show(cross_section.mutual_ic(factors(s, d), ["f1", "f2", "f3"]), keys=("a", "b"), ic="ic"))
WEIGHTS = {"f1": 0.5, "f2": -0.3, "f3": 0.2}
_Z = lambda c: f"({c} - avg({c}) over (partition by t)) / case when stddev_pop({c}) over (partition by t) > 0 then stddev_pop({c}) over (partition by t) else 1 end"
_ENSEMBLE = f"case when coalesce(f1, f2, f3) is not null then {' + '.join(f'coalesce({w} * {_Z(c)}, 0)' for c, w in WEIGHTS.items())} end"
query("ensemble_score", f"{FACTOR_SQL} select {T}, symbol, {r(_ENSEMBLE)} from fac")(lambda s, d: show(factors(s, d).withColumn("value", cross_section.ensemble(WEIGHTS)), value="value"))
query("ensemble_turnover", f"{FACTOR_SQL}, s as (select t, symbol, {_ENSEMBLE} as v from fac), m as (select abs(v - lag(v) over ({_P})) as d from s) select {r('avg(d)', 6, 'turnover')} from m")(lambda s, d: show(cross_section.turnover(factors(s, d).withColumn("v", cross_section.ensemble(WEIGHTS)), "v"), keys=(), turnover="turnover"))
_POOLED = f"{FACTOR_SQL}, s as (select t, {_ENSEMBLE} as f1, y from fac)"
_POOL_IC = f"{_POOLED}, day as (select t, {_ic_sql('f1', 'y')} as ic from s group by t) select avg(ic) as ic from day"
_POOL_RANK = f"{_POOLED}{_RANKS.replace('from fac', 'from s')}, day as (select t, {_ic_sql('a', 'b')} as ic from ranked group by t) select avg(ic) as rank_ic from day"
query("pool_ic", f"select {r('ic', 6, 'ic')}, {r('rank_ic', 6, 'rank_ic')} from ({_POOL_IC}), ({_POOL_RANK})")(lambda s, d: show(cross_section.pool_ic(factors(s, d), WEIGHTS, "y"), keys=(), ic="ic", rank_ic="rank_ic"))
_PLAIN = " + ".join(f"coalesce({w} * {_Z(c)}, 0)" for c, w in WEIGHTS.items())
query("ensemble_plain", f"{FACTOR_SQL} select {T}, symbol, {r(_PLAIN, 2)} from fac")(lambda s, d: show(factors(s, d).withColumn("value", cross_section.ensemble(WEIGHTS, missing="zero")), 2, value="value"))
# greedy choices as recursive queries: one column, or one pair of columns, a step
_IC3 = f"""ic as (select feature, avg(c / (sx * sy)) as ic from (select feature, t, covar_pop(x, y) as c, stddev_pop(x) as sx, stddev_pop(y) as sy, count(*) as n
  from (select t, feature, x, y from (select t, y, f1, f2, f3 from fac) unpivot (x for feature in (f1, f2, f3)) where y is not null) where x is not null group by 1, 2) where n >= 2 and sx > 0 and sy > 0 group by feature),
day as (select t, {', '.join(f'{_ic_sql(a, b)} as p{a}{b}' for a, b in combinations(('f1', 'f2', 'f3'), 2))} from fac group by t),
two as (select a, b, abs(ic) as ic from ({_MUTUAL}) union all select b, a, abs(ic) from ({_MUTUAL})),
ranked as (select feature, row_number() over (order by abs(ic) desc, feature) as i from ic)"""


@query(
    "topk_feature_screen",
    f"""{FACTOR_SQL.replace('with ', 'with recursive ', 1)}, {_IC3},
walk as (select cast(0 as bigint) as i, cast([] as varchar[]) as chosen
  union all select k.i, case when len(chosen) < 2 and not exists (select 1 from two where two.a = k.feature and list_contains(chosen, two.b) and two.ic >= 0.9) then list_append(chosen, k.feature) else chosen end
  from walk join ranked k on k.i = walk.i + 1)
select cast(unnest(range(len(chosen))) as bigint) as k, unnest(chosen) as feature from walk where i = (select max(i) from walk)""",
)
def topk(spark, sf_dir):
    chosen = cross_section.top_features(factors(spark, sf_dir), ["f1", "f2", "f3"], "y", 2, 0.9)
    return spark.createDataFrame([*enumerate(chosen)], "k long, feature string")


# --- panels

query("calendar_coverage", f"{HOURLY}, c as (select t, count(*) as n_symbols from bars group by t) select {T}, n_symbols from c where n_symbols >= greatest(1, (select count(distinct symbol) from bars) // 2)")(lambda s, d: show(panel.calendar(hourly(s, d)), keys=("t", "n_symbols")))
_DENSE = f"{HOURLY}, cal as (select t from bars group by t having count(*) >= greatest(1, (select count(distinct symbol) from bars) // 2)), cells as (select t, symbol from cal, (select distinct symbol from bars) as s), raw as (select * from cells left join bars using (t, symbol))"
_LAST = f"last_value({{0}} ignore nulls) over ({_P} rows between unbounded preceding and current row)"
query("densify_ffill", f"{_DENSE} select {T}, symbol, {r(_LAST.format('close'), 6, 'close')}, {r(_LAST.format('volume'), 6, 'volume')} from raw")(lambda s, d: show(panel.densify(hourly(s, d), panel.calendar(hourly(s, d))), close="close", volume="volume"))
query("ffill_limit", f"{_DENSE} select {T}, symbol, {r('case when count(close) over (' + _P + ' rows between 2 preceding and current row) > 0 then ' + _LAST.format('close') + ' end')} from raw")(lambda s, d: show(panel.densify(hourly(s, d), panel.calendar(hourly(s, d)), []).withColumn("value", panel.forward_fill(F.col("close"), 2)), value="value"))
query("fill_both", f"{_DENSE} select {T}, symbol, {r('coalesce(' + _LAST.format('close') + ', first_value(close ignore nulls) over (' + _P + ' rows between current row and unbounded following))')} from raw")(lambda s, d: show(panel.densify(hourly(s, d), panel.calendar(hourly(s, d)), []).withColumn("value", panel.fill_both(F.col("close"))), value="value"))
query("factor_gating", f"{_DENSE} select {T}, symbol, {r('case when avg(case when close is not null then 1.0 else 0 end) over (partition by t) >= 0.8 then close end', 6, 'close')} from raw")(lambda s, d: show(panel.gate(panel.densify(hourly(s, d), panel.calendar(hourly(s, d)), []), ["close"], 0.8), close="close"))
query("forward_labels", f"{WEEKLY} select {T}, symbol, {', '.join(r(f'ln(lead(close, {h}) over ({_P}) / close)', 6, f'y_logret_fwd_{h}h') + ', ' + r(f'lead(close, {h}) over ({_P}) / close - 1', 6, f'y_ret_fwd_{h}h') for h in (1, 4))} from panel")(lambda s, d: show(panel.labels(weekly(s, d), [1, 4]), **{f"y_{k}_fwd_{h}h": f"y_{k}_fwd_{h}h" for k in ("logret", "ret") for h in (1, 4)}))
query("temporal_split", f"{WEEKLY} select symbol, case when t < timestamp '1998-01-01' then 'train' when t < timestamp '2000-01-01' then 'val' else 'test' end as split, count(*) as n from panel group by 1, 2")(lambda s, d: panel.split(weekly(s, d), "1998-01-01", "2000-01-01").groupBy("symbol", "split").agg(F.count(F.lit(1)).alias("n")))
query("schema_union", f"{HOURLY} select symbol, {r('avg(close)', 6, 'close')}, {r('avg(volume)', 6, 'volume')}, count(*) as n from (select symbol, close, volume from bars union all select symbol, close, null from bars) group by symbol")(lambda s, d: show(panel.union_schema([hourly(s, d).select("symbol", "close", "volume"), hourly(s, d).select("symbol", "close")]).groupBy("symbol").agg(F.avg("close").alias("c"), F.avg("volume").alias("v"), F.count(F.lit(1)).alias("n")), keys=("symbol", "n"), close="c", volume="v"))
query("schema_intersection", f"{HOURLY} select symbol, {r('avg(close)', 6, 'close')}, count(*) as n from (select symbol, close from bars union all select symbol, close from bars) group by symbol")(lambda s, d: show(panel.intersect_schema([hourly(s, d).select("symbol", "close", "volume"), hourly(s, d).select("close", "symbol")]).groupBy("symbol").agg(F.avg("close").alias("c"), F.count(F.lit(1)).alias("n")), keys=("symbol", "n"), close="c"))
query("dataset_summary", f"with {WEEKLY_BARS} select symbol, count(*) as n_rows, strftime(cast(min(t) as timestamp), '%Y-%m-%d') as first_t, strftime(cast(max(t) as timestamp), '%Y-%m-%d') as last_t from bars group by symbol")(lambda s, d: panel.summary(weekly_bars(s, d)).select("symbol", "n_rows", F.date_format("first_t", "yyyy-MM-dd").alias("first_t"), F.date_format("last_t", "yyyy-MM-dd").alias("last_t")))
_CUT = "timestamp '2024-01-20'"
query("append_new", f"{HOURLY}, old as (select * from bars where t < {_CUT}) select symbol, count(*) as n, {r('sum(volume)', 6, 'volume')} from (select * from old union all select b.* from bars b join (select symbol, max(t) as m from old group by symbol) l using (symbol) where b.t > l.m) group by symbol")(lambda s, d: show(panel.append_new(hourly(s, d).where(F.col("t") < F.lit("2024-01-20").cast("timestamp")), hourly(s, d)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("v")), keys=("symbol", "n"), volume="v"))
query("drop_duplicates", "select o_custkey, max(o_orderkey) as o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as k from orders) where k = 1 group by 1")(lambda s, d: panel.drop_duplicates(read(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")]))

# --- bars

_BAR = ", ".join(r(c, 8, c) for c in FIELDS)
query("bars_ohlcv_vwap", f"with {bars_sql('minute')}, h as (select symbol, date_trunc('hour', t) as t, first(open order by t) as open, max(high) as high, min(low) as low, last(close order by t) as close, sum(volume) as volume, sum((high + low + close) / 3 * volume) / nullif(sum(volume), 0) as vwap from bars group by symbol, date_trunc('hour', t)) select {T}, symbol, {_BAR} from h")(lambda s, d: show(bars.hourly(event_bars(s, d, "minute")), 8, **{c: c for c in FIELDS}))
query("bars_streamed_vwap", f"with {bars_sql('minute')}, h as (select symbol, date_trunc('hour', t) as t, sum((high + low + close) / 3 * volume) / greatest(sum(volume), 1e-12) as vwap from bars group by symbol, date_trunc('hour', t)) select {T}, symbol, {r('vwap', 8, 'vwap')} from h")(lambda s, d: show(bars.hourly(event_bars(s, d, "minute"), 1e-12), 8, vwap="vwap"))
query("bars_micro", f"with {bars_sql('minute')}, m as (select *, close / nullif(lag(close) over ({_P}), 0) - 1 as ret from bars), h as (select symbol, date_trunc('hour', t) as t, last(close order by t) as close, sum((high + low + close) / 3 * volume) / nullif(sum(volume), 0) as vwap, stddev_samp(ret) * sqrt(60.0) as rv, stddev_samp(volume) / nullif(avg(volume), 0) as volume_cv from m group by symbol, date_trunc('hour', t)) select {T}, symbol, {r('vwap', 6, 'vwap')}, {r('close / nullif(vwap, 0) - 1', 6, 'vwap_dev')}, {r('rv', 6, 'rv')}, {r('volume_cv', 6, 'volume_cv')} from h")(lambda s, d: show(bars.hourly_micro(event_bars(s, d, "minute")), vwap="vwap", vwap_dev="vwap_dev", rv="rv", volume_cv="volume_cv"))


def funding(spark, sf_dir):
    """A sparse series: eight-hourly means of ticks, some minutes off the hour."""
    eight = F.timestamp_seconds(F.floor(F.col("ts").cast("double") / 28800) * 28800 + 420)
    return ticks(spark, sf_dir).groupBy("symbol", eight.alias("t")).agg(((F.avg("price") - 50) / 10000).alias("rate"))


_FUND = "fund as (select symbol, to_timestamp(floor(epoch(ts) / 28800) * 28800 + 420)::timestamp as t, (avg(price) - 50) / 10000 as rate from ticks group by 1, 2)"
query("asof_backward", f"{HOURLY}, {_FUND} select strftime(cast(b.t as timestamp), '%Y-%m-%d %H:%M:%S') as t, b.symbol, {r('f.rate', 8, 'rate')} from bars b asof left join fund f on b.symbol = f.symbol and b.t >= f.t")(lambda s, d: show(bars.asof_backward(hourly(s, d), funding(s, d), "rate"), 8, rate="rate"))
query("asof_exact_ffill", f"{HOURLY}, {_FUND}, f2 as (select symbol, t - interval 7 minute as t, rate from fund), j as (select b.t, b.symbol, f.rate from bars b left join f2 f on b.symbol = f.symbol and b.t = f.t) select {T}, symbol, {r(_LAST.format('rate'), 8, 'rate')} from j")(lambda s, d: show(bars.asof_exact(hourly(s, d), funding(s, d).withColumn("t", F.col("t") - F.expr("interval 7 minutes")), "rate"), 8, rate="rate"))
query("funding_grid_ffill", f"with {TICKS.format(symbol='event_type')}, {_FUND}, g as (select symbol, unnest(generate_series(date_trunc('hour', min(t)), timestamp '2024-01-31', interval 1 hour)) as t from fund group by symbol) select strftime(cast(g.t as timestamp), '%Y-%m-%d %H:%M:%S') as t, g.symbol, {r('f.rate', 8, 'rate')} from g asof left join fund f on g.symbol = f.symbol and g.t >= f.t")(lambda s, d: show(bars.funding_grid(funding(s, d), "2024-01-31"), 8, rate="rate"))
query("funding_features", f"{HOURLY}, {_FUND}, j as (select b.t as t, b.symbol, f.rate * 1095 as y from bars b asof left join fund f on b.symbol = f.symbol and b.t >= f.t) select {T}, symbol, {r('y', 6, 'annualised')}, {r(f'y - lag(y) over ({_P})', 6, 'annualised_diff')}, abs(y) > 0.30 as extreme from j")(lambda s, d: show(bars.funding_features(bars.asof_backward(hourly(s, d), funding(s, d), "rate")), keys=("t", "symbol", "extreme"), annualised="annualised", annualised_diff="annualised_diff"))

_SIDES = {"buy": "not maker", "sell": "maker"}
_MIN = "minutes as (select symbol, date_trunc('minute', ts) as t, count(*) as trade_count, sum(quantity) as base_volume, sum(q) as quote_volume, " + ", ".join(f"sum(case when {c} then quantity else 0 end) as taker_{n}_qty, sum(case when {c} then q else 0 end) as taker_{n}_quote, sum(case when {c} then q * q else 0 end) as taker_{n}_quote_sq, count(case when {c} then 1 end) as taker_{n}_trade_count, sum(case when {c} and q >= 2000 then q else 0 end) as whale_{n}_quote, sum(case when {c} and q <= 100 then q else 0 end) as retail_{n}_quote" for n, c in _SIDES.items()) + ", first(price order by ts, event_id) as price_first, last(price order by ts, event_id) as price_last, max(price) as price_high, min(price) as price_low from (select *, price * quantity as q from ticks) group by 1, 2)"
_MIN_COLS = ["base_volume", "quote_volume", *(f"taker_{n}_{k}" for n in _SIDES for k in ("qty", "quote", "quote_sq")), *(f"{w}_{n}_quote" for n in _SIDES for w in ("whale", "retail")), "price_first", "price_last", "price_high", "price_low"]
_minutes = lambda s, d: bars.minute_orderflow(ticks(s, d), ["event_id"], 2000.0, 100.0)
query("orderflow_1m", f"with {TICKS.format(symbol='event_type')}, {_MIN} select {T}, symbol, trade_count, taker_buy_trade_count, taker_sell_trade_count, {', '.join(r(c, 4, c) for c in _MIN_COLS)} from minutes")(lambda s, d: show(_minutes(s, d), 4, ("t", "symbol", "trade_count", "taker_buy_trade_count", "taker_sell_trade_count"), **{c: c for c in _MIN_COLS}))
_FLOW = ["base_volume", "quote_volume", "cvd", "whale_cvd", "retail_cvd", "tw_cvd", "vwap", "avg_buy", "avg_sell", "hhi", "imbalance", "price_change", "cvd_per_move"]


def _hour_flow(under: str) -> str:
    return f"""with {TICKS.format(symbol='event_type')}, {_MIN}, g as (
  select symbol, date_trunc('hour', t) as t, cast(sum(trade_count) as bigint) as trades, sum(base_volume) as base_volume, sum(quote_volume) as quote_volume,
    sum(taker_buy_quote - taker_sell_quote) as cvd, sum(whale_buy_quote - whale_sell_quote) as whale_cvd, sum(retail_buy_quote - retail_sell_quote) as retail_cvd,
    sum((minute(t) + 1) * (taker_buy_quote - taker_sell_quote)) / {under} as tw_cvd, sum(taker_buy_quote) as b, sum(taker_sell_quote) as s,
    sum(taker_buy_trade_count) as nb, sum(taker_sell_trade_count) as ns, sum(taker_buy_quote_sq + taker_sell_quote_sq) as sq,
    last(price_last order by t) - first(price_first order by t) as price_change from minutes group by symbol, date_trunc('hour', t)),
o as (select *, quote_volume / nullif(base_volume, 0) as vwap, b / nullif(nb, 0) as avg_buy, s / nullif(ns, 0) as avg_sell, sq / nullif(quote_volume * quote_volume, 0) as hhi,
  cvd / nullif(quote_volume, 0) as imbalance, cvd / nullif(abs(price_change), 0) as cvd_per_move from g)
select {T}, symbol, trades, {', '.join(r(c, 7, c) for c in _FLOW)} from o"""


for _mode, _under in (("fixed", "1830.0"), ("present", "sum(minute(t) + 1)")):
    query(f"orderflow_1h_{_mode}", _hour_flow(_under))(lambda s, d, m=_mode: show(bars.hourly_orderflow(_minutes(s, d), m), 7, ("t", "symbol", "trades"), **{c: c for c in _FLOW}))
query("metrics_last", f"with {TICKS.format(symbol='event_type')}, m as (select symbol, ts as t, event_id, case when maker then quantity end as oi from ticks) select strftime(date_trunc('hour', t), '%Y-%m-%d %H:%M:%S') as t, symbol, {r('arg_max(oi, t) filter (where oi is not null)', 6, 'oi')} from m group by symbol, date_trunc('hour', m.t)")(lambda s, d: show(bars.last_by_hour(ticks(s, d).select("symbol", F.col("ts").alias("t"), F.when(F.col("maker"), F.col("quantity")).alias("oi")), ["oi"]), oi="oi"))
_LIQ = ["long_qty", "long_notional", "short_qty", "short_notional"]
query("liquidation_sides", f"with {TICKS.format(symbol='event_type')}, l as (select distinct symbol, ts, case when maker then 'SELL' else 'BUY' end as side, quantity, price from ticks), h as (select symbol, date_trunc('hour', ts) as t, sum(case when side = 'SELL' then quantity else 0 end) as long_qty, sum(case when side = 'SELL' then price * quantity else 0 end) as long_notional, sum(case when side = 'BUY' then quantity else 0 end) as short_qty, sum(case when side = 'BUY' then price * quantity else 0 end) as short_notional, count(*) as n from l group by 1, 2) select {T}, symbol, n, {', '.join(r(c, 4, c) for c in _LIQ)} from h")(lambda s, d: show(bars.liquidations((o := ticks(s, d).select("symbol", F.col("ts").alias("t"), F.when(F.col("maker"), "SELL").otherwise("BUY").alias("side"), "quantity", "price")).unionByName(o)), 4, ("t", "symbol", "n"), **{c: c for c in _LIQ}))
query("liquidation_summary", f"with {TICKS.format(symbol='event_type')}, h as (select symbol, date_trunc('hour', ts) as t, sum(quantity) as liq_amount, avg(price) as liq_price, count(case when maker then 1 end) as liq_long_count from ticks group by 1, 2) select {T}, symbol, {r('liq_amount', 4, 'liq_amount')}, {r('liq_price', 4, 'liq_price')}, liq_long_count from h")(lambda s, d: show(bars.liquidation_summary(ticks(s, d).select("symbol", F.col("ts").alias("t"), F.when(F.col("maker"), "SELL").otherwise("BUY").alias("side"), "quantity", "price")), 4, ("t", "symbol", "liq_long_count"), liq_amount="liq_amount", liq_price="liq_price"))
query("taker_ratio", f"with {TICKS.format(symbol='event_type')}, h as (select symbol, date_trunc('hour', ts) as t, coalesce(sum(case when not maker then quantity else 0 end) / nullif(sum(quantity), 0), 0.5) as x from ticks group by 1, 2) select {T}, symbol, {r('x', 6, 'taker_ratio')} from h")(lambda s, d: show(bars.taker_ratio(ticks(s, d)), taker_ratio="taker_ratio"))
query("adjust_forward", f"{WEEKLY}, f as (select *, 1 + (symbol % 5) * 0.1 + case when t >= timestamp '1998-01-05' then 0.5 else 0 end as factor from panel) select {T}, symbol, {r(f'close * (factor / last_value(factor) over ({_P} rows between unbounded preceding and unbounded following))', 6, 'close')}, {r(f'volume / (factor / last_value(factor) over ({_P} rows between unbounded preceding and unbounded following))', 6, 'volume')} from f")(lambda s, d: show(bars.adjust_forward(weekly(s, d).withColumn("factor", 1 + (F.col("symbol") % 5) * 0.1 + F.when(F.col("t") >= "1998-01-05", 0.5).otherwise(0.0))), 6, close="close", volume="volume"))
_factored = lambda s, d: weekly(s, d).withColumn("factor", 1 + (F.col("symbol") % 5) * 0.1 + F.when(F.col("t") >= "1998-01-05", 0.5).otherwise(0.0))
_AS_OF = f"last_value(case when t <= timestamp '1997-06-02' then factor end ignore nulls) over ({_P} rows between unbounded preceding and unbounded following)"
query("adjust_as_of", f"{WEEKLY}, f as (select *, 1 + (symbol % 5) * 0.1 + case when t >= timestamp '1998-01-05' then 0.5 else 0 end as factor from panel) select {T}, symbol, {r(f'close * (factor / {_AS_OF})', 6, 'close')}, {r(f'volume / (factor / {_AS_OF})', 6, 'volume')} from f")(lambda s, d: show(bars.adjust_forward(_factored(s, d), as_of="1997-06-02"), 6, close="close", volume="volume"))

# --- cleaning

_GAPS = f"""{HOURLY}, g as (select *, coalesce(epoch(t) - epoch(lag(t) over ({_P})), 0) as gap_seconds from bars),
u as (select *, case when gap_seconds > 3605 then 1 else 0 end as under_maintenance from g),
c as (select *, coalesce(max(case when under_maintenance = 1 then t end) over ({_P} rows between unbounded preceding and current row) >= t - interval 2 hour, false) as cool from u)"""
query("gap_flags", f"{_GAPS} select {T}, symbol, {r('gap_seconds', 3, 'gap_seconds')}, under_maintenance from c")(lambda s, d: show(cleaning.gaps(hourly(s, d)), 3, ("t", "symbol", "under_maintenance"), gap_seconds="gap_seconds"))
query("cooldown_flags", f"{_GAPS} select {T}, symbol, case when cool then 1 else 0 end as cooldown_no_trade, case when not cool and under_maintenance = 0 then 1 else 0 end as trade_allowed from c")(lambda s, d: show(cleaning.gaps(hourly(s, d)), keys=("t", "symbol", "cooldown_no_trade", "trade_allowed")))
query("spike_flags", f"{HOURLY} select {T}, symbol, coalesce(abs(ln(close / lag(close) over ({_P}))) > 0.5, false) as is_spike from bars")(lambda s, d: show(hourly(s, d).withColumn("is_spike", cleaning.is_spike()), keys=("t", "symbol", "is_spike")))
_V = f"{_P} rows between 167 preceding and current row"
query("volume_spike", f"{HOURLY} select {T}, symbol, coalesce(case when count(volume) over ({_V}) >= 24 then (volume - avg(volume) over ({_V})) / (stddev_samp(volume) over ({_V}) + 1e-8) end > 2.0, false) as is_volume_spike from bars")(lambda s, d: show(hourly(s, d).withColumn("is_volume_spike", cleaning.is_volume_spike(limit=2.0)), keys=("t", "symbol", "is_volume_spike")))
query("winsor_q99", f"{HOURLY} select {T}, symbol, {r('least(volume, quantile_cont(volume, 0.99) over (partition by symbol))')} from bars")(lambda s, d: show(hourly(s, d).withColumn("value", cleaning.winsor_upper(F.col("volume"))), value="value"))
query("is_mature", f"{HOURLY} select {T}, symbol, row_number() over ({_P}) - 1 >= 24 as is_mature from bars")(lambda s, d: show(hourly(s, d).withColumn("is_mature", cleaning.is_mature()), keys=("t", "symbol", "is_mature")))
query("missing_hours", f"{HOURLY} select symbol, cast(floor((epoch(max(t)) - epoch(min(t))) / 3600) as bigint) + 1 as expected, count(distinct t) as actual, cast(floor((epoch(max(t)) - epoch(min(t))) / 3600) as bigint) + 1 - count(distinct t) as missing from bars group by symbol")(lambda s, d: cleaning.missing_hours(hourly(s, d)))
query("quality_filter", f"{_GAPS} select symbol, count(*) as n from c where not cool and under_maintenance = 0 group by symbol")(lambda s, d: panel.quality_filter(cleaning.gaps(hourly(s, d)), {"trade_allowed": True, "under_maintenance": False}).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")))

# --- indicators on the weekly panel, window 24

_N = f"{_P} rows between 23 preceding and current row"
_staged = lambda s, d: weekly(s, d).withColumns({"ret": indicators.log_return(), "tr": indicators.true_range(), "step": F.abs(F.col("close") - F.lag("close").over(history()))})
_STAGED = f"{WEEKLY}, x as (select *, ln(close / lag(close) over ({_P})) as ret, greatest(high - low, abs(high - lag(close) over ({_P})), abs(low - lag(close) over ({_P}))) as tr, abs(close - lag(close) over ({_P})) as step from panel)"
_full = lambda x, e: f"case when count({x}) over ({_N}) = 24 then {e} end"
_HL, _CO = "ln(high / low)", "ln(close / open)"
INDICATORS = {
    "ind_rv": (lambda: indicators.realised_vol(F.col("ret"), 24), _full("ret", f"stddev_samp(ret) over ({_N}) * sqrt(24.0)"), 6),
    "ind_parkinson": (lambda: indicators.parkinson(24), _full("close", f"sqrt(avg({_HL} * {_HL}) over ({_N}) / (4 * ln(2.0))) * sqrt(24.0)"), 6),
    "ind_garman_klass": (lambda: indicators.garman_klass(24), f"(select case when g >= 0 then sqrt(g) * sqrt(24.0) end from (select {_full('close', f'avg(0.5 * {_HL} * {_HL} - (2 * ln(2.0) - 1) * {_CO} * {_CO}) over ({_N})')} as g))", 6),
    "ind_atr": (lambda: indicators.atr(F.col("tr"), 24), _full("tr", f"avg(tr) over ({_N})"), 3),
    "ind_vw_vol": (lambda: indicators.volume_weighted_vol(F.col("ret"), 24), _full("ret", f"sqrt(sum(ret * ret * volume) over ({_N}) / sum(case when ret is not null then volume end) over ({_N})) * sqrt(24.0)"), 6),
    "ind_bb_width": (lambda: indicators.bollinger_width(24), _full("close", f"4 * stddev_samp(close) over ({_N}) / avg(close) over ({_N})"), 6),
    "rolling_vwap": (lambda: indicators.rolling_vwap(24), f"sum((high + low + close) / 3 * volume) over ({_N}) / sum(volume) over ({_N})", 3),
    "turnover_ratio": (lambda: indicators.turnover_ratio(24), f"volume / nullif({_full('volume', f'avg(volume) over ({_N})')}, 0)", 6),
    "returns_multi": (lambda: indicators.simple_return(k=24), f"close / lag(close, 24) over ({_P}) - 1", 6),
    "relative_volume": (indicators.relative_volume, "volume / nullif(avg(volume) over (partition by t), 0)", 6),
    "funding_pressure": (lambda: indicators.funding_pressure("vwap"), "vwap - median(vwap) over (partition by t)", 4),
    "basis": (lambda: indicators.basis("close", "vwap"), "(close - vwap) / nullif(vwap, 0)", 6),
}


def _indicator(name, column, sql, digits):
    if name == "ind_garman_klass":
        inner = _full("close", f"avg(0.5 * {_HL} * {_HL} - (2 * ln(2.0) - 1) * {_CO} * {_CO}) over ({_N})")
        text = f"{_STAGED}, g as (select t, symbol, {inner} as g from x) select {T}, symbol, {r('case when g >= 0 then sqrt(g) * sqrt(24.0) end', digits)} from g"
    else:
        text = f"{_STAGED} select {T}, symbol, {r(sql, digits)} from x"
    query(name, text)(lambda s, d: show(_staged(s, d).withColumn("value", column()), digits, value="value"))


for _name, (_column, _sql, _digits) in INDICATORS.items():
    _indicator(_name, _column, _sql, _digits)
_vols = lambda s, d: _staged(s, d).withColumns({"vol": indicators.realised_vol(F.col("ret"), 24), "range": indicators.atr(F.col("tr"), 24)})
_VOLS = f"{_STAGED}, v as (select *, {_full('ret', f'stddev_samp(ret) over ({_N}) * sqrt(24.0)')} as vol, {_full('tr', f'avg(tr) over ({_N})')} as range from x)"
query("price_efficiency", f"{_VOLS} select {T}, symbol, {r('vol / nullif(range / nullif(close, 0), 0)')} from v")(lambda s, d: show(_vols(s, d).withColumn("value", indicators.price_efficiency(F.col("vol"), F.col("range"))), value="value"))
query("vol_regime", f"{_VOLS} select {T}, symbol, {r(f'vol / nullif({_full("vol", f'avg(vol) over ({_N})')}, 0)')} from v")(lambda s, d: show(_vols(s, d).withColumn("value", indicators.vol_regime(F.col("vol"), 24)), value="value"))
_OI = {"oi_delta": f"volume - lag(volume) over ({_P})", "oi_delta_usd": f"volume * close - lag(volume * close) over ({_P})"}
_OI |= {"oi_delta_over_volume": f"({_OI['oi_delta']}) / (volume + 1e-12)", "oi_delta_usd_over_quote_volume": f"({_OI['oi_delta_usd']}) / (close * volume + 1e-12)"}
query("oi_features", f"{WEEKLY} select {T}, symbol, {', '.join(r(v, 4, k) for k, v in _OI.items())} from panel")(lambda s, d: show(indicators.open_interest(weekly(s, d).withColumns({"oi_open_interest": F.col("volume"), "oi_open_interest_usd": F.col("volume") * F.col("close")})), 4, **{k: k for k in _OI}))
query("bar_times", f"{HOURLY} select {T}, symbol, strftime(t + interval 1 hour, '%Y-%m-%d %H:%M:%S') as bar_end_time, strftime(t + interval 1 hour + interval 1 millisecond, '%Y-%m-%d %H:%M:%S.%g') as feature_time from bars")(lambda s, d: show(indicators.availability(hourly(s, d)).withColumns({"bar_end_time": F.date_format("bar_end_time", "yyyy-MM-dd HH:mm:ss"), "feature_time": F.date_format("feature_time", "yyyy-MM-dd HH:mm:ss.SSS")}), keys=("t", "symbol", "bar_end_time", "feature_time")))
query("universe_size", f"{HOURLY}, c as (select t, count(*) as n from bars group by t) select {T}, n as cs_universe_size, {r('n * 1.0 / (select count(distinct symbol) from bars)', 6, 'cs_coverage_frac')} from c where n >= greatest(1, (select count(distinct symbol) from bars) // 2)")(lambda s, d: show(indicators.universe_size(panel.calendar(hourly(s, d)), hourly(s, d).select("symbol").distinct().count()), keys=("t", "cs_universe_size"), cs_coverage_frac="cs_coverage_frac"))

# --- hygiene

_COLS = ["f1", "f2", "f3", "y"]
query("coverage_by_column", f"{FACTOR_SQL}, u as ({' union all '.join(f'select {chr(39)}{c}{chr(39)} as feature, {c} as x from fac' for c in _COLS)}) select feature, {r('count(x) * 1.0 / count(*)', 6, 'coverage')}, {r('stddev_samp(x)', 3, 'std')}, count(x) = 0 as all_null from u group by feature")(lambda s, d: hygiene.coverage(factors(s, d), _COLS).select("feature", rounded("coverage").alias("coverage"), rounded("std", 3).alias("std"), "all_null"))
_PAIRS = " union all ".join(f"select '{a}' as a, '{b}' as b, covar_pop({a}, {b}) / nullif(sqrt(var_pop({a})) * sqrt(var_pop({b})), 0) as corr from fac where {a} is not null and {b} is not null" for a, b in combinations(_COLS, 2))
query("corr_matrix", f"{FACTOR_SQL} select a, b, {r('corr', 6, 'corr')} from ({_PAIRS})")(lambda s, d: show(hygiene.correlations(factors(s, d), _COLS), keys=("a", "b"), corr="corr"))
query("corr_top_partner", f"{FACTOR_SQL}, c as ({_PAIRS}), s as (select a, b, corr from c union all select b, a, corr from c), k as (select *, row_number() over (partition by a order by abs(corr) desc, b) as k from s) select a as feature, b as partner, {r('corr', 6, 'corr')} from k where k = 1")(lambda s, d: show(hygiene.top_partners(hygiene.correlations(factors(s, d), _COLS)), keys=("feature", "partner"), corr="corr"))
query("corr_audit", f"{FACTOR_SQL}, c as ({_PAIRS}) select {r('max(abs(corr))', 6, 'max_corr')}, count(*) as n_pairs from c where a in ('f1', 'f2', 'f3') and b in ('f1', 'f2', 'f3')")(lambda s, d: show(hygiene.audit(hygiene.correlations(factors(s, d), _COLS), ["f1", "f2", "f3"]), keys=("n_pairs",), max_corr="max_corr"))
query("nan_ratio", f"{FACTOR_SQL}, u as ({' union all '.join(f'select {chr(39)}{c}{chr(39)} as feature, {c} as x from fac' for c in _COLS)}) select feature, {r('1 - count(x) * 1.0 / count(*)', 6, 'nan_ratio')} from u group by feature")(lambda s, d: show(hygiene.nan_ratio(factors(s, d), _COLS), keys=("feature",), nan_ratio="nan_ratio"))
_CLIP = lambda c: f"case when {c} is not null then least(greatest({c}, quantile_cont({c}, 0.005) over (partition by symbol)), quantile_cont({c}, 0.995) over (partition by symbol)) end as {c}"
query("winsor_zscore", f"{FACTOR_SQL}, c as (select t, symbol, {_CLIP('f1')}, {_CLIP('f3')} from fac) select {T}, symbol, {', '.join(r(f'case when stddev_pop({c}) over (partition by symbol) > 0 then ({c} - avg({c}) over (partition by symbol)) / (stddev_pop({c}) over (partition by symbol) + 1e-12) end', 5, c) for c in ('f1', 'f3'))} from c")(lambda s, d: show(hygiene.winsor_zscore(factors(s, d), ["f1", "f3"]), 5, f1="f1", f3="f3"))
query("low_info", f"{FACTOR_SQL}, f as (select *, 1.0 as flat from fac), p as (select symbol, case when coalesce(stddev_pop(f1), 0) <= 0 then 1.0 else 0 end as f1, case when coalesce(stddev_pop(flat), 0) <= 0 then 1.0 else 0 end as flat from f group by symbol), u as (select 'f1' as feature, avg(f1) as s from p union all select 'flat', avg(flat) from p) select feature, {r('s', 6, 'flat_share')}, s > 0.8 as low_info from u")(lambda s, d: show(hygiene.low_information(factors(s, d).withColumn("flat", F.lit(1.0)), ["f1", "flat"]), keys=("feature", "low_info"), flat_share="flat_share"))
_DW = {"f1": 0.001, "f2": 2.0, "f3": -1.0}
_NUM, _DEN = " + ".join(f"coalesce({c} * {w}, 0)" for c, w in _DW.items()), " + ".join(f"case when {c} is not null then {abs(w)} else 0.0 end" for c, w in _DW.items())
query("dynamic_score", f"{FACTOR_SQL} select {T}, symbol, {r(f'case when {_DEN} > 0 then ({_NUM}) / ({_DEN}) end', 5, 'score')}, {' + '.join(f'case when {c} is not null then 1 else 0 end' for c in _DW)} as n_used from fac")(lambda s, d: show(hygiene.dynamic_score(factors(s, d), _DW), 5, ("t", "symbol", "n_used"), score="score"))


_WIDE = ["f1", "f2", "f3", "f4", "flat"]
_WIDE_SQL = f"{FACTOR_SQL.replace('with ', 'with recursive ', 1)}, wide as (select *, f2 * 2 + 1 as f4, 1.0 as flat from fac)"
_STAT = "stat as (" + " union all ".join(f"select '{c}' as feature, count({c}) * 1.0 / count(*) as coverage, stddev_samp({c}) as std from wide" for c in _WIDE) + ")"
_ALIKE = "alike as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, abs(covar_pop({a}, {b}) / nullif(sqrt(var_pop({a})) * sqrt(var_pop({b})), 0)) as corr from wide where {a} is not null and {b} is not null" for a, b in combinations(_WIDE, 2)) + "), two as (select * from alike union all select b, a, corr from alike)"


@query(
    "prune_greedy",
    f"""{_WIDE_SQL}, {_STAT}, {_ALIKE}, ranked as (select *, row_number() over (order by coverage desc, feature) as i from stat),
walk as (select cast(0 as bigint) as i, cast([] as varchar[]) as chosen, '' as feature, '' as reason
  union all select i, case when reason = '' then list_append(chosen, feature) else chosen end, feature, reason from (
    select k.i, chosen, k.feature, case when coverage < 0.5 then 'coverage' when coalesce(std, 0) <= 1e-12 then 'constant'
      when exists (select 1 from two where two.a = k.feature and list_contains(chosen, two.b) and two.corr > 0.95) then 'correlated' else '' end as reason
    from walk join ranked k on k.i = walk.i + 1))
select feature, reason = '' as kept, reason from walk where i > 0""",
)
def prune(spark, sf_dir):
    df = factors(spark, sf_dir).withColumns({"f4": F.col("f2") * 2 + 1, "flat": F.lit(1.0)})
    return spark.createDataFrame(hygiene.prune_greedy(df, _WIDE), "feature string, kept boolean, reason string")


@query(
    "prune_v1",
    f"""{_WIDE_SQL}, {_STAT}, {_ALIKE}, pairs as (select a, b, corr, row_number() over (order by a, b) as i from alike where a <> 'flat' and b <> 'flat'),
walk as (select cast(0 as bigint) as i, (select coalesce(list(feature), cast([] as varchar[])) from stat where coverage < 0.3 and feature <> 'flat') as gone
  union all select p.i, case when not list_contains(gone, p.a) and not list_contains(gone, p.b) and p.corr > 0.95
    then list_append(gone, case when x.coverage < y.coverage then p.a else p.b end) else gone end
  from walk join pairs p on p.i = walk.i + 1 join stat x on x.feature = p.a join stat y on y.feature = p.b)
select feature, not list_contains((select gone from walk where i = (select max(i) from walk)), feature) as kept from stat where feature <> 'flat'""",
)
def prune_v1(spark, sf_dir):
    return spark.createDataFrame(hygiene.prune_pairwise(factors(spark, sf_dir).withColumn("f4", F.col("f2") * 2 + 1), ["f1", "f2", "f3", "f4"]), "feature string, kept boolean")


# --- backtests: the mean-reversion factor as score

_SCORE = f"{FACTOR_SQL}, sc as (select t, symbol, f1 as score, y as ret from fac), v as (select *, case when score is not null and ret is not null then 1 else 0 end as ok from sc)"
_WEIGHT = f"""{_SCORE},
n as (select *, sum(ok) over (partition by t) as n from v),
k as (select *, greatest(1, cast(floor(n * 0.2) as bigint)) as m,
  row_number() over (partition by t order by 1 - ok, score desc, symbol) as u, row_number() over (partition by t order by 1 - ok, score asc, symbol desc) as d from n),
l as (select *, case when 2 * m > n then cast(floor(n / 2.0) as bigint) else m end as q from k),
w as (select t, symbol, score, ret, case when ok = 0 or n < 2 then 0.0 when u <= q then 0.005 / q when d <= q then -0.005 / q else 0.0 end as w from l)"""
_scored = lambda s, d: backtest.forward_return(factors(s, d, ("f1",), keep=("close",)).withColumnRenamed("f1", "score"))
_wide = _WEIGHT.replace("floor(n * 0.2)", "floor(n * 0.6)").replace("l as (select *, case when 2 * m > n then cast(floor(n / 2.0) as bigint) else m end as q from k)", "l as (select *, case when 2 * m > n then cast(floor(n / 2.0) as bigint) else m end as q, case when 2 * m > n then n - cast(floor(n / 2.0) as bigint) else m end as p from k)").replace("when d <= q then -0.005 / q", "when d <= p then -0.005 / p")
_curve = lambda s, d: backtest.long_short_curve(backtest.long_short_weights(_scored(s, d), gross=0.01), 10.0)
_CURVE = f"""{_WEIGHT}, mv as (select *, abs(w - lag(w, 1, 0.0) over ({_P})) as m from w),
b as (select t, cast(sum(case when w > 0 then 1 else 0 end) as bigint) as n_long, cast(sum(case when w < 0 then 1 else 0 end) as bigint) as n_short, 0.5 * sum(m) as turnover, sum(w * coalesce(ret, 0)) as gross from mv group by t),
e as (select *, gross - 10.0 * 1e-4 * turnover as net from b),
q as (select *, product(1 + coalesce(net, 0)) over (order by t rows between unbounded preceding and current row) as equity from e),
c as (select *, max(equity) over (order by t rows between unbounded preceding and current row) as peak from q), curve as (select *, equity / peak - 1 as drawdown from c)"""
query("ls_weights", f"{_WEIGHT} select {T}, symbol, {r('w', 8, 'w')} from w")(lambda s, d: show(backtest.long_short_weights(_scored(s, d), gross=0.01), 8, w="w"))
query("ls_weights_overlap", f"{_wide} select {T}, symbol, {r('w', 8, 'w')} from w")(lambda s, d: show(backtest.long_short_weights(_scored(s, d), 0.6, 0.6, gross=0.01), 8, w="w"))
query("ls_curve", f"{_CURVE} select {T}, n_long, n_short, {', '.join(r(x, 6, x) for x in ('turnover', 'gross', 'net'))}, {r('ln(equity)', 6, 'log_equity')}, {r('drawdown', 6, 'drawdown')} from curve")(lambda s, d: show(_curve(s, d), 6, ("t", "n_long", "n_short"), turnover="turnover", gross="gross", net="net", log_equity=F.ln("equity"), drawdown="drawdown"))
_YEAR = 365 / 7
query("ls_summary", f"{_CURVE} select {r(f'ln(power(1 + avg(net), {_YEAR}))', 6, 'log_ann')}, {r(f'stddev_pop(net) * sqrt({_YEAR})', 6, 'ann_vol')}, {r(f'(power(1 + avg(net), {_YEAR}) - 1) / (stddev_pop(net) * sqrt({_YEAR}))', 6, 'sharpe')}, {r('min(drawdown)', 6, 'max_drawdown')}, {r('avg(turnover)', 6, 'avg_turnover')}, {r('ln(arg_max(equity, t))', 6, 'log_equity')}, count(*) as n from curve")(lambda s, d: show(backtest.summarise(_curve(s, d), F.col("net"), _YEAR, F.col("turnover")), 6, ("n",), log_ann=F.ln(F.col("ann_return") + 1), ann_vol="ann_vol", sharpe="sharpe", max_drawdown="max_drawdown", avg_turnover="avg_turnover", log_equity=F.ln("final_equity")))
_GROUPS = f"{_SCORE}, g as (select t, ret, ntile(5) over (partition by t order by score, symbol) as g, count(*) over (partition by t) as n from v where ok = 1), quant as (select t, {', '.join(f'avg(case when g = {k} and n >= 5 then g.ret end) as q{k}' for k in range(1, 6))} from (select distinct t from v) left join g using (t) group by t)"
_groups = lambda s, d: backtest.quantile_returns(_scored(s, d), 5)
query("quantile_returns", f"{_GROUPS} select {T}, {', '.join(r(f'q{k}', 6, f'q{k}') for k in range(1, 6))} from quant")(lambda s, d: show(_groups(s, d), 6, ("t",), **{f"q{k}": f"q{k}" for k in range(1, 6)}))
query("quantile_spreads", f"{_GROUPS} select {T}, {r('q5 - q1', 6, 'spread')}, {r('(q4 + q5) / 2 - (q1 + q2) / 2', 6, 'wide')} from quant")(lambda s, d: show(backtest.quantile_spreads(_groups(s, d), 5, 2, 2), 6, ("t",), spread="spread", wide="wide"))
query("quantile_summary", f"{_GROUPS}, e as (select t, q5 - q1 as net from quant), q as (select *, product(1 + coalesce(net, 0) * 0.001) over (order by t rows between unbounded preceding and current row) as equity from e), c as (select *, equity / max(equity) over (order by t rows between unbounded preceding and current row) - 1 as drawdown from q) select {r('avg(net * 0.001)', 6, 'mean')}, {r('stddev_pop(net * 0.001)', 6, 'std')}, {r('min(drawdown)', 6, 'max_drawdown')}, count(*) as n from c")(lambda s, d: show(backtest.equity(backtest.quantile_spreads(_groups(s, d), 5).withColumn("x", F.col("spread") * 0.001), "x").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("drawdown").alias("dd"), F.count(F.lit(1)).alias("n")), 6, ("n",), mean="mean", std="std", max_drawdown="dd"))


@query(
    "topk_swap",
    f"""{DAILY.replace('with ', 'with recursive ', 1)}, days as (
  select t, row_number() over (order by t) as i, list(struct_pack(s := symbol, v := close - open) order by close - open desc, symbol) as signals
  from panel where close - open is not null group by t),
walk as (select cast(0 as bigint) as i, cast([] as bigint[]) as held
  union all select i, list_concat(list_filter(held, lambda x: not list_contains(sold, x)), list_transform(wanted[1:len(sold) + greatest(0, 5 - len(held))], lambda x: x.s)) from (
    select i, held, wanted, list_transform(unwanted[1:len(list_filter(list_zip(wanted[1:least(len(wanted), len(unwanted))], unwanted[1:least(len(wanted), len(unwanted))]), lambda z: z[1].v > z[2].v))], lambda x: x.s) as sold from (
      select d.i, held, list_filter(signals, lambda x: not list_contains(held, x.s)) as wanted, list_reverse(list_filter(signals, lambda x: list_contains(held, x.s))) as unwanted
      from walk join days d on d.i = walk.i + 1)))
select strftime(cast(t as timestamp), '%Y-%m-%d') as t, unnest(held) as symbol from walk join days using (i)""",
)
def swap(spark, sf_dir):
    scored = evaluate(daily(spark, sf_dir), {"score": parse("Sub($close,$open)")})
    return backtest.topk_swap(scored, 5, 0).select(F.date_format("t", "yyyy-MM-dd").alias("t"), "symbol")


_FILE = f"""{FACTOR_SQL}, sc as (select t, symbol, {' + '.join(f'coalesce({w} * ({c} - avg({c}) over (partition by t)) / nullif(stddev_pop({c}) over (partition by t), 0), 0)' for c, w in (('f1', 1.0), ('f2', -0.5)))} as score0, f1, f2, y as ret from fac),
v0 as (select t, symbol, case when coalesce(f1, f2) is not null then score0 end as score, ret from sc), v as (select *, case when score is not null and ret is not null then 1 else 0 end as ok from v0)"""


@query("files_to_backtest", _CURVE.replace(_SCORE, _FILE).replace("0.005", "0.01") + f" select {r('sum(net)', 6, 'net')}, {r('sum(turnover)', 6, 'turnover')}, count(*) as n from curve")
def files_to_backtest(spark, sf_dir):
    """The weekly panel's raw bars written as CSV by symbol, and a factor file, read back and run."""
    import json
    import uuid

    out = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    rows = weekly_bars(spark, sf_dir).withColumn("datetime", F.date_format("t", "yyyy-MM-dd HH:mm:ss")).drop("t")
    files.write_csv(rows, f"{out}/prices", by="symbol")
    text = json.dumps({"exprs": [FACTORS["f1"], FACTORS["f2"]], "weights": [1.0, -0.5]})
    spark.range(1).select(F.lit(text)).coalesce(1).write.text(f"{out}/factors.json")
    found = backtest_files.run(spark, f"{out}/factors.json", f"{out}/prices", timeframe="1w", gross=0.02, cost_bps=10.0)
    return show(found["curve"].agg(F.sum("net").alias("net"), F.sum("turnover").alias("turnover"), F.count(F.lit(1)).alias("n")), keys=("n",), net="net", turnover="turnover")
