"""Queries of intra-hour statistics, surrogate scoring, stores and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import surrogate
from quantloom.operators import intrahour
from quantloom.queries.base import DENSE_MINUTES, TICKS, WEEKLY, dense_minutes, query, r, shared_folder, show, weekly
from quantloom.sources import files
from quantloom.streaming import bars as stream

_kept = lambda s, d: intrahour.minutes(dense_minutes(s, d))
H = "strftime(cast(h as timestamp), '%Y-%m-%d %H:%M:%S') as h"
_O = "partition by symbol, h order by t"
KEPT = f"""with {DENSE_MINUTES}, a as (select symbol, t, open, high, low, close, volume, date_trunc('hour', t) as h, high / nullif(low, 0) as ratio from bars),
b as (select *, count(*) over (partition by symbol, h) as all_n, sum(case when coalesce(ratio <= 1.2, false) then 1 else 0 end) over (partition by symbol, h) as good_n, max(ratio) over (partition by symbol, h) as ratio_max from a),
c as (select * from b where coalesce(ratio <= 1.2, false) or good_n < 10),
k as (select *, row_number() over ({_O}) - 1 as i, minute(t) as m, ln(close / nullif(lag(close) over ({_O}), 0)) as r1, coalesce(ln(close / nullif(lag(close) over ({_O}), 0)), 0) as r,
  lag(volume) over ({_O}) as v0, lag(close) over ({_O}) as c0 from c)"""


def _show(df, digits, *names, **renamed):
    return show(df.withColumn("h", F.date_format("h", "yyyy-MM-dd HH:mm:ss")), digits, ("symbol", "h"), **{n: n for n in names}, **renamed)


def _hourly(name, op, columns: dict[str, str], digits: int = 6, source: str = "k", extra: str = ""):
    sql = f"{KEPT}{extra}, o as (select symbol, h, {', '.join(f'{v} as {k}' for k, v in columns.items())} from {source} group by symbol, h) select symbol, {H}, {', '.join(r(k, digits, k) for k in columns)} from o"
    query(name, sql)(lambda s, d: _show(op(_kept(s, d)), digits, *columns))


_share = lambda keep: f"sum(case when {keep} then volume else 0 end) / nullif(sum(volume), 0)"
_hourly("ih_vol_moments", intrahour.volume_moments, {"n_minutes": "max(all_n)", "n_minutes_kept": "count(*)", "min_range_ratio_max": "max(ratio_max)", "vol_1m_mean": "avg(volume)", "vol_1m_std": "stddev_pop(volume)", "vol_1m_cv": "stddev_pop(volume) / (avg(volume) + 1e-12)", "range_ratio_1m_std": "stddev_pop(ratio)", "log_range_1m_std": "stddev_pop(ln(ratio))"})
_up, _down = "sum(case when r > 0 then r * r else 0 end)", "sum(case when r < 0 then r * r else 0 end)"
_hourly("ih_updown", intrahour.up_down, {"up_vol_l2": f"sqrt({_up})", "down_vol_l2": f"sqrt({_down})", "up_var_share": f"{_up} / nullif(sum(r * r), 0)", "down_var_share": f"{_down} / nullif(sum(r * r), 0)"})
_hourly("ih_rv", intrahour.realised, {"rv_std_sqrt60": "stddev_pop(r) * sqrt(60.0)", "rv_l2": "sqrt(sum(r * r))", "rv_per_vol": "sqrt(sum(r * r)) / (avg(volume) + 1e-12)"})
_hourly("ih_amihud", lambda df: intrahour.amihud(df.withColumn("volume", F.col("volume") + 1)), {"liq_amihud": "avg(abs(r1) / greatest(volume + 1, 1e-12))", "amihud_signed": "sum(r / greatest((volume + 1) * close, 1e-12))", "amihud_abs": "sum(abs(r) / greatest((volume + 1) * close, 1e-12))"})
_hourly("ih_share", intrahour.shares, {"liq_last_5min_R": _share("m >= 55"), "liq_funding_impact": _share("m < 5 or m >= 55"), "liq_top_of_hour_ratio": _share("m < 10"), "is_funding_hour": "max(case when hour(h) in (0, 8, 16) then 1 else 0 end)", "liq_range_vol_ratio": "avg((high - low) / nullif(volume, 0))", "liq_spread_std": "stddev_pop((high - low) / nullif(close, 0))"})
_late = "sum(case when m >= 50 then r * r else 0 end)"
_hourly("ih_tail", intrahour.tail, {"liq_tail_risk": f"sqrt({_late}) / nullif(sqrt(sum(r * r)), 0)", "liq_tail_var_share": f"{_late} / nullif(sum(r * r), 0)"})


def _shape_sql(x: str, name: str) -> dict[str, str]:
    """DuckDB's skewness and kurtosis are the bias-corrected ones."""
    skew, kurt = f"case when count({x}) >= 10 then skewness({x}) end", f"case when count({x}) >= 10 then kurtosis({x}) end"
    return {f"shape_skew{name}": skew, f"shape_kurt{name}": kurt, f"shape_skratio{name}": f"({skew}) / (abs({kurt}) + 1e-12)"}


_hourly("ih_shape", intrahour.shape, _shape_sql("r1", "") | _shape_sql("volume", "Vol"), 4)


def _corr_sql(x: str, y: str) -> str:
    a, b = (f"case when {x} is not null and {y} is not null then {c} end" for c in (x, y))
    return f"case when count({a}) >= 10 and stddev_pop({a}) * stddev_pop({b}) > 0 then covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) end"


_hourly("ih_corr", intrahour.correlations, {f"corr_{n}": _corr_sql(x, y) for n, x, y in (("prv", "r1", "volume"), ("prvr", "r1", "dv"), ("pv", "close", "volume"), ("pvd", "close", "v0"), ("pvl", "c0", "volume"), ("pvr", "close", "dv"))}, 6, "k2", ", k2 as (select *, greatest(least(volume / nullif(v0, 0) - 1, 10), -10) as dv from k)")
_Q = {f"doc_vol_pdf{q}": f"case when max(kept) >= 12 then min(case when cr >= {q / 100} * w then r1 end) end" for q in (60, 70, 80, 90, 95)} | {"doc_vol_pdf90bi": "case when max(kept) >= 12 then min(case when ca >= 0.9 * w then a end) end"}
_hourly("ih_doc_quantile", intrahour.weighted_quantiles, _Q, 6, "d2", f", d as (select *, abs(r1) as a from (select *, count(*) over (partition by symbol, h) as kept from k) where r1 is not null and volume > 0), d2 as (select *, sum(volume) over (partition by symbol, h order by r1, t rows between unbounded preceding and current row) as cr, sum(volume) over (partition by symbol, h order by a, t rows between unbounded preceding and current row) as ca, sum(volume) over (partition by symbol, h) as w from d)")
_BINS = f"""{KEPT}, d as (select *, min(r1) over (partition by symbol, h) as lo0, max(r1) over (partition by symbol, h) as hi0 from (select *, count(*) over (partition by symbol, h) as kept from k) where r1 is not null and kept >= 12),
e as (select *, case when hi0 <= lo0 then lo0 - 1e-8 else lo0 end as lo, case when hi0 <= lo0 then hi0 + 1e-8 else hi0 end as hi from d),
f as (select symbol, h, cast(least(floor((r1 - lo) / (hi - lo) * 25), 24) as integer) as b, volume from e),
g as (select symbol, h, {', '.join(f'sum(case when b = {k} then greatest(volume, 0) else 0 end) as b{k}' for k in range(25))} from f group by symbol, h),
u as (select symbol, h, unnest([{', '.join(f'b{k}' for k in range(25))}]) as v from g),
z as (select *, avg(v) over (partition by symbol, h) as mu, row_number() over (partition by symbol, h order by v desc) as k from u)"""
_DOC = {"doc_std": "sqrt(avg(power(v - mu, 2)))", "doc_skew": "case when avg(power(v - mu, 2)) > 0 then avg(power(v - mu, 3)) / (power(sqrt(avg(power(v - mu, 2))), 3) + 1e-12) end", "doc_kurt": "case when avg(power(v - mu, 2)) > 0 then avg(power(v - mu, 4)) / (power(sqrt(avg(power(v - mu, 2))), 4) + 1e-12) - 3 end"}
_TOP = {f"doc_vol{k}_ratio": f"case when sum(v) > 0 then sum(case when k <= {k} then v else 0 end) / sum(v) end" for k in (5, 10, 50)}
for _name, _cols in (("ih_doc_hist", _DOC), ("ih_doc_top", _TOP)):
    query(_name, f"{_BINS}, o as (select symbol, h, {', '.join(f'{v} as {k}' for k, v in _cols.items())} from z group by symbol, h) select symbol, {H}, {', '.join(r(k, 5, k) for k in _cols)} from o")(lambda s, d, c=_cols: _show(intrahour.volume_profile(_kept(s, d)), 5, *c))
_head, _tail = ("ln(last(close order by t) filter (where {0}) + 1e-12) - ln(first(open order by t) filter (where {0}) + 1e-12)".format(k) for k in ("m < 45", "m >= 45"))
_SEG = {"seg_head_logret": "a", "seg_tail_logret": "b", "seg_tail_minus_head": "b - a", "seg_tail_share": "abs(b) / (abs(a) + abs(b) + 1e-12)"}
query("ih_seg", f"{KEPT}, o as (select symbol, h, {_head} as a, {_tail} as b from k group by symbol, h) select symbol, {H}, {', '.join(r(v, 6, k) for k, v in _SEG.items())} from o")(lambda s, d: _show(intrahour.segments(_kept(s, d)), 6, *_SEG))
query("ih_vol_top20", f"{KEPT}, q as (select *, quantile_cont(volume, 0.8) over (partition by symbol, h) as cut from k), o as (select symbol, h, sum(case when volume >= cut then volume else 0 end) / nullif(sum(volume), 0) as vol_top20_frac, sum(case when volume >= cut then r else 0 end) as vol_top20_logret_sum from q group by symbol, h) select symbol, {H}, {r('vol_top20_frac', 6, 'vol_top20_frac')}, {r('vol_top20_logret_sum', 6, 'vol_top20_logret_sum')} from o")(lambda s, d: _show(intrahour.top_volume(_kept(s, d)), 6, "vol_top20_frac", "vol_top20_logret_sum"))
_QRS = {}
for _c in ("close", "high", "low"):
    _beta, _cov = f"case when count(ln({_c})) >= 3 then covar_pop(i, ln({_c})) / nullif(var_pop(i), 0) * 60 end", f"covar_pop(i, ln({_c}))"
    _r2 = f"case when count(ln({_c})) >= 3 then case when var_pop(ln({_c})) > 1e-18 then least(greatest({_cov} * {_cov} / nullif(var_pop(i) * var_pop(ln({_c})), 0), 0), 1) else 0 end end"
    _QRS |= {f"qrs_beta_{_c}_per_hour": _beta, f"qrs_r2_{_c}": _r2, f"qrs_{_c}": f"({_beta}) * ({_r2})"}
_hourly("ih_qrs", intrahour.trends, _QRS, 5)
query("ih_stability", f"{KEPT}, o as (select symbol, h, stddev_pop(r) * sqrt(60.0) as x from k group by symbol, h) select symbol, {H}, {r('case when count(x) over w = 24 then x / (avg(x) over w + 1e-12) end', 6, 'rv_stability')} from o window w as (partition by symbol order by h rows between 23 preceding and current row)")(lambda s, d: _show(intrahour.stability(intrahour.realised(_kept(s, d))), 6, rv_stability="rv_stability_24h"))

# New York is five hours behind UTC in all of the fixture's days (January).
query("ih_us_open", f"with {DENSE_MINUTES}, g as (select symbol, cast(t - interval 5 hour as date) as d, max(case when strftime(t - interval 5 hour, '%H:%M') = '09:30' then open end) as a, max(case when strftime(t - interval 5 hour, '%H:%M') = '10:29' then close end) as b, max(case when strftime(t - interval 5 hour, '%H:%M') = '10:29' then t end) as stamp from bars group by 1, 2) select symbol, strftime(date_trunc('hour', stamp), '%Y-%m-%d %H:%M:%S') as h, {r('ln(b / a)', 6, 'seg_us_open_60m_logret')} from g where a is not null and b is not null")(lambda s, d: _show(intrahour.us_open(dense_minutes(s, d)), 6, "seg_us_open_60m_logret"))

# --- surrogate

EXPRESSIONS = ["Mean($close,10)", "Div(Sub($close,Mean($close,20)),Std($close,20))", "Corr($close,$volume,30)", "CSRank(Delta($vwap,5))", "Sub(Ref($high,1),Ref($low,1))", "EMA($volume,40)"]


def _trials(spark):
    return spark.range(1).select(F.explode(F.array(*map(F.lit, EXPRESSIONS))).alias("expr"))


query("expr_hash_ids")(lambda s, d: _trials(s).select("expr", surrogate.feature_ids(F.col("expr"), 4096).alias("ids")))


@query("surrogate_topk")
def surrogate_topk(spark, sf_dir):
    weights = spark.range(256).select(F.col("id").cast("int").alias("id"), (F.sin(F.col("id").cast("double"))).alias("w"))
    return surrogate.score(_trials(spark), weights, 0.1, 256).orderBy(F.col("score").desc(), "expr").limit(3).select("expr", F.round("score", 6).alias("score"))


@query("quantile_moments", f"with x as (select * from (values ('a', 0.0), ('b', 2.0)) as v(k, mean)) select k, {r('mean', 6, 'mean')}, {r('3.0', 6, 'std')}, {r('0.0', 6, 'skew')}, {r('3.0', 6, 'kurt')} from x")
def quantile_moments(spark, sf_dir):
    """Quantiles of two normal laws give back their moments."""
    z = surrogate.normal_quantile([(k + 0.5) / 32 for k in range(32)])
    rows = spark.range(2).select(F.when(F.col("id") == 0, "a").otherwise("b").alias("k"), F.array(*(F.col("id") * 2.0 + F.lit(float(3 * v)) for v in z)).alias("q"))
    return show(rows.select("k", surrogate.quantile_moments(F.col("q"), 32).alias("m")).select("k", "m.*"), 6, ("k",), mean="mean", std="std", skew="skew", kurt="kurt")


query("loss_huber", f"select event_id, {r('case when abs(value - 50) <= 1.5 then 0.5 * (value - 50) * (value - 50) else 1.5 * (abs(value - 50) - 0.75) end', 6, 'huber')}, {r('abs(0.3 - case when value - 50 < 0 then 1 else 0 end) * case when abs(value - 50) <= 1.5 then 0.5 * (value - 50) * (value - 50) else 1.5 * (abs(value - 50) - 0.75) end / 1.5', 6, 'quantile_huber')} from events")(lambda s, d: show(s.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("value") - 50).alias("e")), 6, ("event_id",), huber=surrogate.huber(F.col("e"), 1.5), quantile_huber=surrogate.quantile_huber(F.col("e"), 0.3, 1.5)))
query("n_step_return", f"select user_id, {r('list_sum(list_transform(list(value order by ts, event_id), lambda v, i: v * power(0.99, i - 1)))', 4, 'value')} from events group by user_id")(lambda s, d: show(s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("v")), 4, ("user_id",), value=surrogate.n_step_return(F.col("v"), 0.99)))

# --- stores and streams

query("float32_store_roundtrip", f"{WEEKLY} select strftime(cast(t as timestamp), '%Y-%m-%d %H:%M:%S') as t, symbol, field, {r('cast(cast(value as float) as double)', 2)} from (select t, symbol, close, volume from panel) unpivot include nulls (value for field in (close, volume))")(lambda s, d: show(files.from_float32_store(files.to_float32_store((p := weekly(s, d)), (c := p.select("t").distinct()), ["close", "volume"]), c), 2, ("t", "symbol", "field"), value="value"))


@query("stream_hourly_bars", f"""with {TICKS.format(symbol='event_type')}, last as (select date_trunc('hour', max(ts)) as t from ticks),
h as (select symbol, date_trunc('hour', ts) as t, first(price order by ts, event_id) as open, max(price) as high, min(price) as low, last(price order by ts, event_id) as close, sum(quantity) as volume, sum(price * quantity) / nullif(sum(quantity), 0) as vwap from ticks group by 1, 2)
select strftime(cast(h.t as timestamp), '%Y-%m-%d %H:%M:%S') as t, symbol, {', '.join(r(c, 8, c) for c in ('open', 'high', 'low', 'close', 'volume', 'vwap'))} from h, last where h.t < last.t""")
def stream_hourly(spark, sf_dir):
    """The stream's finished hours: all but the last, which a later tick could still join."""
    import uuid

    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    live = spark.readStream.schema(raw.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet" if _is_folder(spark, f"{sf_dir}/events.parquet") else f"{sf_dir}/event[s].parquet")
    qty = F.regexp_extract("props", r"(\d+)", 1).cast("double")
    tick = live.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"), qty.alias("quantity"))
    stream.run_available(stream.hourly_stream(tick, ["event_id"]), f"{out}/bars", f"{out}/checkpoint")
    done = spark.read.parquet(f"{out}/bars")
    return show(done, 8, **{c: c for c in ("open", "high", "low", "close", "volume", "vwap")})


def _is_folder(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()

