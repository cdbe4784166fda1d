"""Queries of file sources, ingestion rules, sets and trial logs, on tables that are written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.parser import parse
from quantloom.operators import cleaning, panel, pool
from quantloom.plans.compiler import between
from quantloom.queries.base import HOURLY, TICKS, WEEKLY, T, hourly, query, r, read, shared_folder, show, ticks, weekly
from quantloom.sources import files

_P = "partition by symbol order by t"
_BAR = ("open", "high", "low", "close", "volume")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _milliseconds(t: str = "t"):
    return F.unix_millis(t).cast("string")


# --- klines and trades as text, with a header that is a row and rows that don't parse


@query("csv_klines", f"{HOURLY} select {T}, {', '.join(r(c, 6, f'last_{c}') for c in _BAR)} from bars where symbol = 'click' and hour(t) <> 3")
def csv_klines(spark, sf_dir):
    """Hours of one symbol; those at three o'clock have a price that is no number."""
    rows = hourly(spark, sf_dir).where("symbol = 'click'")
    cells = {"open_time": _milliseconds(), **{c: F.col(c).cast("string") for c in _BAR}}
    cells["close"] = F.when(F.hour("t") == 3, F.lit("n/a")).otherwise(cells["close"])
    text = rows.select(*(cells.get(c, F.lit("0")).alias(c) for c in files.KLINE_COLUMNS))
    out = _folder(spark, "klines")
    text.write.option("header", True).csv(out)
    found = files.klines(files.read_csv(spark, out, files.KLINE_COLUMNS), "last_")
    return show(found, 6, ("t",), **{f"last_{c}": f"last_{c}" for c in _BAR})


@query("csv_trades", f"with {TICKS.format(symbol='event_type')} select maker, count(*) as n, {r('sum(price * quantity)', 4, 'quote')} from ticks where event_id % 50 <> 0 group by maker")
def csv_trades(spark, sf_dir):
    """All ticks as trades; every fiftieth has no time."""
    rows = ticks(spark, sf_dir)
    cells = {
        "price": F.col("price").cast("string"), "quantity": F.col("quantity").cast("string"), "is_buyer_maker": F.when(F.col("maker"), F.when(F.col("event_id") % 2 == 0, "True").otherwise("t")).otherwise("false"),
        "transact_time": F.when(F.col("event_id") % 50 == 0, "").when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(_milliseconds("ts")),
    }
    out = _folder(spark, "trades")
    rows.select(*(cells.get(c, F.lit("0")).alias(c) for c in files.TRADE_COLUMNS)).write.option("header", True).csv(out)
    found = files.trades(files.read_csv(spark, out, files.TRADE_COLUMNS))
    return show(found.groupBy("maker").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("price") * F.col("quantity")).alias("quote")), 4, ("maker", "n"), quote="quote")


@query("timestamp_forms", f"""{HOURLY} select 'numbers' as form, count(*) as n, strftime(min(t), '%Y-%m-%d %H:%M:%S') as first_t, strftime(max(t), '%Y-%m-%d %H:%M:%S') as last_t from bars
union all select 'dates', count(*), strftime(min(t), '%Y-%m-%d %H:%M:%S'), strftime(max(t), '%Y-%m-%d %H:%M:%S') from bars""")
def timestamp_forms(spark, sf_dir):
    """A column of milliseconds and one of ISO dates, each told by the share of numbers."""
    rows = hourly(spark, sf_dir)
    out = []
    for form, text in (("numbers", _milliseconds()), ("dates", F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss"))):
        found = files.timestamps(rows.select(text.alias("time")), "time")
        stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(found.agg(F.count("time").alias("n"), stamp(F.min("time")).alias("first_t"), stamp(F.max("time")).alias("last_t")).select(F.lit(form).alias("form"), "n", "first_t", "last_t"))
    return out[0].unionByName(out[1])


@query("csv_panel", f"{HOURLY} select {T}, symbol, {r('close', 6, 'close')}, {r('volume', 6, 'volume')} from bars")
def csv_panel(spark, sf_dir):
    """Hours written as CSV by symbol in two appends; two of their columns read back."""
    rows = hourly(spark, sf_dir).withColumn("datetime", F.date_format("t", "yyyy-MM-dd HH:mm:ss")).drop("t")
    out = _folder(spark, "panel")
    for odd in (0, 1):
        files.write_csv(rows.where(F.hour("datetime") % 2 == odd), out, by="symbol")
    return show(files.read_panel(spark, out, ["close", "volume"]), close="close", volume="volume")


@query("split_table", f"{HOURLY} select symbol, count(*) as n, {r('sum(volume)', 4, 'volume')}, {r('min(open)', 4, 'open')} from bars group by symbol")
def split_table(spark, sf_dir):
    """A Parquet table by symbol without some columns, in small row groups."""
    out = _folder(spark, "split")
    files.write_table(hourly(spark, sf_dir), f"{out}/all", row_group_bytes=1 << 20, dictionary=False)
    files.drop_columns(spark, f"{out}/all", f"{out}/narrow", ["vwap", "high", "none"])
    files.write_table(spark.read.parquet(f"{out}/narrow"), f"{out}/by", by="symbol")
    found = spark.read.parquet(f"{out}/by")
    return show(found.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"), F.min("open").alias("open")), 4, ("symbol", "n"), volume="volume", open="open")


@query("trial_stats", f"select event_type as gate, count(*) as n, count(case when value is not null and event_id % 7 <> 0 then 1 end) as n_usable, {r('avg(case when event_id % 7 <> 0 then value end)', 4, 'mean_ic')} from events where event_id % 10 <> 0 group by event_type")
def trial_stats(spark, sf_dir):
    """Counts of a trial log by gate: every tenth line is broken, every seventh trial has no coefficient."""
    e = read(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("event_id").alias("step"), F.lit("Mean($close,5)").alias("expr"), F.col("event_type").alias("gate"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("single_ic")))
    out = _folder(spark, "trials")
    e.select(F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(out)
    log = files.read_trials(spark, out, "step long, expr string, gate string, single_ic double").where("gate is not null")
    return show(log.groupBy("gate").agg(F.count(F.lit(1)).alias("n"), F.count("single_ic").alias("n_usable"), F.avg("single_ic").alias("mean_ic")), 4, ("gate", "n", "n_usable"), mean_ic="mean_ic")


@query("constituents", "select n_name as symbol, n_regionkey as start, case when n_nationkey = (select max(n_nationkey) from nation) then 99 else n_nationkey end as until from nation")
def constituents(spark, sf_dir):
    """Nations as constituents: the latest end becomes the given day."""
    rows = read(spark, sf_dir, "nation").select(F.col("n_name").alias("symbol"), F.col("n_regionkey").alias("start"), F.col("n_nationkey").alias("end"))
    return files.fix_constituents(rows, 99).select("symbol", "start", F.col("end").cast("int").alias("until"))


_RANKED = ["NATION_7", "NATION_3", "ATLANTIS", "NATION_12"]


@query("symbol_groups", f"select n_name as symbol, row_number() over (order by case n_name {' '.join(f'when {chr(39)}{n}{chr(39)} then {k}' for k, n in enumerate(_RANKED))} else 99 end, n_name) as k from nation qualify k <= 8")
def symbol_groups(spark, sf_dir):
    """The top eight nations of a ranking that names one that isn't there, filled up by name."""
    names = read(spark, sf_dir, "nation").select(F.col("n_name").alias("symbol"))
    return files.resolve_symbols(names, "top8", _RANKED)


@query("symbol_names", "select distinct replace(o_orderpriority, '-', '') as symbol, count(*) over (partition by o_orderpriority) as n from (select upper(split_part(o_orderpriority, ':', 1)) as o_orderpriority from orders)")
def symbol_names(spark, sf_dir):
    """A column of labels in the form of market names."""
    return read(spark, sf_dir, "orders").groupBy(files.symbol_name(F.col("o_orderpriority")).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


# --- panels: fixed schemas, fills, margins, universes, ranges

query("fixed_schema", f"{HOURLY} select symbol, count(*) as n, count(try_cast(symbol as double)) as n_numbers, cast(sum(cast(trunc(volume) as bigint)) as bigint) as volume, count(null) as n_missing from bars group by symbol")(
    lambda s, d: panel.fixed_schema(hourly(s, d).withColumn("name", F.col("symbol")), {"symbol": "string", "name": "double", "volume": "bigint", "none": "double"}).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count("name").alias("n_numbers"), F.sum("volume").alias("volume"), F.count("none").alias("n_missing"))
)
_HOLES = f"{HOURLY}, holes as (select t, symbol, case when hour(t) % 4 <> 1 then close end as close, case when hour(t) % 3 <> 0 then volume end as volume, case when hour(t) % 5 <> 2 then vwap end as vwap from bars)"
_holes = lambda s, d: hourly(s, d).select("t", "symbol", *(F.when(F.hour("t") % m != k, F.col(c)).alias(c) for c, m, k in (("close", 4, 1), ("volume", 3, 0), ("vwap", 5, 2))))
query("neutral_fill", f"{_HOLES} select {T}, symbol, {r(f'last_value(close ignore nulls) over ({_P} rows between unbounded preceding and current row)', 6, 'close')}, {r('coalesce(volume, 0)', 6, 'volume')}, {r('coalesce(vwap, 0.5)', 6, 'vwap')} from holes")(lambda s, d: show(_holes(s, d).withColumns(cleaning.neutral_fill({"close": "ffill", "volume": "zero", "vwap": "half"})), close="close", volume="volume", vwap="vwap"))
query("margins", f"{HOURLY}, days as (select t, row_number() over (order by t) as i, count(*) over () as n from (select distinct t from bars)) select symbol, count(*) as n, strftime(min(t), '%Y-%m-%d %H') as first_t, strftime(max(t), '%Y-%m-%d %H') as last_t from bars join days using (t) where i > 30 and i <= n - 20 group by symbol")(
    lambda s, d: panel.margins(hourly(s, d), hourly(s, d).select("t").distinct(), 30, 20).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("t"), "yyyy-MM-dd HH").alias("first_t"), F.date_format(F.max("t"), "yyyy-MM-dd HH").alias("last_t"))
)


@query("universe_filter", f"{HOURLY}, c as (select symbol, case when symbol like '%c%' then 'ok' else 'partial' end as status, max(t) as max_ts from bars group by symbol) select symbol, count(*) as n from bars where symbol in (select symbol from c where status = 'ok' and max_ts >= timestamp '2024-01-20') group by symbol")
def universe_filter(spark, sf_dir):
    b = hourly(spark, sf_dir)
    cover = b.groupBy("symbol").agg(F.max("t").alias("max_ts")).withColumn("status", F.when(F.col("symbol").contains("c"), "ok").otherwise("partial"))
    return panel.universe(b, cover, F.lit("2024-01-20").cast("timestamp")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("date_range", f"{WEEKLY}, v as (select t, symbol, case when count(close) over ({_P} rows between 4 preceding and current row) = 5 then avg(close) over ({_P} rows between 4 preceding and current row) end as x, lead(close, 2) over ({_P}) as y from panel) select {T}, symbol, {r('x', 6, 'x')}, {r('y', 6, 'y')} from v where t between timestamp '1996-07-01' and timestamp '1996-09-30'")
def date_range(spark, sf_dir):
    """Both ends are in; the bars that the expressions look at beyond them are read."""
    p = weekly(spark, sf_dir)
    found = between(p, p.select("t").distinct(), {"x": parse("Mean($close,5)"), "y": parse("Ref($close,-2)")}, "1996-07-01", "1996-09-30")
    return show(found, x="x", y="y")


query("set_operations", f"{HOURLY}, a as (select date_trunc('day', t) as d, symbol from bars where symbol <> 'click'), b as (select date_trunc('day', t) as d, symbol from bars where close > 170), u as (select 'union' as op, * from (select * from a union select * from b) union all select 'intersect', * from (select * from a intersect select * from b) union all select 'except', * from (select * from a except select * from b)) select op, symbol, count(*) as n from u group by op, symbol")(lambda s, d: _sets(hourly(s, d)))


def _sets(bars: DataFrame) -> DataFrame:
    day = bars.select(F.date_trunc("day", "t").alias("d"), "symbol", "close")
    a, b = day.where("symbol <> 'click'").select("d", "symbol"), day.where("close > 170").select("d", "symbol")
    found = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    named = [f.withColumn("op", F.lit(k)) for k, f in found.items()]
    return named[0].unionByName(named[1]).unionByName(named[2]).groupBy("op", "symbol").agg(F.count(F.lit(1)).alias("n"))


# --- the search's log and targets

_GAINS = {"abs": "value", "delta_best": "greatest(value - coalesce(max(value) over (order by event_id rows between unbounded preceding and 1 preceding), 0), 0)", "delta_obj": "value - coalesce(lag(value) over (order by event_id), 0)"}
for _mode, _gain in _GAINS.items():
    query(f"reward_{_mode}", f"select event_id as step, {r(_gain, 6, 'reward')} from events")(lambda s, d, m=_mode: show(pool.shape_reward(read(s, d, "events").select(F.col("event_id").alias("step"), F.col("value").alias("objective")), m), 6, ("step",), reward="reward"))
query("residual_target", f"{WEEKLY} select {T}, symbol, {r('close - (coalesce(open * -2.0, 0) + coalesce(vwap * 0.5, 0))', 4)} from panel")(lambda s, d: show(weekly(s, d).withColumn("value", pool.residual("close", {"vwap": 0.5, "open": -2.0, "volume": 0.1}, 2)), 4, value="value"))
