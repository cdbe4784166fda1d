"""The query registry, and the panels that the queries share, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import bars, panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame and its SQL twin."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only on a local master where none is set."""
    import tempfile

    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.gettempdir() + "/quantloom"


def stamp(t: Column | str = "t") -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("t")


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Halves go away from zero after scaling, as in the SQL engine that checks the results; no negative zero."""
    x, scale = (F.col(x) if isinstance(x, str) else x).cast("double"), 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale + F.lit(0.0)


def show(df: DataFrame, digits: int = 6, keys: tuple[str, ...] = ("t", "symbol"), **columns) -> DataFrame:
    """Keys (t as text) and rounded columns."""
    return df.select(*(stamp() if k == "t" else k for k in keys), *(rounded(c, digits).alias(n) for n, c in columns.items()))


T = "strftime(cast(t as timestamp), '%Y-%m-%d %H:%M:%S') as t"
FIELDS = ("open", "high", "low", "close", "volume", "vwap")
_KEY = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"


def r(sql: str, digits: int = 6, name: str = "value") -> str:
    return f"round(cast({sql} as double), {digits}) + 0.0 as {name}"


# --- weekly bars of unit prices by supplier nation: the main panel


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select(*_KEY.split(", "))
    nation = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("symbol"))
    ticks = items.join(nation, "l_suppkey").withColumn("price", F.try_divide("l_extendedprice", "l_quantity"))
    key = F.struct(*_KEY.split(", "))
    return ticks.groupBy("symbol", F.date_trunc("week", "l_shipdate").alias("t")).agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"),
        F.sum("l_quantity").alias("volume"), F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("vwap"),
    )


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense: every nation at every week that half of them have, carried forward."""
    b = weekly_bars(spark, sf_dir)
    return panel.densify(b, panel.calendar(b))


WEEKLY_BARS = f"""
bars as (
  select s_nationkey as symbol, date_trunc('week', l_shipdate) as t,
    first(l_extendedprice / l_quantity order by {_KEY}) as open, max(l_extendedprice / l_quantity) as high,
    min(l_extendedprice / l_quantity) as low, last(l_extendedprice / l_quantity order by {_KEY}) as close,
    sum(l_quantity) as volume, sum(l_extendedprice) / sum(l_quantity) as vwap
  from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2)"""
_GRID = """
cal as (select t from bars group by t having count(*) >= greatest(1, (select count(distinct symbol) from bars) // 2)),
cells as (select t, symbol from cal, (select distinct symbol from bars) as s)"""
_PANEL = """
panel as (
  select t, symbol, {fills}
  from cells left join bars using (t, symbol))"""


def _fills(fields) -> str:
    return ", ".join(f"last_value({f} ignore nulls) over (partition by symbol order by t rows between unbounded preceding and current row) as {f}" for f in fields)


WEEKLY = f"with {WEEKLY_BARS}, {_GRID}, {_PANEL.format(fills=_fills(FIELDS))}"

# --- events: hourly by type, daily by user, minutes and ticks by type


def ticks(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    e = read(spark, sf_dir, "events")
    qty = F.regexp_extract("props", r"(\d+)", 1).cast("double")
    return e.select(F.col(symbol).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"), qty.alias("quantity"), (F.col("user_id") % 2 == 1).alias("maker"))


TICKS = r"""
ticks as (
  select {symbol} as symbol, ts, event_id, value as price, cast(regexp_extract(props, '(\d+)', 1) as double) as quantity,
    user_id % 2 = 1 as maker from events)"""


def event_bars(spark: SparkSession, sf_dir: str, unit: str, symbol: str = "event_type") -> DataFrame:
    return bars.ticks_to_bars(ticks(spark, sf_dir, symbol), unit, ["event_id"])


def bars_sql(unit: str, symbol: str = "event_type") -> str:
    return f"""{TICKS.format(symbol=symbol)},
bars as (
  select symbol, date_trunc('{unit}', ts) as t, first(price order by ts, event_id) as open, max(price) as high, min(price) as low,
    last(price order by ts, event_id) as close, sum(quantity) as volume, sum(price * quantity) / nullif(sum(quantity), 0) as vwap
  from ticks group by 1, 2)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse: hours by event type as they are."""
    return event_bars(spark, sf_dir, "hour").select("symbol", "t", *FIELDS)


HOURLY = f"with {bars_sql('hour')}"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense days by user: a wide cross-section."""
    b = event_bars(spark, sf_dir, "day", "user_id").select("symbol", "t", *FIELDS)
    return panel.densify(b, panel.calendar(b))


DAILY = f"with {bars_sql('day', 'user_id')}, {_GRID}, {_PANEL.format(fills=_fills(FIELDS))}"


# --- line items dealt over the minutes of two days: every hour has dozens of minutes, some with wide ranges


def dense_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, t, open, high, low, close, volume by minute."""
    items = read(spark, sf_dir, "lineitem").select(*_KEY.split(", "))
    minute = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_linenumber")) % 2880
    tick = items.select(
        F.concat(F.lit("S"), (F.col("l_linenumber") % 2).cast("string")).alias("symbol"), F.timestamp_seconds(F.lit(1704067200) + minute * 60).alias("t"),
        (F.col("l_discount") * 300 + F.col("l_tax") * 100 + 100).alias("price"), F.struct(*_KEY.split(", ")).alias("key"), "l_quantity",
    )
    return tick.groupBy("symbol", "t").agg(F.min_by("price", "key").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "key").alias("close"), F.sum("l_quantity").alias("volume"))


DENSE_MINUTES = f"""
items as (select *, 'S' || (l_linenumber % 2) as symbol, timestamp '2024-01-01' + to_minutes(cast((l_orderkey * 31 + l_partkey * 7 + l_linenumber) % 2880 as bigint)) as t,
  l_discount * 300 + l_tax * 100 + 100 as price from lineitem),
bars as (
  select symbol, t, first(price order by {_KEY}) as open, max(price) as high, min(price) as low, last(price order by {_KEY}) as close, sum(l_quantity) as volume
  from items group by symbol, t)"""
