"""Readers and writers of market data files."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column order of archive files.
KLINE_COLUMNS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "count", "taker_buy_volume", "taker_buy_quote_volume", "ignore")
TRADE_COLUMNS = ("agg_id", "price", "quantity", "first_id", "last_id", "transact_time", "is_buyer_maker")
#: Words for true.
TRUE_WORDS = ("true", "1", "t", "yes")


def timestamp(x: Column) -> Column:
    """Milliseconds since 1970, or a date in ISO form with or without a time; NULL for anything else."""
    text = F.trim(x.cast("string"))
    return F.coalesce(F.timestamp_millis(text.try_cast("bigint")), F.try_to_timestamp(F.regexp_replace(text, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")), text.try_cast("timestamp"))


def timestamps(df: DataFrame, column: str, share: float = 0.98) -> DataFrame:
    """A text column as timestamps: milliseconds since 1970 if over ``share`` of its values are numbers, else dates in ISO form."""
    text = F.trim(F.col(column).cast("string"))
    numbers = df.agg(F.avg(text.try_cast("double").isNotNull().cast("int"))).first()[0] or 0.0
    iso = F.coalesce(F.try_to_timestamp(F.regexp_replace(text, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")), text.try_cast("timestamp"))
    return df.withColumn(column, F.timestamp_millis(text.try_cast("double").cast("bigint")) if numbers > share else iso)


def read_csv(spark: SparkSession, path: str | list[str], columns: tuple[str, ...] | None = None) -> DataFrame:
    """A CSV file as text columns; with ``columns`` there need be no header, and one that is there is a row."""
    if columns is None:
        return spark.read.option("header", True).csv(path)
    return spark.read.option("mode", "PERMISSIVE").schema(", ".join(f"`{c}` string" for c in columns)).csv(path)


def header(spark: SparkSession, path: str) -> list[str]:
    """The columns of a CSV file, from its first line."""
    return spark.read.option("header", True).csv(path).columns


def klines(raw: DataFrame, prefix: str = "") -> DataFrame:
    """t, open, high, low, close, volume of kline rows as text; headers and broken rows drop out."""
    rows = raw.select(timestamp(F.col("open_time")).alias("t"), *(F.col(c).try_cast("double").alias(f"{prefix}{c}") for c in ("open", "high", "low", "close", "volume")))
    return rows.dropna(subset=["t", f"{prefix}close"])


def trades(raw: DataFrame) -> DataFrame:
    """ts, price, quantity, maker of aggregated trades as text; headers and broken rows drop out."""
    maker = F.lower(F.trim("is_buyer_maker")).isin(*TRUE_WORDS)
    rows = raw.select(timestamp(F.col("transact_time")).alias("ts"), F.col("price").try_cast("double").alias("price"), F.col("quantity").try_cast("double").alias("quantity"), maker.alias("maker"))
    return rows.dropna(subset=["ts", "price", "quantity"])


def read_zip(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """path and columns (text) of the CSV files in ZIP archives; a row's missing fields are NULL."""

    def unpack(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, body in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(body)) as z:
                    for member in z.namelist():
                        if not member.endswith(".csv"):
                            continue
                        with z.open(member) as f:
                            for part in pd.read_csv(f, header=None, names=[*columns], dtype=str, chunksize=100_000):
                                part.insert(0, "path", name)
                                yield part.astype(object).where(part.notna(), None)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(unpack, ", ".join(["path string", *(f"`{c}` string" for c in columns)]))


def symbol_name(x: Column) -> Column:
    """``BTC/USDT:USDT``, ``BTC_USDT`` and the like as ``BTCUSDT``."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(x)), ":.*$", ""), "[/_-]", "")


def resolve_symbols(available: DataFrame, wanted: list[str] | str, ranked: list[str] | None = None) -> DataFrame:
    """symbol, k of a group: ``all``, ``topN`` (of a ranking, filled with the rest by name) or a list, in that order."""
    names = available.select("symbol").distinct().withColumn("key", symbol_name(F.col("symbol")))
    top = re.fullmatch(r"top(\d+)", wanted) if isinstance(wanted, str) else None
    order = (ranked or []) if isinstance(wanted, str) else wanted
    listed = [re.sub(r"[/_-]", "", re.sub(r":.*$", "", w.strip().upper())) for w in order]
    listed = list(dict.fromkeys(w for w in listed if w and not w.startswith("#")))
    place = F.array_position(F.array(*map(F.lit, listed)), F.col("key")) if listed else F.lit(0)
    rows = names.withColumn("p", F.when(place > 0, place))
    if not isinstance(wanted, str):
        rows = rows.where("p is not null")
    from pyspark.sql import Window

    rows = rows.withColumn("k", F.row_number().over(Window.orderBy(F.col("p").asc_nulls_last(), "symbol")))
    return (rows.where(F.col("k") <= int(top[1])) if top else rows).select("symbol", "k")


def read_text(path: str) -> str:
    """A small whole file: by the session's file systems if there is a session, else from this machine."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        with open(path, encoding="utf-8") as f:
            return f.read()
    return spark.read.text(path, wholetext=True).first()["value"]


def read_symbol_list(path: str) -> list[str]:
    """The entries of a list file, one a line; what follows # is a comment."""
    lines = (line.split("#", 1)[0].strip() for line in read_text(path).splitlines())
    return [line for line in lines if line]


def fix_constituents(rows: DataFrame, today: str) -> DataFrame:
    """Constituents (symbol, start, end): the latest end date becomes ``today``; by end and start descending, then symbol."""
    latest = rows.agg(F.max("end").alias("latest")).first()[0]
    return rows.withColumn("end", F.when(F.col("end") == F.lit(latest), F.lit(today)).otherwise(F.col("end"))).orderBy(F.col("end").desc(), F.col("start").desc(), "symbol")


def read_factors(path: str) -> list[tuple[str, float]]:
    """(expression, weight) of a factor file: JSON with exprs or factors and weights, or CSV with exprs, weight."""
    if path.endswith(".csv"):
        rows = pd.read_csv(io.StringIO(read_text(path)))
        rows = rows[rows["exprs"].notna() & (rows["exprs"] != "ensemble")]
        return [(str(e), float(w)) for e, w in zip(rows["exprs"], rows["weight"], strict=True)]
    data = json.loads(read_text(path))
    exprs = data.get("exprs") or data.get("factors")
    weights = data.get("weights")
    if not exprs or (weights is not None and len(weights) != len(exprs)):
        raise ValueError(f"{path}: expressions and weights don't fit")
    return [(e, float(w)) for e, w in zip(exprs, weights or [1.0] * len(exprs), strict=True)]


def read_weights(path: str) -> dict[str, float]:
    """Column weights of a JSON object; anything but numbers is refused."""
    data = json.loads(read_text(path))
    if not isinstance(data, dict) or not data or not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in data.values()):
        raise ValueError(f"{path}: column weights are needed")
    return {k: float(v) for k, v in data.items()}


def read_trials(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines trial log; lines that don't parse drop out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_table(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite", row_group_bytes: int = 128 << 20, dictionary: bool = True) -> None:
    """A zstd Parquet table, by symbol or not; published by the job's commit."""
    w = df.write.mode(mode).option("compression", "zstd").option("parquet.block.size", row_group_bytes).option("parquet.enable.dictionary", str(dictionary).lower())
    (w.partitionBy(by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str, by: str | None = None, mode: str = "append") -> None:
    """CSV with a header; new rows come in files of their own, which the job's commit publishes all at once."""
    w = df.write.mode(mode).option("header", True)
    (w.partitionBy(by) if by else w).csv(path)


def drop_columns(spark: SparkSession, path: str, out: str, names: list[str]) -> None:
    """A Parquet table without some columns, at a new place; names that it lacks don't matter."""
    write_table(spark.read.parquet(path).drop(*names), out)


def read_panel(spark: SparkSession, path: str, columns: list[str], time: str = "datetime") -> DataFrame:
    """t, symbol and columns (doubles) of CSV files with a header, one symbol a file or a folder ``symbol=``; only these are parsed.

    Without a symbol column, the file's name up to its first dot is the symbol. Rows without a time drop out; a column that no file has is NULL.
    """
    raw = spark.read.option("header", True).csv(path)
    symbol = F.col("symbol").cast("string") if "symbol" in raw.columns else F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    values = [(F.col(c).try_cast("double") if c in raw.columns else F.lit(None).cast("double")).alias(c) for c in columns]
    return raw.select(timestamp(F.col(time)).alias("t"), symbol.alias("symbol"), *values).dropna(subset=["t"])


# --- one little-endian float32 value column for each symbol and field: the first value is the start index


def to_float32_store(panel: DataFrame, dates: DataFrame, fields: list[str]) -> DataFrame:
    """symbol, field, start, data: a symbol's values from its first to its last bar on the calendar, NaN where it has none."""
    from pyspark.sql import Window

    numbered = dates.select("t", (F.row_number().over(Window.orderBy("t")) - 1).alias("i"))
    rows = panel.select("t", "symbol", *fields).join(F.broadcast(numbered) if dates.count() < 1_000_000 else numbered, "t")

    def dump(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        first, last = int(pdf["i"].iat[0]), int(pdf["i"].iat[-1])
        out = []
        for f in fields:
            values = np.full(last - first + 2, np.nan, "<f4")
            values[0] = first
            values[1 + pdf["i"].to_numpy() - first] = pdf[f].to_numpy(float)
            out.append((pdf["symbol"].iat[0], f, first, values.tobytes()))
        return pd.DataFrame(out, columns=["symbol", "field", "start", "data"])

    kind = dict(panel.dtypes)["symbol"]
    return rows.groupBy("symbol").applyInPandas(dump, f"symbol {kind}, field string, start long, data binary")


def from_float32_store(store: DataFrame, dates: DataFrame) -> DataFrame:
    """t, symbol, field, value of a store; NaN is NULL."""
    from pyspark.sql import Window

    numbered = dates.select("t", (F.row_number().over(Window.orderBy("t")) - 1).cast("long").alias("i"))

    def load(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for symbol, field, data in zip(frame["symbol"], frame["field"], frame["data"], strict=True):
                values = np.frombuffer(data, "<f4")
                yield pd.DataFrame({"symbol": symbol, "field": field, "i": np.arange(len(values) - 1) + int(values[0]), "value": values[1:].astype(float)})

    kind = dict(store.dtypes)["symbol"]
    rows = store.select("symbol", "field", "data").mapInPandas(load, f"symbol {kind}, field string, i long, value double")
    return rows.join(numbered, "i").select("t", "symbol", "field", F.when(~F.isnan("value"), F.col("value")).alias("value"))
