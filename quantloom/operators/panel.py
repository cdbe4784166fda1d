"""Panels: time by symbol tables on a common calendar."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.windows import history


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def least_symbols(n: int, fraction: float = 0.5, mode: str = "loader") -> int:
    """Symbols that a timestamp needs: the loader's floor of a half, or the backtest's ceiling of a fraction."""
    return max(1, n // 2) if mode == "loader" else max(1, math.ceil(n * fraction))


def calendar(bars: DataFrame, fraction: float = 0.5, mode: str = "loader") -> DataFrame:
    """t, n_symbols of the timestamps that enough symbols have (t and symbol are a key of ``bars``)."""
    n = bars.select("symbol").distinct().count()
    return bars.groupBy("t").agg(F.count("symbol").alias("n_symbols")).where(F.col("n_symbols") >= least_symbols(n, fraction, mode))


def densify(bars: DataFrame, dates: DataFrame, fill: list[str] | None = None) -> DataFrame:
    """A row for every timestamp of ``dates`` and every symbol, ``fill`` columns carried forward (never back).

    The grid is the result's own size; the symbols, a dimension, are one row that each timestamp unfolds.
    """
    symbols = bars.select("symbol").distinct().agg(F.sort_array(F.collect_list("symbol")).alias("s"))
    cells = dates.select("t").crossJoin(F.broadcast(symbols)).select("t", F.explode("s").alias("symbol"))  # one row, the dimension
    joined = cells.join(bars, ["t", "symbol"], "left")
    fill = [c for c in bars.columns if c not in ("t", "symbol")] if fill is None else fill
    return joined.select("t", "symbol", *((forward_fill(F.col(c)) if c in fill else F.col(c)).alias(c) for c in bars.columns if c not in ("t", "symbol")))


def forward_fill(x: Column, limit: int | None = None) -> Column:
    """The last value so far; with a limit, only up to so many rows after it."""
    last = F.last(x, True).over(history().rowsBetween(Window.unboundedPreceding, 0))
    return last if limit is None else F.when(F.count(x).over(history().rowsBetween(-limit, 0)) > 0, last)


def fill_both(x: Column) -> Column:
    """Forward, then backward: raw ingestion only, it looks ahead."""
    return F.coalesce(forward_fill(x), F.first(x, True).over(history().rowsBetween(0, Window.unboundedFollowing)))


def gate(panel: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    """NULL for all symbols where too few of a timestamp's symbols have a feature."""
    cs = Window.partitionBy("t")
    gated = {c: F.when(F.avg(F.col(c).isNotNull().cast("int")).over(cs) >= threshold, F.col(c)) for c in columns}
    return panel.withColumns(gated)


def labels(panel: DataFrame, horizons: list[int], price: str = "close") -> DataFrame:
    """y_logret_fwd_{h}h and y_ret_fwd_{h}h: returns over the next h bars, NULL where they run out."""
    out = {}
    for h in horizons:
        later = F.lead(price, h).over(history())
        out[f"y_logret_fwd_{h}h"] = F.ln(F.try_divide(later, F.col(price)))
        out[f"y_ret_fwd_{h}h"] = F.try_divide(later, F.col(price)) - 1
    return panel.withColumns(out)


def split(panel: DataFrame, train_end, val_end) -> DataFrame:
    """split: train before the first bound, val before the second, test after."""
    return panel.withColumn("split", F.when(F.col("t") < F.lit(train_end), "train").when(F.col("t") < F.lit(val_end), "val").otherwise("test"))


def union_schema(frames: list[DataFrame]) -> DataFrame:
    """All rows, all columns; a column that a frame lacks is NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def intersect_schema(frames: list[DataFrame]) -> DataFrame:
    """All rows, the columns that every frame has, in the first's order."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    out = frames[0].select(*common)
    for f in frames[1:]:
        out = out.unionByName(f.select(*common))
    return out


def fixed_schema(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly these columns and types, NULL where the input lacks one or a value does not convert."""
    return df.select(*((F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()))


def sanitize(names: list[str]) -> list[str]:
    """Feature names as identifiers: upper case, other characters as _, F_ before digits, _2 for a clash."""
    import re

    out: list[str] = []
    for name in names:
        base = re.sub(r"[^A-Z0-9]", "_", name.upper())
        base = f"F_{base}" if not base or base[0].isdigit() else base
        k, unique = 1, base
        while unique in out:
            k += 1
            unique = f"{base}_{k}"
        out.append(unique)
    return out


def quality_filter(panel: DataFrame, flags: dict[str, bool]) -> DataFrame:
    """Rows whose flags all have the wanted value; a missing flag counts as not set."""
    keep = F.lit(True)
    for name, wanted in flags.items():
        keep &= F.coalesce(F.col(name).cast("boolean"), F.lit(False)) == wanted
    return panel.where(keep)


def drop_duplicates(df: DataFrame, keys: list[str], order: list[Column], keep: str = "last") -> DataFrame:
    """One row for each key: the first or last by a total order."""
    ordered = [c.asc() if keep == "first" else c.desc() for c in order]
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*ordered))).where("_k = 1").drop("_k")


def margins(panel: DataFrame, dates: DataFrame, back: int, ahead: int) -> DataFrame:
    """Rows that have ``back`` bars before them and ``ahead`` after them on the calendar."""
    last = dates.count() - ahead
    numbered = dates.select("t", F.row_number().over(Window.orderBy("t")).alias("_i"))
    return panel.join(numbered.where((F.col("_i") > back) & (F.col("_i") <= last)).select("t"), "t", "left_semi")


def summary(panel: DataFrame) -> DataFrame:
    """symbol, n_rows, first_t, last_t."""
    return panel.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def universe(panel: DataFrame, coverage: DataFrame, end) -> DataFrame:
    """Rows of the symbols whose coverage record is ok and reaches ``end`` (symbol, status, max_ts)."""
    return panel.join(coverage.where((F.col("status") == "ok") & (F.col("max_ts") >= F.lit(end))), "symbol", "left_semi")


def append_new(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` and those rows of ``new`` that are later than their symbol's last old one."""
    last = old.groupBy("symbol").agg(F.max("t").alias("_last"))
    later = new.join(last, "symbol", "left").where(F.col("_last").isNull() | (F.col("t") > F.col("_last"))).drop("_last")
    return old.unionByName(later)
