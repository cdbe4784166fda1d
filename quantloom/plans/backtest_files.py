"""From a factor file and price files to curves and summaries in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.expression import features, reach
from quantloom.functions.parser import parse
from quantloom.operators import backtest, cross_section, panel
from quantloom.plans.compiler import evaluate
from quantloom.sources import files


def run(
    spark: SparkSession, factor_file: str, prices: str, start=None, end=None, timeframe: str = "1h", horizon: int = 1, symbols: str | list[str] = "all",
    long: float = 0.2, short: float = 0.2, gross: float = 1.0, cost_bps: float = 0.0, min_coverage: float = 0.5, factor_coverage: float = 0.0,
    quantiles: int = 0, top: int = 5, bottom: int = 5, time: str = "datetime",
) -> dict[str, DataFrame]:
    """curve and summary of the weighted factors as a long/short portfolio; with ``quantiles``, also quantiles and quantile_summary.

    Only the columns that the factors name (and close) are read. The score is the weighted sum of strict
    z-scores over the symbols of a bar. Bars from ``start`` to ``end`` (both included) count; the
    bars that the factors look back at and the horizon looks ahead at are read as well.
    """
    named = files.read_factors(factor_file)
    trees = {f"_e{k}": parse(text) for k, (text, _) in enumerate(named)}
    weights = {f"_e{k}": w for k, (_, w) in enumerate(named)}
    columns = sorted(set().union(*map(features, trees.values())) | {"close"})
    rows = files.read_panel(spark, prices, columns, time)
    if symbols != "all":
        rows = rows.join(files.resolve_symbols(rows, symbols).select("symbol"), "symbol", "left_semi")
    dates = panel.calendar(rows, min_coverage, "backtest")
    inside = [F.col("t") >= F.lit(start)] * (start is not None) + [F.col("t") <= F.lit(end)] * (end is not None)
    back, ahead = max((reach(e)[0] for e in trees.values()), default=0), max([horizon, *(reach(e)[1] for e in trees.values())])
    low = dates.where(F.col("t") < F.lit(start)).orderBy(F.desc("t")).limit(back).agg(F.min("t")).first()[0] if start is not None and back else start
    high = dates.where(F.col("t") > F.lit(end)).orderBy("t").limit(ahead).agg(F.max("t")).first()[0] if end is not None and ahead else end
    for bound, keep in ((low if low is not None else start, lambda b: F.col("t") >= F.lit(b)), (high if high is not None else end, lambda b: F.col("t") <= F.lit(b))):
        if bound is not None:
            rows, dates = rows.where(keep(bound)), dates.where(keep(bound))
    dense = panel.densify(rows, dates)
    if factor_coverage > 0:
        dense = panel.gate(dense, [c for c in columns if c != "close"], factor_coverage)
    scored = evaluate(dense, trees, keep=("close",)).withColumn("score", cross_section.ensemble(weights, "strict"))
    scored = backtest.forward_return(scored.select("t", "symbol", "close", "score"), horizon)
    for c in inside:
        scored = scored.where(c)
    per_year = backtest.periods_per_year(timeframe)
    curve = backtest.long_short_curve(backtest.long_short_weights(scored, long, short, gross), cost_bps)
    out = {"curve": curve, "summary": backtest.summarise(curve, F.col("net"), per_year, F.col("turnover"))}
    if quantiles:
        spreads = backtest.quantile_spreads(backtest.quantile_returns(scored, quantiles), quantiles, top, bottom)
        out |= {"quantiles": spreads, "quantile_summary": backtest.summarise(backtest.equity(spreads, "spread"), F.col("spread"), per_year)}
    return out
