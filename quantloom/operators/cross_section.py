"""Per-timestamp normalisation, information coefficients and ensembles."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.windows import cross, history


def zscore(x: Column, policy: str = "guard") -> Column:
    """Over a timestamp's symbols, by population deviation.

    strict: NULL where it is 0; guard: 0 counts as 1; eps: up to 1e-6 counts as 1; zero: guard, and NULL becomes 0.
    """
    std = F.stddev_pop(x).over(cross())
    over = x - F.avg(x).over(cross())
    if policy == "strict":
        return F.try_divide(over, std)
    z = over / F.when(std > (1e-6 if policy == "eps" else 0.0), std).otherwise(1.0)
    return F.coalesce(z, F.lit(0.0)) if policy == "zero" else z


def average_rank(x: Column) -> Column:
    """0-based ranks over a timestamp's symbols, equal values sharing their mean rank."""
    ties = F.count(x).over(Window.partitionBy("t", x))
    return F.when(x.isNotNull(), F.rank().over(cross().orderBy(x.asc_nulls_last())) - 1 + (ties - 1) / 2)


def pairwise(df: DataFrame, x: str, y: str) -> DataFrame:
    """t, x, y, both NULL where one is."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.select("t", F.when(both, F.col(x)).alias("x"), F.when(both, F.col(y)).alias("y"))


def _ic(x, y) -> Column:
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.covar_pop(x, y) / F.when((sx < 1e-3) | (sy < 1e-3), F.lit(1.0)).otherwise(sx * sy)


def ic_daily(df: DataFrame, x: str, y: str) -> DataFrame:
    """t, n, ic of each timestamp over pairs that are there; deviations under 1e-3 leave the covariance as it is."""
    return pairwise(df, x, y).groupBy("t").agg(F.count("x").alias("n"), _ic("x", "y").alias("ic"))


def rank_ic_daily(df: DataFrame, x: str, y: str) -> DataFrame:
    """The same of average ranks among the pairs."""
    p = pairwise(df, x, y)
    return ic_daily(p.select("t", average_rank(F.col("x")).alias("x"), average_rank(F.col("y")).alias("y")), "x", "y")


def ic_mean(daily: DataFrame, strict: bool = False) -> DataFrame:
    """mean_ic; strict: NULL if a timestamp has none."""
    mean = F.avg("ic")
    return daily.agg((F.when(F.count("ic") == F.count(F.lit(1)), mean) if strict else mean).alias("mean_ic"))


def icir(daily: DataFrame) -> DataFrame:
    """mean_ic, ic_std (n - 1) and their ratio."""
    return daily.agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("ic_std"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("icir"))


def ic_screen(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """feature, ic: means over timestamps with two pairs or more and some spread, for all columns in one pass."""
    long = df.select("t", F.col(target).alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in columns))).alias("f"))
    good = long.select("t", "y", "f.*").where("x is not null and y is not null")
    daily = good.groupBy("feature", "t").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return daily.where("n >= 2 and sx > 0 and sy > 0").groupBy("feature").agg(F.avg(F.col("c") / (F.col("sx") * F.col("sy"))).alias("ic"))


def mutual_ic(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, ic for each pair of columns: all daily coefficients in one aggregation by t."""
    pairs = [*combinations(columns, 2)]
    both = {k: F.col(a).isNotNull() & F.col(b).isNotNull() for k, (a, b) in enumerate(pairs)}
    daily = df.groupBy("t").agg(*(_ic(F.when(both[k], F.col(a)), F.when(both[k], F.col(b))).alias(f"p{k}") for k, (a, b) in enumerate(pairs)))
    mean = daily.agg(*(F.avg(f"p{k}").alias(f"p{k}") for k in range(len(pairs))))
    return mean.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{k}").alias("ic")) for k, (a, b) in enumerate(pairs)))).alias("r")).select("r.*")


def ensemble(weights: dict[str, float], policy: str = "guard", missing: str = "skip") -> Column:
    """Weighted sum of z-scores; a missing one counts 0, NULL only if all are missing (``missing="zero"``: never)."""
    z = {c: zscore(F.col(c), policy) for c in weights}
    total = reduce(lambda a, b: a + b, (F.coalesce(w * z[c], F.lit(0.0)) for c, w in weights.items()))
    return total if missing == "zero" else F.when(F.coalesce(*(F.col(c) for c in weights)).isNotNull(), total)


def pool_ic(df: DataFrame, weights: dict[str, float], target: str, policy: str = "guard", missing: str = "skip") -> DataFrame:
    """ic, rank_ic: mean daily coefficients of the weighted ensemble with a target."""
    scored = df.select("t", "symbol", ensemble(weights, policy, missing).alias("x"), F.col(target).alias("y"))
    ic, rank = (ic_mean(f(scored, "x", "y")) for f in (ic_daily, rank_ic_daily))
    both = ic.select(F.lit("ic").alias("k"), "mean_ic").unionByName(rank.select(F.lit("rank_ic").alias("k"), "mean_ic"))
    return both.agg(F.max(F.when(F.col("k") == "ic", F.col("mean_ic"))).alias("ic"), F.max(F.when(F.col("k") == "rank_ic", F.col("mean_ic"))).alias("rank_ic"))


def turnover(df: DataFrame, score: str) -> DataFrame:
    """turnover: mean absolute change of a score over a symbol's consecutive bars."""
    return df.select(F.abs(F.col(score) - F.lag(score).over(history())).alias("d")).agg(F.avg("d").alias("turnover"))


def mean_std(daily: DataFrame, beta: float | None = None) -> DataFrame:
    """objective: mean over deviation of a daily coefficient, or its lower confidence bound mean - beta * deviation."""
    mean, std = F.avg("ic"), F.stddev_samp("ic")
    return daily.agg((F.try_divide(mean, std) if beta is None else mean - beta * std).alias("objective"))


def top_features(df: DataFrame, columns: list[str], target: str, k: int, max_mutual: float, ensure: tuple[str, ...] = ()) -> list[str]:
    """Columns by |IC|, skipping those too like a chosen one; ``ensure`` come first.

    Two aggregations on the cluster; the greedy choice sees one number for each column and pair.
    """
    ic = {r["feature"]: r["ic"] for r in ic_screen(df, columns, target).collect()}
    like = {frozenset((r["a"], r["b"])): r["ic"] for r in mutual_ic(df, columns).collect()} if len(columns) > 1 else {}
    chosen = [c for c in ensure if c in columns]
    for c in sorted((c for c in columns if c not in chosen and ic.get(c) is not None), key=lambda c: (-abs(ic[c]), c)):
        if len(chosen) < k and all(abs(like.get(frozenset((c, d))) or 0) < max_mutual for d in chosen):
            chosen.append(c)
    return chosen[: max(k, len(ensure))]
