"""Feature-matrix checks, pruning and scaling."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, coverage, std, all_null, in one pass."""
    cells = df.agg(*(F.struct(F.lit(c).alias("feature"), F.avg(F.col(c).isNotNull().cast("double")).alias("coverage"), F.stddev_samp(c).alias("std"), (F.count(c) == 0).alias("all_null")).alias(f"c{k}") for k, c in enumerate(columns)))
    return cells.select(F.explode(F.array(*(f"c{k}" for k in range(len(columns))))).alias("r")).select("r.*")


def _moments(columns: list[str], center: list[float]):
    """A mapInArrow function: sums over a partition's rows that both columns of a pair have, as matrix products."""
    upper = np.triu_indices(len(columns), 1)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(upper[0])))
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns]) - center
            there = ~np.isnan(x)
            m, x = there.astype(float), np.where(there, x, 0.0)
            total += np.stack([y[upper] for y in (m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x)])
        yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), *map(pa.array, total)], ["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    return of


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, corr of every pair over the rows that have both; NULL without spread.

    Two passes: the columns' means, around which sums stay exact, and then all pairs at once as matrix
    products in each partition, so a hundred columns and more make no larger plan than two.
    """
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, corr double")
    doubles = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    mean = doubles.agg(*(F.avg(c).alias(c) for c in columns)).first()
    sums = doubles.mapInArrow(_moments(columns, [mean[c] or 0.0 for c in columns]), "i long, j long, n double, x double, y double, xx double, yy double, xy double")
    s = sums.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")))
    cov = F.col("xy") - F.try_divide(F.col("x") * F.col("y"), F.col("n"))
    vx, vy = (F.col(f"{c}{c}") - F.try_divide(F.col(c) * F.col(c), F.col("n")) for c in ("x", "y"))
    spread = (vx > EPS * F.col("xx")) & (vy > EPS * F.col("yy"))
    name = F.array(*map(F.lit, columns))
    return s.select(F.get(name, F.col("i").cast("int")).alias("a"), F.get(name, F.col("j").cast("int")).alias("b"), F.when(spread, cov / (F.sqrt(vx) * F.sqrt(vy))).alias("corr"))


def _matrix(df: DataFrame, columns: list[str]) -> dict[frozenset, float]:
    return {frozenset((r["a"], r["b"])): abs(r["corr"]) for r in correlations(df, columns).collect() if r["corr"] is not None}


def prune_greedy(df: DataFrame, columns: list[str], min_coverage: float = 0.5, max_corr: float = 0.95) -> list[dict]:
    """feature, kept, reason: columns by coverage, then name; thin, constant and too alike ones go."""
    stat = {r["feature"]: r for r in coverage(df, columns).collect()}
    like, kept, out = _matrix(df, columns), [], []
    for c in sorted(columns, key=lambda c: (-stat[c]["coverage"], c)):
        if stat[c]["coverage"] < min_coverage:
            reason = "coverage"
        elif not stat[c]["std"] or stat[c]["std"] <= EPS:
            reason = "constant"
        elif any(like.get(frozenset((c, k)), 0.0) > max_corr for k in kept):
            reason = "correlated"
        else:
            reason = ""
            kept.append(c)
        out.append({"feature": c, "kept": not reason, "reason": reason})
    return out


def prune_pairwise(df: DataFrame, columns: list[str], min_coverage: float = 0.3, max_corr: float = 0.95) -> list[dict]:
    """The older rule: of each pair that is too alike, in column order, the thinner one goes."""
    stat = {r["feature"]: r for r in coverage(df, columns).collect()}
    gone = {c for c in columns if stat[c]["coverage"] < min_coverage}
    like = _matrix(df, columns)
    for a, b in combinations(columns, 2):
        if a not in gone and b not in gone and like.get(frozenset((a, b)), 0.0) > max_corr:
            gone.add(a if stat[a]["coverage"] < stat[b]["coverage"] else b)
    return [{"feature": c, "kept": c not in gone} for c in columns]


def top_partners(corr: DataFrame) -> DataFrame:
    """feature, partner, corr: each column's most correlated other (ties: the smaller name)."""
    both = corr.unionByName(corr.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")).where("corr is not null")
    first = F.max_by(F.struct("b", "corr"), F.struct(F.abs("corr"), F.transform(F.split("b", ""), lambda ch: -F.ascii(ch))))
    return both.groupBy(F.col("a").alias("feature")).agg(first.alias("r")).select("feature", F.col("r.b").alias("partner"), "r.corr")


def audit(corr: DataFrame, kept: list[str]) -> DataFrame:
    """max_corr, n_pairs among kept columns."""
    return corr.where(F.col("a").isin(kept) & F.col("b").isin(kept)).agg(F.max(F.abs("corr")).alias("max_corr"), F.count(F.lit(1)).alias("n_pairs"))


def winsor_zscore(df: DataFrame, columns: list[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Columns clipped at a symbol's quantiles (linear), then z-scored by population deviation; NULL without spread."""
    bounds = df.groupBy("symbol").agg(*(F.percentile(c, [low, high]).alias(f"_q{k}") for k, c in enumerate(columns)))
    clip = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_q{k}")[0]), F.col(f"_q{k}")[1])) for k, c in enumerate(columns)}
    clipped = df.join(bounds, "symbol").withColumns(clip).select(*df.columns)
    stat = clipped.groupBy("symbol").agg(*(f(c).alias(f"_{n}{k}") for k, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = {c: F.when(F.col(f"_s{k}") > 0, (F.col(c) - F.col(f"_m{k}")) / (F.col(f"_s{k}") + EPS)) for k, c in enumerate(columns)}
    return clipped.join(stat, "symbol").withColumns(z).select(*df.columns)


def nan_ratio(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, nan_ratio."""
    return coverage(df, columns).select("feature", (1 - F.col("coverage")).alias("nan_ratio"))


def low_information(df: DataFrame, columns: list[str], share: float = 0.8) -> DataFrame:
    """feature, flat_share, low_info: the share of symbols in which a column has no spread."""
    per = df.groupBy("symbol").agg(*((F.coalesce(F.stddev_pop(c), F.lit(0.0)) <= 0).cast("double").alias(c) for c in columns))
    one = per.agg(*(F.avg(c).alias(c) for c in columns))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("flat_share")) for c in columns))).alias("r")).select("r.*")
    return rows.withColumn("low_info", F.col("flat_share") > share)


def dynamic_score(df: DataFrame, weights: dict[str, float], absolute: bool = True) -> DataFrame:
    """score: weighted mean of the columns that are there (over |w|, or w), NULL if their weights don't sum over 0; n_used."""
    there = [(F.col(c), w) for c, w in weights.items()]
    total = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in there), F.lit(0.0))
    under = sum((F.when(x.isNotNull(), abs(w) if absolute else w).otherwise(0.0) for x, w in there), F.lit(0.0))
    used = sum((x.isNotNull().cast("int") for x, _ in there), F.lit(0))
    return df.withColumns({"score": F.when(under > 0, total / under), "n_used": used})


def hash_sample(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """The same ``n`` rows for the same seed, whatever the file order."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)
