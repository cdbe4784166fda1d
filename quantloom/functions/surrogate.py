"""Numbers around the expression search: hashed features, surrogate scores, quantile moments, returns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is read off an expression's text, and the tags that are hashed.
OPERATOR = r"([A-Za-z_][A-Za-z0-9_]*)\("
COLUMN = r"\$([A-Za-z_][A-Za-z0-9_]*)"
INTEGER = r"(?:,|\()\s*(\d{1,5})\s*(?:\)|,)"
TAGS = ("len:", "ops_cnt:", "feats_cnt:", "op:", "feat:", "int:", "x:")


def feature_ids(expr: Column, dim: int) -> Column:
    """Sorted distinct hashed features of expression text: sizes, operators, columns, numbers and operator-column pairs."""
    found = lambda pattern: F.regexp_extract_all(expr, F.lit(pattern), 1)
    ops, cols, ints = found(OPERATOR), found(COLUMN), found(INTEGER)
    length, n_ops, n_cols, op, col, number, cross = TAGS
    tag = lambda name, x: F.transform(F.slice(x, 1, 64), lambda v: F.concat(F.lit(name), v))
    count = lambda name, n: F.concat(F.lit(name), n.cast("string"))
    sizes = F.array(
        count(length, F.least(F.lit(64), F.greatest(F.lit(1), F.floor(F.char_length(expr) / 8)))),
        count(n_ops, F.least(F.lit(32), F.size(ops))),
        count(n_cols, F.least(F.lit(32), F.size(cols))),
    )
    crossed = F.flatten(F.transform(F.slice(ops, 1, 8), lambda o: F.transform(F.slice(cols, 1, 8), lambda c: F.concat(F.lit(cross), o, F.lit("|"), c))))
    names = F.concat(sizes, tag(op, ops), tag(col, cols), tag(number, ints), crossed)
    return F.array_sort(F.array_distinct(F.transform(names, lambda s: (F.crc32(s.cast("binary")) % dim).cast("int"))))


def score(trials: DataFrame, weights: DataFrame, bias: float, dim: int) -> DataFrame:
    """expr, score: bias and the weights (id, w) of an expression's features."""
    rows = trials.select("expr").distinct().select("expr", F.explode(feature_ids(F.col("expr"), dim)).alias("id"))
    return rows.join(weights, "id", "left").groupBy("expr").agg((F.sum(F.coalesce("w", F.lit(0.0))) + bias).alias("score"))


def train(ids: list[list[int]], target: np.ndarray, dim: int, epochs: int = 5, rate: float = 0.1, l2: float = 1e-6, seed: int = 0) -> tuple[np.ndarray, float]:
    """Sparse linear weights by adaptive gradient steps in a seeded order: weights and bias."""
    w, g2, bias, gb, rng = np.zeros(dim, np.float32), np.zeros(dim, np.float32), 0.0, 0.0, np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(ids)):
            at = ids[k]
            error = float(w[at].sum()) + bias - float(target[k])
            grad = error + l2 * w[at]
            g2[at] += grad * grad
            w[at] -= rate * grad / (np.sqrt(g2[at]) + 1e-8)
            gb += error * error
            bias -= rate * error / (gb**0.5 + 1e-8)
    return w, bias


def normal_quantile(p: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    return np.array([NormalDist().inv_cdf(float(x)) for x in p])


def quantile_moments(quantiles: Column, n: int) -> Column:
    """std, skew, kurt of an array of ``n`` quantiles at (k + 0.5) / n, by regression on 1, z, z^2 - 1, z^3 - 3z."""
    z = normal_quantile((np.arange(n) + 0.5) / n)
    solve = np.linalg.pinv(np.column_stack([np.ones(n), z, z**2 - 1, z**3 - 3 * z]))
    dot = lambda row: F.aggregate(F.zip_with(quantiles, F.array(*map(F.lit, row.tolist())), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    b = [dot(r) for r in solve]
    return F.struct(b[0].alias("mean"), b[1].alias("std"), (6 * F.try_divide(b[2], b[1])).alias("skew"), (24 * F.try_divide(b[3], b[1]) + 3).alias("kurt"))


def huber(x: Column, k: float = 1.0) -> Column:
    return F.when(F.abs(x) <= k, 0.5 * x * x).otherwise(k * (F.abs(x) - 0.5 * k))


def quantile_huber(error: Column, tau: float, k: float = 1.0) -> Column:
    return F.abs(F.lit(tau) - (error < 0).cast("double")) * huber(error, k) / k


def n_step_return(rewards: Column, gamma: float) -> Column:
    """Sum of gamma^k * reward k of an array."""
    return F.aggregate(F.transform(rewards, lambda r, k: r * F.pow(F.lit(gamma), k)), F.lit(0.0), lambda a, x: a + x)
