"""The factor pool: admission, weights, gates and schedules.

The cluster computes information coefficients in batches; the pool holds at most its capacity of them
and is plain NumPy on the driver.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.operators.cross_section import ic_daily


def optimise(single: np.ndarray, mutual: np.ndarray, start: np.ndarray, l1: float = 5e-3, rate: float = 5e-4, patience: int = 500, most: int = 10_000) -> np.ndarray:
    """Weights that minimise w'Mw - 2w'r + 1 + l1 * |w| by adaptive moments.

    The penalty drives the steps but does not judge them: the weights right after the step taken at
    the smallest w'Mw - 2w'r + 1 are kept, and the search stops after ``patience`` steps in a row without
    a gain of 1e-6 in it. Without l1 the least-squares solution is exact; if there is none, the weights stay.
    """
    if l1 < 1e-6:
        try:
            return np.linalg.lstsq(mutual, single, rcond=None)[0]
        except (np.linalg.LinAlgError, ValueError):
            return start.copy()
    w, best, least, stale = start.astype(float).copy(), start.copy(), np.inf, 0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, most + 2):
        fit = w @ mutual @ w - 2 * w @ single + 1
        g = 2 * mutual @ w - 2 * single + l1 * np.sign(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        stale = 0 if least - fit > 1e-6 else stale + 1
        if fit < least:
            best, least = w.copy(), fit
        if stale >= patience:
            break
    return best


@dataclass
class Pool:
    """At most ``capacity`` expressions with weights."""

    capacity: int
    ic_lower: float = 0.0
    max_mutual: float = 0.99
    absolute: bool = False
    l1: float = 5e-3
    names: list[str] = field(default_factory=list)
    single: np.ndarray = field(default_factory=lambda: np.empty(0))
    mutual: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    failed: set[str] = field(default_factory=set)

    def _weak(self) -> bool:
        """Whether the pool has no member that reaches the bound by itself: any candidate is welcome then."""
        return not self.names or (len(self.names) == 1 and abs(self.single[0]) < self.ic_lower)

    def admits(self, ic: float | None, mutual: np.ndarray) -> bool:
        """Whether a candidate's own IC is high enough (or the pool is weak) and none of its mutual ones too high."""
        if ic is None or np.isnan(ic) or np.isnan(mutual).any():
            return False
        return (self._weak() or (abs(ic) if self.absolute else ic) >= self.ic_lower) and bool((mutual <= self.max_mutual).all())

    def _add(self, name: str, ic: float, mutual: np.ndarray) -> None:
        if len(self.names) == 1 and self._weak():
            self.drop(0)
            mutual = mutual[:0]
        n = len(self.names)
        grown = np.ones((n + 1, n + 1))
        grown[:n, :n] = self.mutual
        grown[n, :n] = grown[:n, n] = mutual
        self.names, self.single, self.mutual, self.weights = [*self.names, name], np.append(self.single, ic), grown, np.append(self.weights, ic)

    def offer(self, name: str, ic: float | None, mutual: np.ndarray) -> bool:
        """Add a candidate, refit if it is not alone, and drop the smallest weight if that is one too many. True if it stays.

        A sole member under the bound is replaced. If the refit gives the one too many the smallest
        weight, all weights stay as they were (the newcomer's is its IC) before one is dropped.
        """
        mutual = np.asarray(mutual, float)
        if name in self.names or not self.admits(ic, mutual):
            return False
        self._add(name, ic, mutual)
        if len(self.names) > 1:
            fitted = optimise(self.single, self.mutual, self.weights, self.l1)
            if int(np.abs(fitted).argmin()) != self.capacity:
                self.weights = fitted
            if len(self.names) > self.capacity:
                self.drop(int(np.abs(self.weights).argmin()))
        return name in self.names

    def load(self, members: list[tuple[str, float, np.ndarray]]) -> None:
        """Add given members (name, IC, mutual ICs with those before) whatever their ICs, then refit."""
        if len(self.names) + len(members) > self.capacity:
            raise ValueError("more members than the pool holds")
        for name, ic, mutual in members:
            self._add(name, ic, np.asarray(mutual, float))
        self.weights = optimise(self.single, self.mutual, self.weights, self.l1)

    def offer_if_better(self, name: str, ic: float | None, mutual: np.ndarray, objective: Callable[[Pool], float]) -> bool:
        """Offer a candidate and take it back unless ``objective`` of the pool rises; what failed once is not tried again."""
        if name in self.failed:
            return False
        before = (list(self.names), self.single.copy(), self.mutual.copy(), self.weights.copy())
        was = objective(self) if self.names else -np.inf
        if self.offer(name, ic, mutual) and objective(self) > was:
            return True
        self.names, self.single, self.mutual, self.weights = before
        self.failed.add(name)
        return False

    def drop(self, k: int) -> None:
        keep = np.arange(len(self.names)) != k
        self.names = [n for n, on in zip(self.names, keep, strict=True) if on]
        self.single, self.weights, self.mutual = self.single[keep], self.weights[keep], self.mutual[np.ix_(keep, keep)]

    def prune(self, k: int, by: str = "weight") -> None:
        """Keep the ``k`` best by |weight|, |IC| or |weight * IC|; ties by name."""
        value = {"weight": np.abs(self.weights), "ic": np.abs(self.single), "both": np.abs(self.weights * self.single)}[by]
        best = sorted(range(len(self.names)), key=lambda i: (-value[i], self.names[i]))[:k]
        for i in sorted(set(range(len(self.names))) - set(best), reverse=True):
            self.drop(i)

    def state(self) -> dict:
        return {"exprs": [*self.names], "weights": self.weights.tolist()}

    def result(self, ic: float, rank_ic: float) -> dict:
        """What a search writes at its end: the ensemble's IC and RankIC, the factors and their weights."""
        return {"ic": ic, "rank_ic": rank_ic, "factors": [*self.names], "weights": self.weights.tolist()}


def subset(panel: DataFrame, share: float, salt: str = "", since=None) -> DataFrame:
    """The panel of a seeded share of the symbols, from a timestamp on: what a cheap gate looks at."""
    kept = panel.where(F.pmod(F.xxhash64(F.lit(salt), F.col("symbol").cast("string")), F.lit(10_000)) < int(share * 10_000))
    return kept if since is None else kept.where(F.col("t") >= F.lit(since))


def gate(df: DataFrame, factor: str, target: str, lower: float, absolute: bool = True) -> bool:
    """Whether a factor's mean IC on a (sub)panel reaches a bound."""
    ic = ic_daily(df, factor, target).agg(F.avg("ic")).first()[0]
    return ic is not None and (abs(ic) if absolute else ic) >= lower


def robust_gate(df: DataFrame, factor: str, target: str, lower: float) -> bool:
    """Whether two disjoint halves of the symbols agree in sign and both reach a bound."""
    half = F.pmod(F.xxhash64(F.col("symbol").cast("string")), F.lit(2))
    found = [ic_daily(df.where(half == k), factor, target).agg(F.avg("ic")).first()[0] for k in (0, 1)]
    return None not in found and found[0] * found[1] > 0 and min(map(abs, found)) >= lower


def residual(target: str, weights: dict[str, float], top: int) -> Column:
    """The target less the ensemble of the ``top`` largest weights (by |w|, then name)."""
    best = sorted(weights, key=lambda c: (-abs(weights[c]), c))[:top]
    total = F.lit(0.0)
    for c in best:
        total = total + F.coalesce(F.col(c) * weights[c], F.lit(0.0))
    return F.col(target) - total


class RunningMean:
    """The mean of the last ``n`` values."""

    def __init__(self, n: int):
        self.last: deque[float] = deque(maxlen=n)

    def add(self, value: float) -> float:
        self.last.append(value)
        return sum(self.last) / len(self.last)


def linear_schedule(start: float, end: float, steps: int, warmup: int = 0) -> Callable[[int], float]:
    """A value that stays for ``warmup`` steps and then moves evenly to its end."""
    return lambda step: start + min(1.0, max(0.0, (step - warmup) / max(1, steps - warmup))) * (end - start)


def shape_reward(df: DataFrame, mode: str = "abs") -> DataFrame:
    """reward of a trial log (step, objective): its value, its gain over the best so far, or over the last."""
    from pyspark.sql import Window

    before = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    value = F.col("objective")
    gain = {"abs": value, "delta_best": F.greatest(value - F.coalesce(F.max(value).over(before), F.lit(0.0)), F.lit(0.0)), "delta_obj": value - F.coalesce(F.lag(value).over(Window.orderBy("step")), F.lit(0.0))}
    return df.withColumn("reward", gain[mode])
