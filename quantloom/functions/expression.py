"""The factor expression language: immutable trees over panel columns.

A tree says what to compute; :mod:`quantloom.plans.compiler` turns any number of trees into one
DataFrame plan. Missing values are NULL throughout: undefined quotients, logarithms and powers are
NULL, a rolling window with a NULL or without all its rows is NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class InvalidExpression(ValueError):
    """A tree that breaks the language's type rules, or text that is no expression."""


@dataclass(frozen=True)
class Expr:
    """A node; operators on nodes build larger trees."""

    def __add__(self, other):
        return Call("Add", (self, wrap(other)))

    def __radd__(self, other):
        return Call("Add", (wrap(other), self))

    def __sub__(self, other):
        return Call("Sub", (self, wrap(other)))

    def __rsub__(self, other):
        return Call("Sub", (wrap(other), self))

    def __mul__(self, other):
        return Call("Mul", (self, wrap(other)))

    def __rmul__(self, other):
        return Call("Mul", (wrap(other), self))

    def __truediv__(self, other):
        return Call("Div", (self, wrap(other)))

    def __rtruediv__(self, other):
        return Call("Div", (wrap(other), self))

    def __pow__(self, other):
        return Call("Pow", (self, wrap(other)))

    def __rpow__(self, other):
        return Call("Pow", (wrap(other), self))

    def __neg__(self):
        return Call("Sub", (Constant(0.0), self))

    def __abs__(self):
        return Call("Abs", (self,))

    @property
    def featured(self) -> bool:
        """Whether the value depends on a panel column."""
        return False

    @property
    def children(self) -> tuple[Expr, ...]:
        return ()


@dataclass(frozen=True)
class Feature(Expr):
    name: str

    featured = True

    def __str__(self):
        return f"${self.name}"


@dataclass(frozen=True)
class Constant(Expr):
    value: float

    def __str__(self):
        return f"Constant({self.value})"


@dataclass(frozen=True)
class Delta(Expr):
    """A number of bars; only the last argument of a rolling operator."""

    bars: int

    def __str__(self):
        return str(self.bars)


@dataclass(frozen=True)
class Call(Expr):
    op: str
    args: tuple[Expr, ...]

    @property
    def children(self):
        return tuple(a for a in self.args if not isinstance(a, Delta))

    @property
    def window(self) -> int | None:
        return self.args[-1].bars if isinstance(self.args[-1], Delta) else None

    @property
    def featured(self):
        each = [a.featured for a in self.children]
        return all(each) if self.op in ("Greater", "Less") else any(each)

    def __str__(self):
        return f"{self.op}({','.join(map(str, self.args))})"


def wrap(value) -> Expr:
    return value if isinstance(value, Expr) else Constant(float(value))


@dataclass(frozen=True)
class Operator:
    """``kind``: unary, binary, rolling, pair or cross (over all symbols of a time); how it becomes a column."""

    name: str
    kind: str
    build: object

    @property
    def arity(self) -> int:
        return {"unary": 1, "cross": 1, "binary": 2, "rolling": 2, "pair": 3}[self.kind]


REGISTRY: dict[str, Operator] = {}


def register_operator(name: str, kind: str, build) -> None:
    """Add an operator to the language.

    ``build`` gets columns (unary: x; binary: x, y), for rolling kinds also a :class:`Frame`, for cross a
    window over the time's symbols, and returns a column.
    """
    REGISTRY[name] = Operator(name, kind, build)


class Frame:
    """The last ``w`` rows of a symbol, and the guard that all of them are there."""

    def __init__(self, window, w: int, ddof: int):
        self.by_time, self.w, self.ddof = window, w, ddof
        self.rows = window.rowsBetween(-(w - 1), 0)

    def full(self, present: Column, value: Column) -> Column:
        return F.when(F.count(present).over(self.rows) == self.w, value)

    def agg(self, x: Column, value: Column) -> Column:
        return self.full(x, value.over(self.rows))

    def values(self, x: Column) -> Column:
        """The frame's values, oldest first."""
        return F.collect_list(x).over(self.rows)


def finite(x: Column) -> Column:
    """``x``, NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _each(values: Column, f) -> Column:
    return F.aggregate(F.transform(values, f), F.lit(0.0), lambda a, v: a + v)


def _weighted(weights):
    def build(x: Column, frame: Frame) -> Column:
        own = weights(frame.w)
        if own is None:
            return F.lit(None).cast("double")
        return frame.full(x, _each(F.arrays_zip(frame.values(x).alias("v"), F.array(*map(F.lit, own)).alias("k")), lambda p: p["v"] * p["k"]))

    return build


def _linear(w: int):
    total = w * (w - 1) / 2
    return [k / total for k in range(w)] if total else None


def _exponential(w: int):
    base = 1 - 2 / (1 + w)
    if base <= 0:
        return None
    raw = [base**k for k in range(w, 0, -1)]
    return [r / sum(raw) for r in raw]


def _median(x: Column, frame: Frame) -> Column:
    return frame.full(x, F.get(F.array_sort(frame.values(x)), F.lit((frame.w - 1) // 2)))


def _mean_deviation(x: Column, frame: Frame) -> Column:
    values, mean = frame.values(x), F.avg(x).over(frame.rows)
    return frame.full(x, _each(values, lambda v: F.abs(v - mean)) / frame.w)


def _rank(x: Column, frame: Frame) -> Column:
    values = frame.values(x)
    above, least = F.size(F.filter(values, lambda v: v > x)), F.size(F.filter(values, lambda v: v >= x))
    return frame.full(x, (above + least + F.when(least > above, 1).otherwise(0)) / F.lit(2.0 * frame.w))


def _both(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), 1)


def _corr(x: Column, y: Column, f: Frame) -> Column:
    cov = f.w * F.covar_pop(x, y).over(f.rows)
    scale = [f.w * F.var_pop(c).over(f.rows) for c in (x, y)]
    return f.full(_both(x, y), cov / F.when((scale[0] < 1e-6) | (scale[1] < 1e-6), F.lit(1.0)).otherwise(F.sqrt(scale[0] * scale[1])))


def _kurt(x: Column, f: Frame) -> Column:
    return f.agg(x, F.kurtosis(x)) if f.w < 1 else f.full(x, (F.kurtosis(x).over(f.rows) + 3) * ((f.w - 1) / f.w) ** 2 - 3)


def _cs_rank(x: Column, cs) -> Column:
    return F.when(x.isNotNull(), (F.row_number().over(cs.orderBy(x.asc_nulls_last(), "symbol")) - 1) / F.count(x).over(cs))


def _cs_zscore(x: Column, cs) -> Column:
    std = F.stddev_pop(x).over(cs)
    return (x - F.avg(x).over(cs)) / F.when(std > 1e-6, std).otherwise(1.0)


for _name, _build in {
    "Abs": F.abs,
    "Sign": F.signum,
    "Log": F.ln,
}.items():
    register_operator(_name, "unary", _build)
for _name, _build in {
    "Add": lambda a, b: a + b,
    "Sub": lambda a, b: a - b,
    "Mul": lambda a, b: a * b,
    "Div": lambda a, b: F.try_divide(a, b),
    "Pow": lambda a, b: finite(F.pow(a, b)),
    "Greater": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)),
    "Less": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)),
}.items():
    register_operator(_name, "binary", _build)
for _name, _build in {
    "Ref": lambda x, f: F.lag(x, f.w).over(f.by_time) if f.w >= 0 else F.lead(x, -f.w).over(f.by_time),
    "Mean": lambda x, f: f.agg(x, F.avg(x)),
    "Sum": lambda x, f: f.agg(x, F.sum(x)),
    "Std": lambda x, f: f.agg(x, F.stddev_samp(x) if f.ddof else F.stddev_pop(x)),
    "Var": lambda x, f: f.agg(x, F.var_samp(x) if f.ddof else F.var_pop(x)),
    "Skew": lambda x, f: f.agg(x, F.skewness(x)),
    "Kurt": _kurt,
    "Max": lambda x, f: f.agg(x, F.max(x)),
    "Min": lambda x, f: f.agg(x, F.min(x)),
    "Med": _median,
    "Mad": _mean_deviation,
    "Rank": _rank,
    "Delta": lambda x, f: x - F.lag(x, f.w).over(f.by_time),
    "WMA": _weighted(_linear),
    "EMA": _weighted(_exponential),
}.items():
    register_operator(_name, "rolling", _build)
register_operator("Cov", "pair", lambda x, y, f: f.full(_both(x, y), F.covar_samp(x, y).over(f.rows)))
register_operator("Corr", "pair", _corr)
register_operator("CSRank", "cross", _cs_rank)
register_operator("CSZScore", "cross", _cs_zscore)

#: Operator subsets: what the search proposes, and what factor files may use.
_NOT_IN_FILES = {"Sign", "CSRank", "CSZScore", "Skew", "Kurt", "Rank"}
PROFILES = {
    "all": lambda: set(REGISTRY),
    "search": lambda: set(REGISTRY) - _NOT_IN_FILES - {"Pow"},
    "factor_file": lambda: set(REGISTRY) - _NOT_IN_FILES,
}


def check(e: Expr, profile: str = "all") -> Expr:
    """``e`` if it follows the type rules; else :class:`InvalidExpression`."""
    allowed = PROFILES[profile]()

    def visit(node: Expr) -> None:
        if isinstance(node, Delta):
            raise InvalidExpression(f"{node} bars stand where a value is needed")
        if not isinstance(node, Call):
            return
        if node.op not in allowed:
            raise InvalidExpression(f"unknown operator {node.op}")
        op = REGISTRY[node.op]
        if len(node.args) != op.arity:
            raise InvalidExpression(f"{node.op} takes {op.arity} arguments")
        if op.kind in ("rolling", "pair"):
            if node.window is None:
                raise InvalidExpression(f"{node.op} needs a number of bars")
            if node.window < 1 and node.op != "Ref":
                raise InvalidExpression(f"{node.op} needs a window of a bar at least")
        for a in node.children:
            visit(a)
        own = [a.featured for a in node.children]
        if not (any(own) if op.kind == "binary" else all(own)):
            raise InvalidExpression(f"{node} has no panel column where one is needed")

    visit(e)
    return e


def features(e: Expr) -> set[str]:
    """The panel columns that a tree reads."""
    return {e.name} if isinstance(e, Feature) else set().union(*map(features, e.children))


def reach(e: Expr) -> tuple[int, int]:
    """Bars that a tree looks back and ahead: sums over nested windows."""
    back, ahead = (max((reach(c)[k] for c in e.children), default=0) for k in (0, 1))
    if isinstance(e, Call) and (w := e.window) is not None:
        if e.op in ("Ref", "Delta"):
            return (back + w, ahead) if w >= 0 else (back, ahead - w)
        return back + w - 1, ahead
    return back, ahead


def within(e: Expr, max_back: int, max_ahead: int) -> bool:
    """Whether history and future margins hold all that a tree looks at."""
    back, ahead = reach(e)
    return back <= max_back and ahead <= max_ahead
