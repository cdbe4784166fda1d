"""From expression trees to one DataFrame plan.

Equal subtrees of all expressions are computed once. Windowed nodes become columns in stages: a stage
holds all nodes that are ready and share a window key (a symbol's history, or a time's symbols), so
Spark plans one exchange and one sort for each change of the key and none for deeper nesting under
one key. Scalar nodes stay inside the expressions that use them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.expression import REGISTRY, Call, Constant, Expr, Feature, Frame, check, features, reach

#: The trainer's profile divides by n, all others by n - 1.
DDOF = {"default": 1, "training": 0}


def _kind(e: Expr) -> str | None:
    """The window key of a node: time-series, cross-section, or none."""
    if not isinstance(e, Call):
        return None
    return {"rolling": "ts", "pair": "ts", "cross": "cs"}.get(REGISTRY[e.op].kind)


def _windowed(e: Expr, found: dict[Expr, None]) -> None:
    for c in e.children:
        _windowed(c, found)
    if _kind(e):
        found[e] = None


def stages(exprs: list[Expr]) -> list[tuple[str, list[Expr]]]:
    """The windowed nodes in stages: (key, nodes), each stage after all that it uses."""
    todo: dict[Expr, None] = {}
    for e in exprs:
        _windowed(e, todo)
    done: set[Expr] = set()

    def ready(e: Expr) -> bool:
        below: dict[Expr, None] = {}
        for c in e.children:
            _windowed(c, below)
        return done.issuperset(below)

    out, key = [], "ts"
    while todo:
        batch = [e for e in todo if _kind(e) == key and ready(e)]
        if not batch:
            key = "cs" if key == "ts" else "ts"
            continue
        out.append((key, batch))
        done.update(batch)
        for e in batch:
            del todo[e]
    return out


def evaluate(panel: DataFrame, exprs: dict[str, Expr], ddof: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """t, symbol, ``keep`` and one column for each expression over a dense panel (t, symbol, columns)."""
    for e in exprs.values():
        check(e)
    ts, cs = Window.partitionBy("symbol").orderBy("t"), Window.partitionBy("t")
    staged: dict[Expr, str] = {}

    def column(e: Expr) -> Column:
        if e in staged:
            return F.col(staged[e])
        if isinstance(e, Feature):
            return F.col(f"`{e.name}`")
        if isinstance(e, Constant):
            return F.lit(e.value)
        args, op = [column(a) for a in e.children], REGISTRY[e.op]
        if op.kind in ("rolling", "pair"):
            return op.build(*args, Frame(ts, e.window, ddof))
        return op.build(*args, cs) if op.kind == "cross" else op.build(*args)

    used = sorted(set().union(*map(features, exprs.values())) | set(keep))
    df = panel.select("t", "symbol", *(f"`{c}`" for c in used))
    for key, nodes in stages([*exprs.values()]):
        names = [f"_{key}{len(staged) + k}" for k in range(len(nodes))]
        df = df.select("*", *(column(e).alias(n) for e, n in zip(nodes, names, strict=True)))
        staged |= dict(zip(nodes, names, strict=True))
    return df.select("t", "symbol", *(f"`{c}`" for c in keep), *(column(e).alias(n) for n, e in exprs.items()))


def between(panel: DataFrame, calendar: DataFrame, exprs: dict[str, Expr], start, end, **more) -> DataFrame:
    """The rows of ``start`` to ``end`` only, reading no more of the panel than they look at.

    ``calendar`` holds every bar's t. The first and last bar to read are found by counting bars, not by
    the clock, and are pushed to the scan as plain comparisons.
    """
    back = max((reach(e)[0] for e in exprs.values()), default=0)
    ahead = max((reach(e)[1] for e in exprs.values()), default=0)
    t = F.col("t")
    first = calendar.where(t < F.lit(start)).orderBy(t.desc()).limit(max(1, back)).agg(F.min("t")).first()[0] if back else None
    last = calendar.where(t > F.lit(end)).orderBy(t).limit(max(1, ahead)).agg(F.max("t")).first()[0] if ahead else None
    read = panel.where(t.between(F.lit(first if first is not None else start), F.lit(last if last is not None else end)))
    return evaluate(read, exprs, **more).where(t.between(F.lit(start), F.lit(end)))
