"""The window keys that operators share (made when used: a session must be there by then)."""

from __future__ import annotations

from pyspark.sql import Window, WindowSpec


def history() -> WindowSpec:
    """A symbol's rows in time."""
    return Window.partitionBy("symbol").orderBy("t")


def whole() -> WindowSpec:
    """All rows of a symbol."""
    return Window.partitionBy("symbol")


def cross() -> WindowSpec:
    """All symbols of a time."""
    return Window.partitionBy("t")


def by_time() -> WindowSpec:
    """Bars in time, one row each: the only step that runs in one task."""
    return Window.orderBy("t")


def in_hour() -> WindowSpec:
    """The minutes of a symbol's hour."""
    return Window.partitionBy("symbol", "h")


def by_minute() -> WindowSpec:
    return in_hour().orderBy("t")
