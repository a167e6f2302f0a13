"""Scans over sliding windows and from the start, as columns over a keyed Seq's windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..seq import Seq

Fold = Callable[[Column], Column]


def sliding(seq: Seq, n: int, f: Fold, x: Column) -> Column:
    """A fold over the last n rows."""
    return f(x).over(seq.last(n))


def cumulative(seq: Seq, f: Fold, x: Column) -> Column:
    return f(x).over(seq.upto())


def rolling(seq: Seq, n: int, f: Callable[[Column, Column], Column], x: Column) -> Column:
    """f of the value n rows before (null if there is none) and this one."""
    return f(F.lag(x, n).over(seq.by()), x)


def insertions(seq: Seq, n: int, x: Column) -> tuple[Column, Column]:
    """What enters the window of n rows with this row, and what leaves it."""
    return x, F.lag(x, n).over(seq.by())


def incremental(seq: Seq, n: int, x: Column) -> Column:
    """The window's sum by what enters and leaves, as a running sum of the differences."""
    entered, left = insertions(seq, n, x)
    return F.sum(x).over(seq.upto()) - F.coalesce(F.sum(x).over(seq.by().rowsBetween(Window.unboundedPreceding, -n)), F.lit(0))


def power_sum(seq: Seq, n: int, k: float, x: Column) -> Column:
    return F.sum(F.pow(x, F.lit(k))).over(seq.last(n))


def span(seq: Seq, n: int, x: Column) -> Column:
    """struct(least, greatest) of the window."""
    w = seq.last(n)
    return F.struct(F.min(x).over(w).alias("least"), F.max(x).over(w).alias("greatest"))


def ring(seq: Seq, n: int, x: Column) -> Column:
    """The last n values, oldest first."""
    return F.collect_list(x).over(seq.last(n))


def folded_ring(seq: Seq, n: int, x: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Any fold over the window's values, oldest first; the window bounds its cost."""
    return F.aggregate(ring(seq, n, x), zero, step)


def full(seq: Seq, n: int, value: Column) -> Column:
    """The value where the window has n rows, else null."""
    return F.when(F.count(F.lit(1)).over(seq.last(n)) == n, value)


def prescan(seq: Seq, f: Fold, x: Column, zero: Column) -> Column:
    """The fold of the rows before, zero at the first."""
    return F.coalesce(f(x).over(seq.by().rowsBetween(Window.unboundedPreceding, -1)), zero)


def scan_right(seq: Seq, f: Fold, x: Column) -> Column:
    """The fold of this row and all after it."""
    return f(x).over(seq.by().rowsBetween(0, Window.unboundedFollowing))


def scan_maybe(seq: Seq, f: Fold, x: Column, p: Column) -> Column:
    """A running fold over the rows that p holds for; null at the others."""
    return F.when(p, f(F.when(p, x)).over(seq.upto()))
