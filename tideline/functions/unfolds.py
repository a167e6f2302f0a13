"""Generators of a row's items: columns that give arrays, for ``expand.concat_map`` and its like."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays

Each = Callable[[Column], Column]


def none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def one(x: Column) -> Column:
    return F.array(x)


def optional(x: Column) -> Column:
    """The value, or nothing for null."""
    return F.when(x.isNotNull(), F.array(x)).otherwise(F.slice(F.array(x), 1, 0))


def both(a: Column, b: Column) -> Column:
    """The parts of a pair."""
    return F.array(a, b)


def replicated(x: Column, n: Column | int) -> Column:
    return F.array_repeat(x, n)


def from_indices(n: Column, f: Each) -> Column:
    """f of 0 to n - 1."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n.cast("long") - 1, F.lit(0).cast("long"))), f))


def enumerated(start: Column, end: Column) -> Column:
    """From start up to end; nothing if end is smaller."""
    return F.when(start <= end, F.sequence(start, F.greatest(start, end))).otherwise(F.slice(F.array(start), 1, 0))


def enumerated_then(start: Column, then: Column, end: Column) -> Column:
    """start, then, ... up or down to end; nothing if end lies the other way."""
    step = then - start
    there = ((step > 0) & (end >= start)) | ((step < 0) & (end <= start))
    return F.when(there, F.sequence(start, F.when(there, end).otherwise(start), F.when(there, step).otherwise(F.lit(1)))).otherwise(F.slice(F.array(start), 1, 0))


def iterated(seed: Column, n: int, step: Each) -> Column:
    """seed, step(seed), ... (n items)."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), F.array(seed), lambda a, _: F.concat(a, F.array(step(F.element_at(a, -1))))) if n > 1 else F.slice(F.array(seed), 1, n)


def unfolded(seed: Column, most: int, more: Each, value: Each, step: Each, kind: str = "bigint") -> Column:
    """value(s), s = step(s) as long as more(s), and at most so many items."""
    start = F.struct(seed.alias("s"), F.array().cast(f"array<{kind}>").alias("out"))
    grown = lambda a, _: F.when(more(a["s"]), F.struct(step(a["s"]).alias("s"), F.concat(a["out"], F.array(value(a["s"]).cast(kind))).alias("out"))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, grown, lambda a: a["out"])


def take_while(a: Column, p: Each) -> Column:
    rest = F.size(arrays.drop_while(a, p))
    return F.slice(a, F.lit(1), F.size(a) - rest)


def with_input(a: Column, x: Column, name: str = "input") -> Column:
    """Each item with what it came from."""
    return F.transform(a, lambda y: F.struct(x.alias(name), y.alias("item")))


def cons_input(a: Column, x: Column) -> Column:
    """The input itself, then its items."""
    return F.concat(F.array(x), a)


def scanned(a: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """All states of a left fold over the items, zero first."""
    return F.aggregate(a, F.array(zero), lambda s, x: F.concat(s, F.array(step(F.element_at(s, -1), x))))


def crossed(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of all pairs, the second part changing fastest."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: f(x, y))))


def fairly_crossed(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of all pairs, diagonal by diagonal."""
    pairs = F.flatten(F.transform(a, lambda x, i: F.transform(b, lambda y, j: F.struct((i + j).alias("d"), i.alias("i"), f(x, y).alias("v")))))
    return F.transform(F.array_sort(pairs), lambda p: p["v"])


def zipped(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of the items at the same places, as long as both have one."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), f)


def each(a: Column, f: Each) -> Column:
    """The items of every item."""
    return F.flatten(F.transform(a, f))


def each_interleaved(a: Column, f: Each) -> Column:
    """The items of every item: all first ones, then all second ones, and so on."""
    inner = F.flatten(F.transform(a, lambda x, i: F.transform(f(x), lambda y, j: F.struct(j.alias("j"), i.alias("i"), y.alias("v")))))
    return F.transform(F.array_sort(inner), lambda p: p["v"])
