"""Folds as aggregate expressions; each works in groupBy().agg() and over a window."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0))


def mean(x: Column) -> Column:
    """0 for no rows."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def variance(x: Column) -> Column:
    return F.var_pop(x)


def std_dev(x: Column) -> Column:
    return F.stddev_pop(x)


def span(x: Column) -> Column:
    return F.struct(F.min(x).alias("least"), F.max(x).alias("greatest"))


def power_sum(x: Column, k: float) -> Column:
    return F.sum(F.pow(x, F.lit(k)))


def the(x: Column) -> Column:
    """The value if all are equal (null counts as a value), else null."""
    return F.when((F.min(x) == F.max(x)) & (F.count(x) == F.count(F.lit(1))), F.min(x))


def every(p: Column) -> Column:
    return F.coalesce(F.bool_and(p), F.lit(True))


def some(p: Column) -> Column:
    return F.coalesce(F.bool_or(p), F.lit(False))


def first_by(x: Column, order: Column) -> Column:
    return F.min_by(x, order)


def last_by(x: Column, order: Column) -> Column:
    return F.max_by(x, order)


def find(x: Column, p: Column, order: Column) -> Column:
    """x of the first row that p holds for."""
    return F.min_by(F.when(p, x), F.when(p, order))


def count_distinct(x: Column) -> Column:
    return F.count_distinct(x)


def top(df: DataFrame, n: int, by: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """The first n rows of each key in the order of ``by``: ranked, with the rank limit pushed into each task."""
    if not keys:
        return df.orderBy(*by).limit(n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def rolling_hash(items: Column, base: int = 1_000_003, salt: int = 0) -> Column:
    """Polynomial hash of an array of whole numbers, mod 2**61 - 1 (kept in decimals, so it cannot overflow)."""
    modulus = (1 << 61) - 1
    step = lambda h, x: F.pmod(h * F.lit(base).cast("decimal(8,0)") + x.cast("decimal(19,0)"), F.lit(modulus).cast("decimal(19,0)")).cast("decimal(19,0)")
    return F.aggregate(items, F.lit(salt).cast("decimal(19,0)"), step).cast("long")


def filtered(f: Callable[[Column], Column], x: Column, p: Column) -> Column:
    """A fold over the rows that p holds for."""
    return f(F.when(p, x))


def mapped(f: Callable[[Column], Column], x: Column, g: Callable[[Column], Column]) -> Column:
    """A fold of g's values."""
    return f(g(x))


def product(x: Column) -> Column:
    """1 for no rows."""
    return F.coalesce(F.product(x), F.lit(1.0))


def maximum_by(x: Column, key: Column) -> Column:
    return F.max_by(x, key)


def minimum_by(x: Column, key: Column) -> Column:
    return F.min_by(x, key)


def span_by(x: Column, key: Column) -> Column:
    """The values of the least and the greatest key."""
    return F.struct(F.min_by(x, key).alias("least"), F.max_by(x, key).alias("greatest"))


def elem(x: Column, value: Column) -> Column:
    return some(x.eqNullSafe(value))


def not_elem(x: Column, value: Column) -> Column:
    return every(~x.eqNullSafe(value))


def lookup(key: Column, x: Column, value: Column, order: Column) -> Column:
    """x of the first row whose key is the value."""
    return find(x, key.eqNullSafe(value), order)


def find_index(index: Column, p: Column) -> Column:
    """The first position that p holds at."""
    return F.min(F.when(p, index))


def elem_index(index: Column, x: Column, value: Column) -> Column:
    return find_index(index, x.eqNullSafe(value))


def at_index(x: Column, index: Column, n: int) -> Column:
    """The value at position n, null if there is none."""
    return F.max(F.when(index == n, x))


def one(x: Column) -> Column:
    """The value, if there is exactly one row."""
    return F.when(F.count(F.lit(1)) == 1, F.max(x))


def to_list(x: Column, order: Column) -> Column:
    """All values in order (null too); a group's list must fit a row."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), x.alias("x")))), lambda s: s["x"])


def to_list_reversed(x: Column, order: Column) -> Column:
    return F.reverse(to_list(x, order))


def folded(x: Column, order: Column, zero: Column, step: Callable[[Column, Column], Column], right: bool = False) -> Column:
    """Any left (or right) fold over a group's values in order."""
    items = to_list_reversed(x, order) if right else to_list(x, order)
    return F.aggregate(items, zero, step)


def fold_maybes(x: Column, order: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """A left fold that is null as soon as a value is."""
    return F.when(F.count(x) == F.count(F.lit(1)), folded(x, order, zero, step))


def reduced(x: Column, order: Column, step: Callable[[Column, Column], Column]) -> Column:
    """A left fold without a start; null for no rows."""
    items = to_list(x, order)
    return F.aggregate(F.slice(items, F.lit(2), F.greatest(F.size(items), F.lit(1))), F.get(items, F.lit(0)), step)


def tee(f: Column, g: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Two folds over the same rows, joined."""
    return join(f, g)


def distribute(*folds: Column) -> Column:
    """All the folds' results in an array."""
    return F.array(*folds)


def partition(p: Column, yes: Callable[[Column], Column], no: Callable[[Column], Column], x: Column) -> Column:
    """struct(yes, no): one fold over the rows that p holds for, another over the others."""
    return F.struct(yes(F.when(p, x)).alias("yes"), no(F.when(~p, x)).alias("no"))


def unzip(a: Column, b: Column, f: Callable[[Column], Column], g: Callable[[Column], Column]) -> Column:
    """struct(first, second): a fold for each part of the pairs."""
    return F.struct(f(a).alias("first"), g(b).alias("second"))


def joined_text(x: Column, order: Column, separator: str = "") -> Column:
    """The monoid of text: all values one after another."""
    return F.array_join(to_list(x, order), separator)


def take_end_by_seq(x: Column, order: Column, items: Column, keep: bool = True) -> Column:
    """The values up to and with (or without) the first place where items have just come; Seq has it for lists that fit no row."""
    n = F.size(items)

    def taken(a: Column) -> Column:
        ends = F.filter(F.sequence(n, F.greatest(F.size(a), n)), lambda e: (e <= F.size(a)) & (F.slice(a, e - n + 1, n) == items))
        end = F.get(ends, F.lit(0))
        return F.slice(a, F.lit(1), F.coalesce(end if keep else end - n, F.size(a)))

    # the list is bound to a variable: what a lambda names from outside is made again for each of its items
    return F.get(F.transform(F.array(to_list(x, order)), taken), F.lit(0))


def count_end_by_seq(index: Column, matched: Column, n: int, keep: bool = True) -> Column:
    """How many values take_end_by_seq takes, from positions and where n items have just come."""
    return F.coalesce(find_index(index, matched) + 1 - (0 if keep else n), F.count(F.lit(1)))


def nub(x: Column, order: Column) -> Column:
    """Different values in the order of their first coming."""
    return F.array_distinct(to_list(x, order))


def many(df: DataFrame, segments: Sequence[str], inner: Sequence[Column], keys: Sequence[str], outer: Sequence[Column]) -> DataFrame:
    """A fold for each segment, and a fold over the segments' results."""
    return df.groupBy(*keys, *segments).agg(*inner).groupBy(*keys).agg(*outer)


def rolling_hash_first(items: Column, n: int, base: int = 1_000_003, salt: int = 0) -> Column:
    """rolling_hash of the first n items."""
    return rolling_hash(F.slice(items, F.lit(1), n), base, salt)


def folded_map(x: Column, order: Column, f: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """The values mapped and joined in order; null for no rows."""
    return reduced(f(x), order, join)


def drain(df: DataFrame) -> None:
    """Evaluates all rows and keeps none."""
    df.write.format("noop").mode("overwrite").save()
