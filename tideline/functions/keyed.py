"""Folds and scans by key, and functions of maps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..seq import Seq


def to_map(df: DataFrame, key: str, folded: Column, group: Sequence[str] = (), name: str = "map") -> DataFrame:
    """A map from each key to the fold of its rows, in one row (of each group): as many entries as there are keys."""
    each = df.groupBy(*group, key).agg(folded.alias("__v"))
    return each.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "__v")))).alias(name))


def kv_to_map(df: DataFrame, key: str, value: str, order: Column, group: Sequence[str] = (), name: str = "map") -> DataFrame:
    """The last value of each key."""
    return to_map(df, key, F.max_by(value, order), group, name)


def frequency(df: DataFrame, key: str, n: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(n))


def to_set(x: Column) -> Column:
    """Different values, sorted."""
    return F.sort_array(F.collect_set(x))


def classify(df: DataFrame, keys: Sequence[str], *folds: Column) -> DataFrame:
    """The same folds for each key."""
    return df.groupBy(*keys).agg(*folds)


def classify_scan(seq: Seq, name: str, f: Callable[[Column], Column], x: Column) -> DataFrame:
    """Every row with the fold of its key's rows so far."""
    return seq.df.withColumn(name, f(x).over(seq.upto()))


def demux(df: DataFrame, key: str, folds: Mapping[str, Column], name: str = "value") -> DataFrame:
    """For each key its own fold; keys without one are left out.  All folds must be of one type."""
    choice = None
    for k, f in folds.items():
        choice = F.when(F.col(key) == k, f) if choice is None else choice.when(F.col(key) == k, f)
    return df.filter(F.col(key).isin(*folds)).groupBy(key).agg(choice.alias(name))


def demux_or(df: DataFrame, key: str, folds: Mapping[str, Column], other: Column, name: str = "value") -> DataFrame:
    """For each key its own fold, and another one for keys without."""
    choice = other
    for k, f in folds.items():
        choice = F.when(F.col(key) == k, f).otherwise(choice)
    return df.groupBy(key).agg(choice.alias(name))


def demux_scan(seq: Seq, key: str, folds: Mapping[str, Column], name: str = "value") -> DataFrame:
    """Every row of a key that has a fold, with that fold so far."""
    choice = None
    for k, f in folds.items():
        over = f.over(seq.upto())
        choice = F.when(F.col(key) == k, over) if choice is None else choice.when(F.col(key) == k, over)
    return seq.df.withColumn(name, choice).filter(F.col(key).isin(*folds))


def demux_to_map(df: DataFrame, key: str, folds: Mapping[str, Column], name: str = "map") -> DataFrame:
    """demux in one row, as a map."""
    each = demux(df, key, folds, "__v")
    return each.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "__v")))).alias(name))


def nub_scan(seq: Seq, value: str) -> DataFrame:
    """The rows that bring a new value of their key."""
    out = seq.running_distinct("__n", value)
    return seq.like(out).uniq("__n").filter(F.col("__n") > 0).drop("__n")


# maps


def insert(m: Column, k: Column, v: Column) -> Column:
    """The entry put in, or put in place of that key's."""
    return F.map_concat(delete(m, k), F.create_map(k, v))


def delete(m: Column, k: Column) -> Column:
    return F.map_filter(m, lambda x, _: x != k)


def alter(m: Column, k: Column, f: Callable[[Column], Column]) -> Column:
    """The key's value (null if it has none) replaced by f's; null deletes it."""
    new = f(F.try_element_at(m, k))
    return F.when(new.isNull(), delete(m, k)).otherwise(F.map_concat(delete(m, k), F.create_map(k, new)))


def union(a: Column, b: Column) -> Column:
    """Entries of both, a's where both have the key."""
    return F.map_concat(F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k)), a)


def is_empty(m: Column) -> Column:
    return F.size(m) == 0


def traverse(m: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Every value replaced by f of key and value."""
    return F.transform_values(m, f)
