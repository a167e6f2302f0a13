"""Joins and set operations of sequences, by their rules for duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in order: one aggregate, combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in order (distinct that keeps first occurrences)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def theta_join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Join by any condition; give an equality in it so that it need not be a nested loop."""
    return left.join(right, on, how)


#: Bytes of a side that is sent to every task, at most.
BROADCAST = 64 << 20


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs, which is the feature; the right side is sent whole only if its plan's size is below BROADCAST."""
    small = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST
    return left.crossJoin(F.broadcast(right) if small else right)


def map_join(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a right side that holds one row a key, the last; a full join does so on both sides."""
    if how == "full":
        left = last_of_each(left, keys, [c for c in order if c in left.columns])
    return left.join(last_of_each(right, keys, [c for c in order if c in right.columns]), list(keys), how)


def intersect_by(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left rows, duplicates too, that have an equal in the right."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_semi")


def delete_firsts(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left without its first n rows of each key, n times the key in right.

    Ranks within a key are only needed where right has the key.
    """
    from pyspark.sql import Window

    n = right.groupBy(*keys).agg(F.count("*").alias("__n"))
    joined = left.join(n, list(keys), "left")
    none = joined.filter("__n IS NULL").drop("__n")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return none.unionByName(joined.filter("__n IS NOT NULL").withColumn("__k", rank).filter("__k > __n").drop("__n", "__k"))


def union_by(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left as it is, then the first of each right key that left lacks; ``part`` tells them apart."""
    new = first_of_each(right.join(left.select(*keys).distinct(), list(keys), "left_anti"), keys, order)
    return left.withColumn("part", F.lit(0)).unionByName(new.withColumn("part", F.lit(1)).select(*left.columns, "part"))
