"""Expansion: flat maps, orders of nested rows, recursion."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concat_map(df: DataFrame, items: Column, value: str = "value", at: str = "inner") -> DataFrame:
    """Every row's items, depth first: order by the row, then ``at``."""
    return df.select("*", F.posexplode(items).alias(at, value))


def separated(df: DataFrame, items: Column, separator: Column, ends: bool = False, value: str = "value", at: str = "inner") -> DataFrame:
    """Items with a separator between them, or after each."""
    each = F.flatten(F.transform(items, lambda x, i: F.when(F.lit(ends), F.array(x, separator)).when(i > 0, F.array(separator, x)).otherwise(F.array(x))))
    return concat_map(df, each, value, at)


def ended(df: DataFrame, items: Column, end: Column, value: str = "value", at: str = "inner") -> DataFrame:
    """Every row's items, and one more after them."""
    return concat_map(df, F.concat(items, F.array(end)), value, at)


def nested_orders(df: DataFrame, items: Column, outer: str, some: Column | None = None, value: str = "value") -> DataFrame:
    """Every row's items with the columns that other orders of them sort by.

    Depth first: (outer, inner).  Breadth first: (breadth, outer).  Fair: (diagonal,
    outer).  Alternating: (breadth, alternate), each level the other way round.
    """
    each = concat_map(df if some is None else df.filter(some), items, value)
    i = F.col("inner")
    return each.withColumns({"breadth": i, "diagonal": F.col(outer) + i, "alternate": F.when(i % 2 == 0, F.col(outer)).otherwise(-F.col(outer))})


def tree_orders(tree: DataFrame) -> DataFrame:
    """iterate_tree's rows with their places depth first, breadth first, and breadth first with levels reversed."""
    from ..seq import Seq

    out = Seq(tree, ["path"]).indexed("depth_first")
    out = Seq(out, ["level", "path"]).indexed("breadth_first")
    level = out.groupBy("level").agg(F.min("breadth_first").alias("__a"), F.max("breadth_first").alias("__b"))
    return out.join(level, "level").withColumn("breadth_reversed", F.col("__a") + F.col("__b") - F.col("breadth_first")).drop("__a", "__b")


def iterate_tree(edges: DataFrame, roots: DataFrame, parent: str = "parent", child: str = "child", depth: int | None = None) -> DataFrame:
    """(node, level, path) of everything reachable in a tree, by one join a level.

    Depth first is the order of path, breadth first that of (level, path).
    Levels are staged; the loop ends with the last level.  Levels below depth, if
    given, and nodes below themselves raise ValueError.
    """
    from ..staging import staged

    level = staged(roots.select(F.col(child).alias("node"), F.lit(0).alias("level"), F.array(F.col(child)).alias("path")), "level")
    out = level
    for k in count(1):
        again = F.array_contains("path", F.col(child)).alias("again")
        level = staged(level.join(edges, level["node"] == edges[parent]).select(F.col(child).alias("node"), F.lit(k).alias("level"), F.concat("path", F.array(F.col(child))).alias("path"), again), "level")
        n, cycle = level.agg(F.count("*"), F.max("again")).first()
        if not n:
            return out
        if cycle or depth is not None and k > depth:
            raise ValueError("a node is below itself" if cycle else f"{n} nodes or more are deeper than {depth} levels")
        level = level.drop("again")
        out = out.unionByName(level)
        if k % 50 == 0:  # plans stay small
            out = staged(out, "levels")
