"""Operations on single rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mapped(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """The kept columns and new ones."""
    return df.select(*keep, *(c.alias(name) for name, c in columns.items()))


def filtered(df: DataFrame, p: Column) -> DataFrame:
    """Rows that p holds for; null is false."""
    return df.filter(p)


def map_maybe(df: DataFrame, keep: list[str], name: str, value: Column) -> DataFrame:
    """The kept columns and a value, without the rows where it is null."""
    return df.select(*keep, value.alias(name)).filter(F.col(name).isNotNull())


def cat_maybes(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col(name).isNotNull())


def either(df: DataFrame, right: Column, left_value: Column, right_value: Column) -> DataFrame:
    """Rows as left or right, each with its own value: columns ``l`` and ``r``, one of them null, and ``side``."""
    return df.withColumns({"side": F.when(right, "right").otherwise("left"), "r": F.when(right, right_value), "l": F.when(~F.coalesce(right, F.lit(False)), left_value)})


def rights(df: DataFrame) -> DataFrame:
    return df.filter("side = 'right'").drop("side", "l")


def lefts(df: DataFrame) -> DataFrame:
    return df.filter("side = 'left'").drop("side", "r")


def partitioned(df: DataFrame, p: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that p holds for, and the others (null among them)."""
    return df.filter(p), df.filter(~F.coalesce(p, F.lit(False)))
