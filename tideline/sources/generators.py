"""Bounded generators of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def enumerate_from_then_to(spark: SparkSession, start: int, then: int, end: int, name: str = "value") -> DataFrame:
    """start, then, ... up to end, inclusive; upwards or downwards."""
    step = then - start
    return spark.range(start, end + (1 if step > 0 else -1), step).withColumnRenamed("id", name)


def enumerate_fractional(spark: SparkSession, start: float, then: float, end: float, name: str = "value") -> DataFrame:
    """Up to end and half a step more."""
    step = then - start
    n = max(0, math.floor((end - start) / step + 0.5) + 1)
    return spark.range(n).select((F.lit(start) + F.col("id") * step).alias(name))


def generate(spark: SparkSession, n: int, f, name: str = "value") -> DataFrame:
    """f(i) for i from 0 to n - 1."""
    return spark.range(n).select(F.col("id").alias("index"), f(F.col("id")).alias(name))


def replicate(spark: SparkSession, n: int, value: Column, name: str = "value") -> DataFrame:
    return spark.range(n).select(value.alias(name))


def iterate(spark: SparkSession, seed: int, step: str, n: int, name: str = "value") -> DataFrame:
    """seed, f(seed), ... (n rows) by a recursive query; step is SQL over x."""
    return spark.sql(f"WITH RECURSIVE t(i, x) AS (SELECT 0L, {seed}L UNION ALL SELECT i + 1, {step} FROM t WHERE i < {n - 1}) SELECT i AS index, x AS {name} FROM t")


def from_list(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows with their ``index``, of a list held by the driver."""
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"index long, {schema}")


def nil(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def unfoldr(spark: SparkSession, seed: int, more: str, value: str, step: str, name: str = "value") -> DataFrame:
    """value(s) and s = step(s) as long as more(s), by a recursive query; all are SQL over s."""
    return spark.sql(f"WITH RECURSIVE t(i, s) AS (SELECT 0L, {seed}L UNION ALL SELECT i + 1, {step} FROM t WHERE {more}) SELECT i AS index, {value} AS {name} FROM t WHERE {more}")


def enumerate_from(spark: SparkSession, start: int, n: int, name: str = "value") -> DataFrame:
    return enumerate_step(spark, start, 1, n, name)


def enumerate_from_then(spark: SparkSession, start: int, then: int, n: int, name: str = "value") -> DataFrame:
    return enumerate_step(spark, start, then - start, n, name)


def enumerate_step(spark: SparkSession, start: int, step: int, n: int, name: str = "value") -> DataFrame:
    """n numbers, by multiplication, so tasks need not know of each other."""
    return spark.range(n).select((F.lit(start).cast("long") + F.col("id") * step).alias(name))


def enumerate_fractional_step(spark: SparkSession, start: float, step: float, n: int, name: str = "value") -> DataFrame:
    return spark.range(n).select((F.lit(start) + F.col("id") * step).alias(name))


#: The greatest number of each bounded type.
GREATEST = {"boolean": 1, "tinyint": 127, "smallint": 32_767, "int": 2_147_483_647}


def enumerate_bounded(spark: SparkSession, start: int, kind: str, name: str = "value") -> DataFrame:
    """From start to the greatest value of a bounded type, as long."""
    return spark.range(start, GREATEST[kind] + 1).withColumnRenamed("id", name)
