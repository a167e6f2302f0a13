"""Staged tables, Arrow maps and broadcast bit tables of the operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from ..staging import staged

__all__ = ["BitTable", "Both", "arrow_map", "bit_table", "give_back", "staged"]


#: Rows of an Arrow batch: whole texts can be long, so fewer than Spark's default, which is taken to mean that none was chosen.
ROWS = "2000"


def arrow_map(df: DataFrame, function, schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow, with this package at hand in the workers and batches that bound their memory."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    return df.mapInArrow(partial(_run, function=function), schema)


def _run(batches: Iterator[pa.RecordBatch], function) -> Iterator[pa.RecordBatch]:
    yield from function(batches)
    _trim()  # workers are kept between tasks


def _trim() -> None:
    """What this Python process has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def give_back(spark: SparkSession) -> str | None:
    """What the driver's Python process and its JVM have freed outside the heap goes back to the system; the JVM's report.

    A driver that has compiled and run many plans keeps hundreds of MB in its C
    library's free lists.  A JVM that has no such command gives None.
    """
    _trim()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kind = jvm.java.lang.Class.forName
    names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    with contextlib.suppress(Py4JError):
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given = (command, "systemTrimNativeHeap", gateway.new_array(jvm.Object, 0), gateway.new_array(jvm.String, 0))
        kinds, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.Object, 4)
        for i in range(4):
            kinds[i], values[i] = kind(names[i]), given[i]
        # by reflection, as the server's own class is not open to Py4J
        return kind("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    return None


#: Leading bits of a hash that a bit table leaves out.
SKIPPED = 24


class BitTable:
    """2**bits bits, packed; set at some bits of some hashes (not the leading ones: hashes chosen for being least have few of those)."""

    def __init__(self, bits: int, packed: bytes):
        self.bits, self.packed = bits, packed

    def test(self, hashes: np.ndarray) -> np.ndarray:
        at = ((hashes << np.uint64(SKIPPED)) >> np.uint64(64 - self.bits)).astype(np.int64)
        return (np.frombuffer(self.packed, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


class Both:
    """Holds what all of some broadcast bit tables hold."""

    def __init__(self, *tables):
        self.tables = tables

    @property
    def value(self) -> Both:
        return self

    def test(self, hashes: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([t.value.test(hashes) for t in self.tables])


def bit_table(df: DataFrame, column: str, bits: int):
    """A broadcast BitTable of the column (long).

    Its size is fixed by bits, whatever the number of rows; what reaches the
    driver is at most 2**(bits - 6) pairs of longs.
    """
    at = F.shiftrightunsigned(F.shiftleft(F.col(column), SKIPPED), 64 - bits)
    word = df.select(F.shiftright(at, 6).alias("w"), F.expr("shiftleft(1L, 0)").alias("one"), (at.bitwiseAND(F.lit(63))).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("v"))
    rows = word.toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    if rows.num_rows:
        table[rows.column("w").to_numpy()] = rows.column("v").to_numpy()
    return df.sparkSession.sparkContext.broadcast(BitTable(bits, table.astype("<i8").tobytes()))
