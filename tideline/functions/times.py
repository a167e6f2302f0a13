"""Times as whole nanoseconds and seconds, and spans of time in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_nanos(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def from_nanos(ns: Column) -> Column:
    """To the microsecond below."""
    return F.timestamp_micros(F.round((ns - F.pmod(ns, F.lit(1000))) / 1000).cast("long"))


def difference(a: Column, b: Column) -> Column:
    """Microseconds from b to a."""
    return F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))


def shifted(ts: Column, micros: Column | int) -> Column:
    return F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + micros)


def shown(micros: Column) -> Column:
    """The span in its largest whole unit, cut down to three decimals."""
    x = F.abs(micros).cast("double")
    units = ((86_400e6, "d"), (3_600e6, "h"), (60e6, "m"), (1e6, "s"), (1e3, "ms"), (1.0, "us"))
    out = F.lit("0 us")
    for size, name in reversed(units):
        out = F.when(x >= size, F.concat((F.floor(x / size * 1000) / 1000).cast("decimal(18,3)").cast("string"), F.lit(f" {name}"))).otherwise(out)
    return out
