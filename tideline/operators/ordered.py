"""Operations on whole ordered sequences: order, separators, comparison, merging by turns.

Every function takes ``Seq`` without keys unless it says otherwise and returns rows
with explicit position columns (``turn``, then ``part`` where there is one), so the
order of a result is the order of those columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..seq import Seq, interleaved


def reversed_rows(seq: Seq, name: str = "turn") -> DataFrame:
    """Rows with their place in the reversed sequence."""
    return seq.indexed(name, reverse=True)


def sorted_rows(df: DataFrame, *by: Column | str) -> DataFrame:
    """A total order by range partitions."""
    return df.orderBy(*by)


def ranked_rows(df: DataFrame, by: Sequence[str], name: str = "place") -> DataFrame:
    """Every row with its place in the order of the columns (which must tell rows apart)."""
    return Seq(df, by).indexed(name)


def separated_rows(seq: Seq, every: int = 1, where: str = "between", mark: str = "separator") -> DataFrame:
    """Rows with separator rows (other columns null, ``mark`` true) among them, by ``turn``.

    where: "between" items, "after" every so many and the rest, or "before" every so many.
    """
    columns = seq.df.columns
    i, last = F.col("__i"), F.col("__j") == 0
    rows = seq.like(seq.indexed("__i")).indexed("__j", reverse=True)
    group = F.floor(i / every).cast("long")
    if where == "between":
        at, gap = i + group, (i % every == 0) & (i > 0)
        item, separator = F.struct(at.alias("turn"), F.lit(False).alias(mark)), F.struct((at - 1).alias("turn"), F.lit(True).alias(mark))
    elif where == "before":
        at, gap = i + group + 1, i % every == 0
        item, separator = F.struct(at.alias("turn"), F.lit(False).alias(mark)), F.struct((at - 1).alias("turn"), F.lit(True).alias(mark))
    else:
        at, gap = i + group, (i % every == every - 1) | last
        item, separator = F.struct(at.alias("turn"), F.lit(False).alias(mark)), F.struct((at + 1).alias("turn"), F.lit(True).alias(mark))
    each = rows.select(*columns, F.explode(F.when(gap, F.array(item, separator)).otherwise(F.array(item))).alias("__x"))
    own = [F.when(~F.col(f"__x.{mark}"), F.col(c)).alias(c) for c in columns]
    return each.select(*own, F.col("__x.turn").alias("turn"), F.col(f"__x.{mark}").alias(mark))


def inserted(seq: Seq, row: DataFrame, value: str) -> DataFrame:
    """The row (a table of one) before the first that is not smaller by ``value``, or at the end; by ``turn``."""
    rows = seq.indexed("turn")
    new = row.select(F.col(value).alias("__new"))
    at = rows.crossJoin(F.broadcast(new)).agg(F.min(F.when(F.col(value) >= F.col("__new"), F.col("turn"))).alias("__at"), F.count("*").alias("__n"))
    at = at.select(F.coalesce("__at", "__n").alias("__at"))
    old = rows.crossJoin(F.broadcast(at)).withColumn("turn", F.col("turn") + F.when(F.col("turn") >= F.col("__at"), 1).otherwise(0)).drop("__at")
    return old.unionByName(row.select(*seq.df.columns).crossJoin(F.broadcast(at)).withColumnRenamed("__at", "turn"))


def difference(left: Seq, right: Seq, value: str) -> DataFrame:
    """One row: ``at``, the first place where the sequences differ or one has ended (null if never), and ``order`` (-1, 0, 1) there."""
    a = left.indexed("__i").select("__i", F.struct(value).alias("a"))
    b = right.indexed("__i").select("__i", F.struct(value).alias("b"))
    x, y = F.col(f"a.{value}"), F.col(f"b.{value}")
    both = a.join(b, "__i", "full").filter(F.col("a").isNull() | F.col("b").isNull() | ~x.eqNullSafe(y))
    order = F.when(F.col("a").isNull(), -1).when(F.col("b").isNull(), 1).when(x.isNull() | (x < y), -1).otherwise(1)
    first = F.min(F.struct(F.col("__i").alias("at"), order.alias("order"))).alias("d")
    return both.agg(first).select("d.at", F.coalesce("d.order", F.lit(0)).alias("order"))


def equal(left: Seq, right: Seq, value: str) -> DataFrame:
    """One row: are they equal in length and values (nulls are equal)?"""
    return difference(left, right, value).select((F.col("order") == 0).alias("equal"))


def compared(left: Seq, right: Seq, value: str) -> DataFrame:
    """One row: lexicographic order, -1, 0 or 1; a prefix is smaller."""
    return difference(left, right, value).select("order")


def common_prefix(left: Seq, right: Seq, value: str, drop: bool = False) -> DataFrame:
    """Left's rows as long as right has the same values at the same places, or the others."""
    at = difference(left, right, value).select(F.coalesce("at", F.lit((1 << 63) - 1)).alias("__at"))
    rows = left.indexed("__i").crossJoin(F.broadcast(at))
    same = F.col("__i") < F.col("__at")
    return rows.filter(~same if drop else same).drop("__i", "__at")


def sorted_intersect(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of left whose key right has too; both are sorted by the keys, so a merge join without a hash table."""
    return left.join(right.select(*keys).distinct().hint("merge"), list(keys), "left_semi")


def _turns(parts: Sequence[Seq], columns: Sequence[str]) -> tuple[DataFrame, Column, Column]:
    """Rows by (turn, part), and the lengths of the two parts."""
    rows = interleaved(parts, columns)
    n = rows.groupBy().agg(*(F.count(F.when(F.col("part") == k, 1)).alias(f"__n{k}") for k in (0, 1)))
    return rows.crossJoin(F.broadcast(n)), F.col("__n0"), F.col("__n1")


def interleaved_shortest(left: Seq, right: Seq, columns: Sequence[str]) -> DataFrame:
    """By turns from left, until the one whose turn it is has ended."""
    rows, n, m = _turns([left, right], columns)
    turn, first = F.col("turn"), F.col("part") == 0
    return rows.filter((first & (turn <= m)) | (~first & (turn < n))).drop("__n0", "__n1")


def ended_by(content: Seq, ends: Seq, columns: Sequence[str], both: bool = False) -> DataFrame:
    """Each row of content, then one of ends; without one if they are used up, or stopping there (both)."""
    rows, n, m = _turns([content, ends], columns)
    first = F.col("part") == 0
    keep = (first & ((F.col("turn") < m) | F.lit(not both))) | (~first & (F.col("turn") < n))
    return rows.filter(keep).drop("__n0", "__n1")


def separated_by(content: Seq, separators: Seq, columns: Sequence[str], both: bool = False) -> DataFrame:
    """Rows of content with one of separators between two; without one if they are used up, or stopping there (both)."""
    rows, n, m = _turns([content, separators], columns)
    first = F.col("part") == 0
    keep = (first & ((F.col("turn") <= m) | F.lit(not both))) | (~first & (F.col("turn") < n - 1))
    return rows.filter(keep).drop("__n0", "__n1")


def round_robin(parts: Sequence[Seq], keep: Sequence[Column | None], columns: Sequence[str]) -> DataFrame:
    """Turns of the unfiltered sequences: a row that its part's filter drops uses its turn up."""
    rows = interleaved(parts, columns)
    good = F.lit(True)
    for k, p in enumerate(keep):
        if p is not None:
            good = good & ((F.col("part") != k) | F.coalesce(p, F.lit(False)))
    return rows.filter(good)


def or_else(df: DataFrame, other: DataFrame) -> DataFrame:
    """df, or other if df has no rows."""
    some = df.limit(1).agg((F.count("*") == 0).alias("__none"))
    return df.unionByName(other.crossJoin(F.broadcast(some)).filter("__none").drop("__none"))


def appended_unfold_last(seq: Seq, items: Column, value: str) -> DataFrame:
    """The values and, after the last row, that row's items: by (turn, part, inner)."""
    rows = seq.like(seq.indexed("turn")).indexed("__j", reverse=True)
    own = rows.select(F.col(value).alias("value"), "turn", F.lit(0).alias("part"), F.lit(0).alias("inner"))
    return own.unionByName(rows.filter("__j = 0").select("turn", F.lit(1).alias("part"), F.posexplode(items).alias("inner", "value")))


def reduced_by_levels(seq: Seq, value: str, join) -> DataFrame:
    """One row: neighbours joined in pairs, level by level, an odd last one going up as it is.

    join(a, b): the value of a pair; it need be neither associative nor commutative.
    """
    from ..staging import staged

    level = staged(seq.indexed("__i").select("__i", F.col(value).alias("v")), "pairs")
    n = level.count()
    while n > 1:
        pair = level.groupBy(F.floor(F.col("__i") / 2).cast("long").alias("__k")).agg(F.min_by("v", "__i").alias("a"), F.max_by("v", "__i").alias("b"), F.count("*").alias("c"))
        level = staged(pair.select(F.col("__k").alias("__i"), F.when(F.col("c") == 2, join(F.col("a"), F.col("b"))).otherwise(F.col("a")).alias("v")), "pairs")
        n = -(-n // 2)
    return level.select(F.col("v").alias(value))


def grouped_by_first(seq: Seq, value: str, width: float, name: str = "group") -> DataFrame:
    """Numbers runs (of a keyed sequence) in which every value is less than width above the run's first."""
    from functools import partial

    from pyspark.sql import types as T

    from .stateful import scan_sorted

    return scan_sorted(seq.df, seq.keys, seq.order, partial(_near_first, value=value, width=width), {"group": T.LongType()}).withColumnRenamed("group", name)


def _near_first(state, columns, value: str, width: float):
    first, number = state or (None, -1)
    out = []
    for x in columns[value].to_pylist():
        if first is None or x is None or not 0 <= x - first < width:
            first, number = x, number + 1
        out.append(number)
    return (first, number), {"group": out}


def tapped(df: DataFrame, name: str, *aggs: Column) -> DataFrame:
    """df itself; what the aggregates come to while it is read is reported to query listeners under the name."""
    return df.observe(name, *aggs)


def stripped_prefix(left: Seq, prefix: Seq, value: str) -> DataFrame:
    """Left without the prefix; no rows at all if it does not begin so."""
    at = difference(left, prefix, value).select(F.col("at").alias("__at"), F.col("order").alias("__o"))
    n = prefix.df.agg(F.count("*").alias("__n"))
    rows = left.indexed("__i").crossJoin(F.broadcast(at)).crossJoin(F.broadcast(n))
    begins = F.col("__at").isNull() | (F.col("__at") >= F.col("__n"))
    return rows.filter(begins & (F.col("__i") >= F.col("__n"))).drop("__i", "__at", "__o", "__n")


def tapped_every(df: DataFrame, name: str, seq: Seq, offset: int, step: int, *aggs: Column) -> DataFrame:
    """df itself; aggregates over every step-th row from an offset on are reported under the name."""
    rows = seq.indexed("__i")
    chosen = (F.col("__i") >= offset) & ((F.col("__i") - offset) % step == 0)
    return rows.withColumn("__tapped", chosen).observe(name, F.count(F.when(F.col("__tapped"), 1)).alias("n"), *aggs).drop("__i", "__tapped")


def time_indexed(seq: Seq, ts: str, name: str = "since") -> DataFrame:
    """Microseconds since the first row (of each key)."""
    now = F.unix_micros(F.col(ts).cast("timestamp"))
    if seq.keys:
        return seq.df.withColumn(name, now - F.min(now).over(seq.upto()))
    first = seq.df.agg(F.min(now).alias("__t"))
    return seq.df.crossJoin(F.broadcast(first)).withColumn(name, now - F.col("__t")).drop("__t")


def stamped(df: DataFrame, name: str = "at") -> DataFrame:
    """Rows with the time of the query."""
    return df.withColumn(name, F.current_timestamp())
