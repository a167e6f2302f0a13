"""Ordered sequences: a DataFrame with an ordering contract.

``Seq(df, order, keys)`` is one sequence for each value of keys (one in all if
there are none).  order must be unique within a sequence; every result is a
function of (order, data), never of partitioning.

Keyed sequences use windows over the keys.  Sequences without keys would put
all rows in one window partition, so positions and running sums of those are
made in two levels: rows are range-partitioned by the order into blocks (staged,
so that blocks stay as they are), each block is a window partition, and the
blocks' totals (one row each) are added in front.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .staging import staged

BLOCK = "__block"
FOLDS = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product}
JOINS = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest, "product": lambda a, b: F.coalesce(a, F.lit(1)) * F.coalesce(b, F.lit(1))}


class Seq:
    def __init__(self, df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()):
        self.df, self.order, self.keys = df, list(order), list(keys)
        self._blocks: DataFrame | None = None

    # windows

    def by(self, reverse: bool = False) -> WindowSpec:
        """The window of a keyed sequence (or of one block), in order."""
        cols = [F.desc(c) if reverse else F.asc(c) for c in self.order]
        return Window.partitionBy(*(self.keys or [BLOCK])).orderBy(*cols)

    def upto(self) -> WindowSpec:
        return self.by().rowsBetween(Window.unboundedPreceding, 0)

    def last(self, n: int) -> WindowSpec:
        return self.by().rowsBetween(-(n - 1), 0)

    def like(self, df: DataFrame) -> Seq:
        return Seq(df, self.order, self.keys)

    def blocks(self) -> DataFrame:
        """Rows with their block; blocks follow the order.

        Without keys this runs a job: the rows are written to the shared folder, so
        that blocks stay as they are.  It is done once for a Seq.
        """
        if self.keys:
            return self.df
        if self._blocks is None:
            parted = self.df.repartitionByRange(*self.order).withColumn(BLOCK, F.spark_partition_id())
            self._blocks = staged(parted, "blocks")
        return self._blocks

    def running(self, name: str, value: Column, kind: str = "sum", exclusive: bool = False, reverse: bool = False) -> DataFrame:
        """Running sum, min, max or product of value (sum is 0, the others null before the first row).

        reverse: over the rows after, from the last one back.
        """
        fold = FOLDS[kind]
        window = self.by(reverse).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        own = fold(value).over(window)
        if self.keys:
            return self.df.withColumn(name, F.coalesce(own, F.lit(0)) if kind == "sum" else own)
        return self._over_blocks({name: (value, kind, exclusive, reverse)})

    def _over_blocks(self, columns: dict[str, tuple[Column, str, bool, bool]]) -> DataFrame:
        """Running columns (value, kind, exclusive, reverse) in two levels; all read the blocks once."""
        out = self.blocks()
        added = []
        totals = out.groupBy(BLOCK).agg(*(FOLDS[kind](value).alias(f"__t{k}") for k, (value, kind, _, _) in enumerate(columns.values())))  # one row for each block
        before = totals
        for k, (name, (value, kind, exclusive, reverse)) in enumerate(columns.items()):
            fold = FOLDS[kind]
            window = Window.orderBy(F.desc(BLOCK) if reverse else F.asc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
            before = before.withColumn(f"__b{k}", fold(f"__t{k}").over(window))
            own = fold(value).over(self.by(reverse).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0))
            added.append(own.alias(f"__o{k}"))
        out = out.select("*", *added).join(F.broadcast(before), BLOCK)
        zero = lambda c, kind: F.coalesce(c, F.lit(0)) if kind == "sum" else c
        made = {name: JOINS[kind](zero(F.col(f"__o{k}"), kind), zero(F.col(f"__b{k}"), kind)) for k, (name, (_, kind, _, _)) in enumerate(columns.items())}
        return out.withColumns(made).drop(BLOCK, *(f"__{x}{k}" for x in "obt" for k in range(len(columns))))

    def running_all(self, **columns: tuple[Column, str, bool]) -> DataFrame:
        """Several running columns, (value, kind, exclusive) each, in one pass."""
        if not self.keys:
            return self._over_blocks({name: (*c, False) for name, c in columns.items()})
        out = self.df
        for name, (value, kind, exclusive) in columns.items():
            out = self.like(out).running(name, value, kind, exclusive)
        return out

    def indexed(self, name: str = "index", reverse: bool = False) -> DataFrame:
        """Positions from 0; reverse counts down from the last row to 0."""
        if self.keys:
            return self.df.withColumn(name, (F.row_number().over(self.by(reverse)) - 1).cast("long"))
        return self.running(name, F.lit(1).cast("long"), exclusive=True, reverse=reverse)

    def split_at(self, n: int, name: str = "first") -> DataFrame:
        """Every row, told whether it is among the first n."""
        return self.indexed("__i").withColumn(name, F.col("__i") < n).drop("__i")

    def running_distinct(self, name: str, value: str) -> DataFrame:
        """How many different values (null is none) have come so far: first occurrences, added up."""
        if not self.keys:
            firsts = self.df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(F.struct(*self.order)).alias("__r")).select("__r.*", F.lit(1).alias("__first"))
            return self.like(self.df.join(firsts, self.order, "left")).running(name, F.coalesce("__first", F.lit(0)).cast("long")).drop("__first")
        nth = F.row_number().over(Window.partitionBy(*self.keys, value).orderBy(*self.order))
        # dealt by the keys, so that the window by key and value needs no other exchange
        flagged = self.df.repartition(*self.keys).withColumn("__first", F.when(F.col(value).isNotNull() & (nth == 1), 1).otherwise(0).cast("long"))
        return flagged.withColumn(name, F.sum("__first").over(self.upto())).drop("__first")

    # filters and trims: SURVEY 2.3

    def _trim(self, name: str, df: DataFrame, keep: Column) -> DataFrame:
        return df.filter(keep).drop(name)

    def take(self, n: int) -> DataFrame:
        if not self.keys:
            return self.df.orderBy(*self.order).limit(n)  # partial top-n in each task
        return self._trim("__i", self.indexed("__i"), F.col("__i") < n)

    def drop(self, n: int) -> DataFrame:
        return self._trim("__i", self.indexed("__i"), F.col("__i") >= n)

    def take_while(self, p: Column) -> DataFrame:
        return self._trim("__f", self.running("__f", F.when(p, 0).otherwise(1)), F.col("__f") == 0)

    def drop_while(self, p: Column) -> DataFrame:
        return self._trim("__f", self.running("__f", F.when(p, 0).otherwise(1)), F.col("__f") > 0)

    def take_end_by(self, p: Column, keep: bool = True) -> DataFrame:
        """Up to the first row that p holds for, with it or without."""
        return self._trim("__f", self.running("__f", F.when(p, 1).otherwise(0), exclusive=keep), F.col("__f") == 0)

    def matched_by_seq(self, name: str, x: Column, items: Sequence[Column], first: bool = False) -> DataFrame:
        """Whether items have come in a row, told at the last of them (or at the first); null equals null."""
        df, hit, n = self.df, F.lit(True), len(items)
        for k, item in enumerate(items):
            away = -k if first else n - 1 - k
            if away:  # in a struct, as no row is not a null
                df = self.like(df).lagged(f"__x{k}", F.struct(x.alias("v")), away)
                hit &= F.col(f"__x{k}").isNotNull() & F.col(f"__x{k}.v").eqNullSafe(item)
            else:
                hit &= x.eqNullSafe(item)
        return df.withColumn(name, hit).drop(*(f"__x{k}" for k in range(n)))

    def take_end_by_seq(self, x: Column, items: Sequence[Column], keep: bool = True) -> DataFrame:
        """Up to the first place where items have just come, with them or without."""
        if not items:
            return self.df.filter(F.lit(False))
        out = self.like(self.matched_by_seq("__m", x, items, first=not keep))
        return out.take_end_by(F.col("__m"), keep).drop("__m")

    def stride(self, offset: int, step: int) -> DataFrame:
        i = F.col("__i")
        return self._trim("__i", self.indexed("__i"), (i >= offset) & ((i - offset) % step == 0))

    def find_indices(self, p: Column, name: str = "index") -> DataFrame:
        return self.indexed(name).filter(p)

    def first_where(self, p: Column) -> DataFrame:
        """The first row that p holds for."""
        return self.like(self.df.filter(p)).take(1)

    def delete_first(self, p: Column) -> DataFrame:
        """All but the first row that p holds for."""
        hit = F.when(p, 1).otherwise(0)
        out = self.running("__f", hit)
        return self._trim("__f", out, ~F.coalesce(p & (F.col("__f") == 1), F.lit(False)))

    def drop_last(self, n: int) -> DataFrame:
        return self._trim("__i", self.indexed("__i", reverse=True), F.col("__i") >= n)

    def take_last(self, n: int) -> DataFrame:
        if not self.keys:
            return self.df.orderBy(*(F.desc(c) for c in self.order)).limit(n)
        return self._trim("__i", self.indexed("__i", reverse=True), F.col("__i") < n)

    def drop_while_last(self, p: Column) -> DataFrame:
        """Without the longest run of rows at the end that p holds for."""
        return self._trim("__f", self.running("__f", F.when(p, 0).otherwise(1), reverse=True), F.col("__f") > 0)

    def drop_while_around(self, p: Column) -> DataFrame:
        return self.like(self.drop_while(p)).drop_while_last(p)

    def modify_last(self, name: str, value: Column) -> DataFrame:
        """The column replaced in the last row."""
        out = self.indexed("__i", reverse=True)
        return out.withColumn(name, F.when(F.col("__i") == 0, value).otherwise(F.col(name))).drop("__i")

    def at(self, n: int) -> DataFrame:
        return self._trim("__i", self.indexed("__i"), F.col("__i") == n)

    def final(self) -> DataFrame:
        if not self.keys:
            return self.df.orderBy(*(F.desc(c) for c in self.order)).limit(1)
        return self._trim("__i", self.indexed("__i", reverse=True), F.col("__i") == 0)

    # neighbours: SURVEY 2.2; without keys, rows further than one apart are joined by position

    def lagged(self, name: str, value: Column, n: int = 1) -> DataFrame:
        """The value n rows before (null if there is none)."""
        if self.keys:
            return self.df.withColumn(name, F.lag(value, n).over(self.by()))
        if n == 1:  # a block's first row gets the last value of the block before (one row for each block)
            df = self.blocks()
            ends = df.groupBy(BLOCK).agg(F.max_by(F.struct(value.alias("v")), F.struct(*self.order)).alias("__e"))
            ends = ends.select(BLOCK, F.lag("__e").over(Window.orderBy(BLOCK)).alias("__e"))
            out = df.select("*", F.lag(value).over(self.by()).alias("__l"), (F.row_number().over(self.by()) == 1).alias("__f")).join(F.broadcast(ends), BLOCK)
            return out.withColumn(name, F.when(F.col("__f"), F.col("__e.v")).otherwise(F.col("__l"))).drop(BLOCK, "__l", "__f", "__e")
        out = self.indexed("__i")
        other = out.select((F.col("__i") + n).alias("__i"), value.alias(name))
        return out.join(other, "__i", "left").drop("__i")

    def uniq(self, value: str) -> DataFrame:
        """Without the rows that equal the row before."""
        out = self.lagged("__p", F.struct(F.col(value).alias("v")))
        return out.filter(F.col("__p").isNull() | ~F.col("__p.v").eqNullSafe(F.col(value))).drop("__p")

    def rolling(self, name: str, f, value: Column, pairs_only: bool = False) -> DataFrame:
        out = self.lagged("__p", value)
        if pairs_only:
            out = self.like(out)._first_dropped()
        return out.withColumn(name, f(F.col("__p"), value)).drop("__p")

    def _first_dropped(self) -> DataFrame:
        return self.drop(1)

    # segments: SURVEY 2.7

    def segments(self, name: str, starts: Column) -> DataFrame:
        """Numbers the segments; a row that starts holds for begins one (the first row always does)."""
        out = self.running(name, F.when(starts, 1).otherwise(0))
        return out

    def groups_of(self, n: int, name: str = "chunk") -> DataFrame:
        return self.indexed("__i").withColumn(name, F.floor(F.col("__i") / n).cast("long")).drop("__i")

    def split_by(self, p: Column, name: str = "segment") -> DataFrame:
        """Rows between separators, numbered by the separators before them; separators themselves go."""
        return self.running(name, F.when(p, 1).otherwise(0).cast("long")).filter(~F.coalesce(p, F.lit(False)))

    def end_by(self, p: Column, name: str = "segment") -> DataFrame:
        """Segments that end with the row p holds for."""
        return self.running(name, F.when(p, 1).otherwise(0).cast("long"), exclusive=True)

    def groups_rolling_by(self, same: "callable", value: Column, name: str = "group") -> DataFrame:
        """Numbers the runs in which each row is the same as the one before; a comparison that gives null is not."""
        out = self.like(self.lagged("__p", F.struct(value.alias("v"))))
        start = F.col("__p").isNull() | ~F.coalesce(same(F.col("__p.v"), value), F.lit(False))
        return out.running(name, F.when(start, 1).otherwise(0).cast("long")).withColumn(name, F.col(name) - 1).drop("__p")


def interleaved(parts: Sequence[Seq], columns: Sequence[str]) -> DataFrame:
    """Rows in turn from each part, what is left of longer ones after; ``turn`` and ``part`` give the order."""
    rows = [p.indexed("turn").select(*columns, "turn", F.lit(k).alias("part")) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, rows)


def appended(parts: Sequence[Seq], columns: Sequence[str]) -> DataFrame:
    """All rows of each part after those of the one before, by (part, turn)."""
    return interleaved(parts, columns)


def merged(left: Seq, right: Seq, columns: Sequence[str], value: str) -> DataFrame:
    """Two sorted sequences in one, left before right on ties: order by (value, part, turn)."""
    return interleaved([left, right], columns).orderBy(value, "part", "turn")


def zipped(left: Seq, right: Seq, name: str = "index") -> DataFrame:
    """Rows at the same position, as long as both have one."""
    return left.indexed(name).join(right.indexed(name), name)


def fair_cross(left: Seq, right: Seq) -> DataFrame:
    """All pairs in diagonal order: by diagonal, then by the outer position."""
    a, b = left.indexed("__a"), right.indexed("__b")
    return a.crossJoin(b).withColumn("diagonal", F.col("__a") + F.col("__b")).withColumnRenamed("__a", "outer_index").withColumnRenamed("__b", "inner_index")
