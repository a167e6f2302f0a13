"""Sharding by Karmarkar-Karp differencing.

Law: ``bytes``.  Rows with the same text are a group and stay together, unless
a group is larger than a shard's share; then it is cut into pieces by a hash of
the row's id, since no balance exists with it whole (at most ``shards`` groups
can be so large).  Up to 2 * ``TOP`` groups are differenced in one task.  More
fall into buckets by hash (of ``BUCKET`` at most, and enough of them for ``TOP``
cells); differencing in each gives ``shards`` cells, and a cell is an item of the
next level, so a heavy group, alone in its cell, meets enough lighter items
there.  The driver sees no sizes but a count.

Null text has no bytes (its size is 8) and is grouped with empty text; texts of
any length count whole.  Rows with equal text may be any number; equal sizes are ties broken by hash.
Only the key and the text are read, so other columns may have any names.  Slots
count from 0 without gaps in each shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged
from ..shipping import ship

#: Items in a bucket, at most about; items differenced in one task at the top, about.
BUCKET, TOP = 50_000, 20_000
#: Rows whose slots are counted in one task, about.
SLOT_ROWS = 100_000
#: A group larger than a shard's share is cut into pieces of about this part of it.
PIECE = 8


def difference(parts: Sequence[Sequence[tuple[int, object]]], shards: int) -> tuple[list[int], list[list]]:
    """Sums of the shards and what each holds.

    parts: partial partitions; each lists (sum, what) for its cells, at most shards of them.
    """
    heap: list = []
    links: list[tuple] = []  # a cell's content: a leaf, or two contents

    def push(cells: list[tuple[int, int]], k: int) -> None:
        cells.sort(key=lambda c: -c[0])
        spread = cells[0][0] - (cells[-1][0] if len(cells) == shards else 0)
        heapq.heappush(heap, (-spread, k, cells))

    for k, part in enumerate(parts):
        cells = []
        for size, what in part:
            links.append((what,))
            cells.append((size, len(links) - 1))
        if cells:
            push(cells, k)
    k = len(parts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        free = shards - len(a)
        made = a[: max(0, shards - len(b))]
        rest = b[: max(0, free)] if len(a) + len(b) <= shards else None
        if rest is not None:
            made = a + b
        else:
            # cell j of a (largest first) meets cell shards - 1 - j of b
            for j in range(shards - len(b), shards):
                other = b[shards - 1 - j]
                if j < len(a):
                    links.append((a[j][1], other[1], None))
                    made.append((a[j][0] + other[0], len(links) - 1))
                else:
                    made.append(other)
        push(made, k)
        k += 1
    sums, held = [0] * shards, [[] for _ in range(shards)]
    if heap:
        for j, (size, at) in enumerate(heap[0][2]):
            sums[j], stack = size, [at]
            while stack:
                x = links[stack.pop()]
                if len(x) == 1:
                    held[j].append(x[0])
                else:
                    stack += x[:2]
    return sums, held


def _bucket(key: tuple, table: pa.Table, shards: int) -> pa.Table:
    """The items of a bucket and the cells that differencing puts them into."""
    items, sizes = table.column("item").to_pylist(), table.column("bytes").to_pylist()
    order = sorted(range(len(items)), key=lambda i: (-sizes[i], items[i]))
    sums, held = difference([[(sizes[i], items[i])] for i in order], shards)
    cell = [j for j, us in enumerate(held) for _ in us]
    item = [u for us in held for u in us]
    return pa.table({"bucket": pa.array([key[0].as_py()] * len(item), pa.int64()), "item": pa.array(item, pa.string()), "cell": pa.array(cell, pa.int32()), "cell_bytes": pa.array([sums[j] for j in cell], pa.int64())})


def _placed(units: DataFrame, shards: int) -> DataFrame:
    """unit and shard, of (unit, bytes): level by level, cells becoming items."""
    ship(units.sparkSession)
    items = staged(units.select(F.col("unit").alias("item"), "bytes"), "units")
    place = None
    while True:
        n = items.count()
        buckets = 1 if n <= 2 * TOP else max(TOP // shards, -(-n // BUCKET))
        dealt = items.withColumn("bucket", F.pmod(F.xxhash64("item", F.lit("bucket")), F.lit(buckets)))
        step = staged(dealt.groupBy("bucket").applyInArrow(lambda key, table: _bucket(key, table, shards), "bucket long, item string, cell int, cell_bytes long"), "cells")
        name = F.concat_ws(":", "bucket", "cell").alias("up")
        place = step.select(F.col("item").alias("unit"), name, "cell") if place is None else place.join(step.select("item", name, "cell"), F.col("at") == F.col("item")).select("unit", "up", "cell")
        if buckets == 1:
            return place.select("unit", F.col("cell").alias("shard"))
        place = place.select("unit", F.col("up").alias("at"))
        items = staged(step.select(name, "cell_bytes").distinct().toDF("item", "bytes"), "items")


def assign(df: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, size, text_crc32, shard and slot of every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = staged(df.select(F.col(key).alias("doc_id"), (F.octet_length(whole) + 8).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.xxhash64(whole).alias("h")), "rows")
    group = ("h", "text_crc32", "size")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    # at most `shards` groups are larger than a share, as their bytes add up to the total at most
    big = rows.groupBy(*group).agg((F.count("*") * F.col("size")).alias("bytes")).filter(F.col("bytes") * shards > total).orderBy(F.desc("bytes")).limit(shards).collect()
    pieces = F.lit(1)
    for r in big:
        count = -(-r["bytes"] * shards * PIECE // max(total, 1))
        pieces = F.when((F.col("h") == r["h"]) & (F.col("text_crc32") == r["text_crc32"]) & (F.col("size") == r["size"]), int(count)).otherwise(pieces)
    piece = F.pmod(F.xxhash64("doc_id", F.lit("piece")), pieces)
    unit = F.concat_ws(":", F.hex("h"), "text_crc32", "size", piece.cast("string"))
    rows = rows.withColumn("unit", unit)
    units = rows.groupBy("unit").agg(F.sum("size").alias("bytes"))
    placed = rows.join(_placed(units, shards), "unit")
    subs = max(8, -(-n // (SLOT_ROWS * shards)) * 2)
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(subs)))
    before = placed.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    before = before.select("shard", "sub", (F.sum("n").over(Window.partitionBy("shard").orderBy("sub")) - F.col("n")).alias("before"))
    at = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "h")) - 1
    return placed.withColumn("at", at).join(before, ["shard", "sub"]).select(F.col("doc_id").alias(key), "size", "text_crc32", "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"))
