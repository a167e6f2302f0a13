"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``WINDOW`` words (an item of fewer words is
one window).  Every window is a set of shingles; contained exactly means that
all of them occur, so the prefix that a join needs is one shingle: the rarest
by its count over all documents.  A fixed-size bit table of these shingles
(``BITS`` bits, whatever the benchmark's size) thins the documents' shingles
first; what passes is joined on the shingle, bounded by position (the window
must lie inside the document) and verified word by word.  Windows with a
shingle that no document has are dropped at once.

Null text has no words; empty documents and items give no hits.  Repeated rows
are kept apart by a row number that is staged with them.  An item that occurs
several times counts once; items with the same words each count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import LOWER, alnum_or_high, chunks, row_of, shingle_at, word_hashes
from .staging import BitTable, arrow_map, bit_table, staged

WINDOW = 13
#: Words of a shingle (fewer in windows that are shorter).
SHINGLE = 4
BITS = 24
_WORD = alnum_or_high()


def _words(data: np.ndarray, bounds: np.ndarray):
    low = LOWER[data]
    return low, *word_hashes(low, bounds, _WORD)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for a, _, data, bounds in chunks(batch.column(1)):
            low, h, starts, ends, wb = _words(data, bounds)
            text = low.tobytes()
            rows: dict[str, list] = {c: [] for c in ("item_id", "at", "len", "k", "words", "shingles")}
            for i in range(len(wb) - 1):
                n = int(wb[i + 1] - wb[i])
                size = min(n, WINDOW)
                for at in range(n - size + 1 if n else 0):
                    first, k = int(wb[i]) + at, min(size, SHINGLE)
                    rows["item_id"].append(ids[a + i].as_py())
                    rows["at"].append(at)
                    rows["len"].append(size)
                    rows["k"].append(k)
                    rows["words"].append(b" ".join(text[starts[j] : ends[j]] for j in range(first, first + size)).decode())
                    rows["shingles"].append(shingle_at(h, np.arange(first, first + size - k + 1), k).view(np.int64).tolist())
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("item_id", ids.type), ("at", pa.int32()), ("len", pa.int32()), ("k", pa.int32()), ("words", pa.string()), ("shingles", pa.list_(pa.int64()))]))


def _passing(h: np.ndarray, wb: np.ndarray, k: int, table: BitTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of the k-word shingles that the bit table holds."""
    row = row_of(wb)
    at = np.flatnonzero(np.arange(len(h)) + k <= wb[1:][row])
    x = shingle_at(h, at, k)
    hit = table.test(x)
    return x[hit], row[at[hit]], at[hit]


def _count(batches: Iterator[pa.RecordBatch], shared, ks: list[int]) -> Iterator[pa.RecordBatch]:
    table = shared.value
    for batch in batches:
        for _, _, data, bounds in chunks(batch.column(0)):
            _, h, _, _, wb = _words(data, bounds)
            x, n = np.unique(np.concatenate([_passing(h, wb, k, table)[0] for k in ks]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n)], ["h", "n"])


def _candidates(batches: Iterator[pa.RecordBatch], shared, ks: list[int], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    table = shared.value
    for batch in batches:
        for a, b, data, bounds in chunks(batch.column(batch.num_columns - 1)):
            low, h, starts, ends, wb = _words(data, bounds)
            found: list[list[dict]] = [[] for _ in range(b - a)]
            for k in ks:
                for x, row, at in zip(*_passing(h, wb, k, table)):
                    left, right = max(int(wb[row]), int(at) - WINDOW + 1), min(int(wb[row + 1]), int(at) + WINDOW)
                    words = b" ".join(low[starts[j] : ends[j]].tobytes() for j in range(left, right)).decode()
                    found[row].append({"h": int(x.view(np.int64)), "k": k, "at": int(at - wb[row]), "left": int(left - wb[row]), "words": words})
            yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[:-1]), pa.array(np.diff(wb)), pa.array(found, schema.field("found").type)], schema=pa.schema([*(f for f in batch.schema)][:-1] + [schema.field("n_words"), schema.field("found")]))


_FOUND = "array<struct<h:bigint,k:int,at:int,left:int,words:string>>"
_ARROW = pa.schema([("n_words", pa.int64()), ("found", pa.list_(pa.struct([("h", pa.int64()), ("k", pa.int32()), ("at", pa.int32()), ("left", pa.int32()), ("words", pa.string())])))])


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: key, n_words, n_hit (words inside an occurrence of a window), n_items and items (array of string, sorted)."""
    windows = staged(arrow_map(items.select(F.col(item).alias("item_id"), F.col(item_text).alias("t")), _windows, f"item_id {items.schema[item].dataType.simpleString()}, at int, len int, k int, words string, shingles array<bigint>"), "windows")
    ks = [r["k"] for r in windows.select("k").distinct().orderBy("k").collect()]  # 1 to SHINGLE
    parts = windows.select("item_id", "at", "k", F.posexplode("shingles").alias("offset", "h"))
    counted = arrow_map(docs.select(F.col(text).alias("t")), partial(_count, shared=bit_table(parts.select("h"), "h", BITS), ks=ks), "h long, n long") if ks else parts.select("h", F.lit(0).cast("long").alias("n")).limit(0)
    counts = counted.groupBy("h").agg(F.sum("n").alias("n"))
    rarest = parts.join(counts, "h", "left").groupBy("item_id", "at", "k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset")).alias("r")).filter("r.n > 0")
    keyed = staged(windows.drop("shingles").join(rarest, ["item_id", "at", "k"]).select("item_id", "len", "k", "words", "r.h", "r.offset").distinct(), "keyed")
    kind = docs.schema[key].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(text).alias("t"))
    rows = staged(arrow_map(numbered, partial(_candidates, shared=bit_table(keyed.select("h"), "h", BITS), ks=ks, schema=_ARROW), f"row long, doc_id {kind}, n_words long, found {_FOUND}"), "found")
    met = rows.filter(F.size("found") > 0).select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*").withColumnRenamed("words", "around").join(keyed, ["h", "k"])
    start = F.col("at") - F.col("offset")
    met = met.filter((start >= 0) & (start + F.col("len") <= F.col("n_words"))).filter(F.slice(F.split("around", " "), start - F.col("left") + 1, F.col("len")) == F.split("words", " "))
    hits = met.select("row", "item_id", start.alias("s"), (start + F.col("len")).alias("e"))
    spans = hits.groupBy("row", "s").agg(F.max("e").alias("e"))
    before = F.coalesce(F.max("e").over(Window.partitionBy("row").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n_hit = spans.select("row", F.greatest(F.lit(0), F.col("e") - F.greatest("s", before)).alias("n")).groupBy("row").agg(F.sum("n").alias("n_hit"))
    named = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = rows.select("row", "doc_id", "n_words").join(n_hit.join(named, "row"), "row", "left")
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("doc_id").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_col).cast("long").alias("n_items"), items_col.alias("items"))
