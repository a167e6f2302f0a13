"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a structured random product code: the vector is cut into
blocks, each block has ``CODE`` Gaussian codewords, and a direction is one
codeword for each block.  Every vector is list-decoded, by branch and bound over
the blocks, to all directions that it exceeds the threshold on (a least number of
its best ones in any case).  Vectors meet in the filters they share and pairs are
verified by cosine in double precision, so no false link is made; the recall
against brute force is measured in the tests.

Equal vectors are one class with a count.  First only sketches meet: a vector's
components in ``SKETCH`` orthonormal directions, one byte each, whose distance
never exceeds that of the vectors by more than the rounding, so no pair is lost.
Vectors move only to the filters where some sketch is near enough.  A large
filter's members are dealt to blocks of ``BLOCK`` and only blocks meet, each pair in
its first common filter; a task returns counts and a spanning forest, never the
pairs.  The number of blocks in the code follows the number of classes; as more
blocks mean a higher threshold, which a near vector misses more often,
``FILTERS`` gives more filters then, so that the recall at cosine 0.95 is not
below that of 2 blocks.

Vectors that are null, empty, zero, or hold null or non-finite components link
with nothing.  Vectors of different lengths do not meet.  Repeated ids are rows
of their own (staged row numbers), and the labels are the smallest id.  Very
large and very small components are scaled before norms are taken.  Only the key
and the vector are read, so other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import arrow_map, staged

CODE = 256
#: Filters of a vector by the number of blocks: expected, and at least.
FILTERS = {2: (14, 12), 3: (42, 36), 4: (126, 108)}
BLOCK = 512
SKETCH = 16


@lru_cache(8)
def codebook(dim: int, blocks: int) -> list[np.ndarray]:
    rng = np.random.default_rng([20, dim, blocks])
    edges = np.linspace(0, dim, blocks + 1).astype(int)
    return [rng.standard_normal((e - s, CODE)) for s, e in zip(edges, edges[1:])]


def decode(x: np.ndarray, blocks: int) -> list[np.ndarray]:
    """The filters of each unit vector, sorted."""
    dim = x.shape[1]
    book = codebook(dim, blocks)
    edges = np.cumsum([0, *(len(b) for b in book)])
    scores = [x[:, s:e] @ b for s, e, b in zip(edges, edges[1:], book)]
    expected, fewest = FILTERS[blocks]
    limit = NormalDist().inv_cdf(1 - expected / CODE**blocks)
    best = [np.sort(s, axis=1)[:, ::-1] for s in scores]
    some = 16 if blocks < 3 else 8
    out = []
    for i in range(len(x)):
        near = best[0][i, :some]
        for b in best[1:]:
            near = (near[:, None] + b[i, :some]).ravel()
        least = min(limit, np.partition(near, -fewest)[-fewest])
        tail = np.cumsum([0.0, *(b[i, 0] for b in best[:0:-1])])[::-1]  # the most that the blocks still to come can add
        part, code = scores[0][i], np.arange(CODE)
        keep = part + tail[0] >= least
        part, code = part[keep], code[keep]
        for k in range(1, blocks):
            both = part[:, None] + scores[k][i]
            r, c = np.nonzero(both + tail[k] >= least)
            part, code = both[r, c], code[r] * CODE + c
        out.append(np.sort(code) + (dim << 40))
    return out


@lru_cache(8)
def directions(dim: int) -> np.ndarray:
    """Orthonormal directions of the sketches (dim x SKETCH, or all of a smaller space)."""
    return np.linalg.qr(np.random.default_rng([21, dim]).standard_normal((dim, min(dim, SKETCH))))[0]


def unit(v: np.ndarray) -> np.ndarray:
    """The rows (none of them zero) at length 1, in double precision."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _decoded(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            lists = part.column(2)
            values, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            starts = np.cumsum(size) - size
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                v = values[starts[rows][:, None] + np.arange(dim)]
                u = unit(v)
                sketch = np.rint(127 * (u @ directions(int(dim)))).astype(np.int8)
                cols = {"sid": part.column(0).take(pa.array(rows)), "m": part.column(1).take(pa.array(rows)), "x": pa.array([r.tobytes() for r in v], pa.binary()), "sketch": pa.array([r.tobytes() for r in sketch], pa.binary()), "filters": pa.array(decode(u, blocks), pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_pydict(cols)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the groups' bounds; batches are sorted by f, i and j, and a group may span them."""
    held: list[pa.RecordBatch] = []

    def bounds(table: pa.Table) -> np.ndarray:
        f, i, j = (table.column(c).to_numpy() for c in ("f", "i", "j"))
        return np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        last = int(bounds(table)[-1])
        if last:
            done = table.slice(0, last)
            yield done, np.r_[bounds(done), last]
            held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.r_[bounds(table), table.num_rows]


def _matrix(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _meeting(near: np.ndarray, block: np.ndarray, i: int, j: int) -> np.ndarray:
    """near (symmetric) without the pairs of a row with itself and, between two blocks, those within one."""
    np.fill_diagonal(near, False)
    if i != j:
        near &= block[:, None] != block
    return near


def _possible(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """f, i, j, block and sid of the vectors with a partner there whose sketch is near enough."""
    for table, cuts in _whole_groups(batches):
        block = table.column("block").to_numpy()
        i, j = (table.column(c).to_numpy() for c in ("i", "j"))
        sketch = table.column("sketch").to_pylist()
        keep = np.zeros(table.num_rows, bool)
        for s, e in zip(cuts, cuts[1:]):
            if e - s < 2:
                continue
            v = np.frombuffer(b"".join(sketch[s:e]), np.int8).reshape(e - s, -1).astype(np.float32)
            # each coordinate is rounded by a half at most, on either side
            far = (127 * np.sqrt(max(0.0, 2 - 2 * least)) + np.sqrt(v.shape[1])) ** 2 + 1
            square = (v * v).sum(1)
            near = square[:, None] + square - 2 * (v @ v.T) <= far
            keep[s:e] = _meeting(near, block[s:e], i[s], j[s]).any(1)
        yield from table.filter(pa.array(keep)).select(["f", "i", "j", "block", "sid"]).combine_chunks().to_batches()


def _group(sid: np.ndarray, m: np.ndarray, block: np.ndarray, v: np.ndarray, filters: list[np.ndarray], f: int, i: int, j: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sid, number of linked vectors and root of the vectors that a pair of blocks links in their first common filter."""
    near = _meeting(v @ v.T >= least, block, i, j)
    # a pair that shares a filter before f was met there
    earlier = [x[x < f] for x in filters]
    names, at = np.unique(np.concatenate(earlier), return_inverse=True)
    if len(names):
        row = np.repeat(np.arange(len(v)), [len(x) for x in earlier])
        for k in range(0, len(names), 4096):
            some = (at >= k) & (at < k + 4096)
            has = np.zeros((len(v), min(4096, len(names) - k)), np.float32)
            has[row[some], at[some] - k] = 1
            near &= has @ has.T == 0
    rows = np.flatnonzero(near.any(1))
    if not len(rows):
        return (np.zeros(0, np.int64),) * 3
    near = near[np.ix_(rows, rows)]
    root = np.arange(len(rows))
    while True:
        least_near = np.where(near, root, len(rows)).min(1)
        new = np.minimum(root, least_near)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return sid[rows], near @ m[rows], sid[rows][root]


def _linked(batches: Iterator[pa.RecordBatch], least: float, kind: str) -> Iterator[pa.RecordBatch]:
    for table, cuts in _whole_groups(batches):
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        f, i, j, sid, m, block = (table.column(c).to_numpy() for c in ("f", "i", "j", "sid", "m", "block"))
        x = table.column("x")
        lists = table.column("filters").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        for s, e in zip(cuts, cuts[1:]):
            if e - s > 1:
                v = unit(_matrix(x.slice(s, e - s), np.dtype(kind)))
                out.append(_group(sid[s:e], m[s:e], block[s:e], v, [flat[offsets[k] : offsets[k + 1]] for k in range(s, e)], f[s], i[s], j[s], least))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["sid", "links", "root"])


def links(df: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding", blocks: int | None = None) -> DataFrame:
    """Per row: key, n_links (other vectors linked), component_id, kept (the component's smallest key).

    blocks: of the code; by default by the number of classes.
    """
    kind = "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"
    v = F.col(vector).cast(f"array<{kind}>")
    fine = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == math.inf)) & F.exists(v, lambda c: c != 0)
    rows = staged(df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("vec_id"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine")).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(9), "v")}), "vectors")
    classes = staged(rows.filter("fine").groupBy("h1", "h2").agg(F.min(F.struct("row", "v")).alias("r"), F.min("vec_id").alias("least"), F.count("*").alias("m")).select("h1", "h2", F.col("r.row").alias("sid"), "r.v", "least", "m"), "classes")
    if blocks is None:
        n = classes.count()
        blocks = 2 if n <= 1_000_000 else 3 if n <= 200_000_000 else 4
    coded = staged(arrow_map(classes.select("sid", "m", "v"), partial(_decoded, blocks=blocks), "sid long, m long, x binary, sketch binary, filters array<bigint>"), "coded")
    met = coded.select(F.explode("filters").alias("f")).groupBy("f").agg(F.count("*").alias("c")).filter("c > 1").select("f", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    members = coded.select("sid", "sketch", F.explode("filters").alias("f")).join(met, "f").withColumn("block", F.pmod(F.xxhash64("sid", "f"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = members.select("f", "sid", "sketch", "block", other.alias("o")).select("f", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "sid", "sketch")
    dealt = lambda d: d.repartition("f", "i", "j").sortWithinPartitions("f", "i", "j")
    possible = staged(arrow_map(dealt(pairs), partial(_possible, least=least), "f long, i int, j int, block int, sid long"), "possible")
    moved = dealt(possible.join(coded.select("sid", "m", "x", "filters"), "sid").select("f", "i", "j", "block", "sid", "m", "x", "filters"))
    found = staged(arrow_map(moved, partial(_linked, least=least, kind="<f4" if kind == "float" else "<f8"), "sid long, links long, root long"), "links")
    roots = components(found.filter("sid != root"), "sid", "root")
    counts = found.groupBy("sid").agg(F.sum("links").alias("links"))
    labels = classes.join(counts, "sid", "left").join(roots, classes["sid"] == roots["node"], "left").select("h1", "h2", "least", F.coalesce("root", "sid").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"))
    labels = staged(labels, "labels")
    label = labels.groupBy("comp").agg(F.min("least").alias("component"))
    labels = labels.join(label, "comp").select("h1", "h2", "links", "component", F.lit(True).alias("fine"))
    out = rows.select("vec_id", "h1", "h2", "fine").join(labels, ["h1", "h2", "fine"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(F.col("vec_id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
