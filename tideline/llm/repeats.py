"""Removal of strings that repeat anywhere in the corpus, by sorted suffixes.

A byte is removed if a string of ``length`` bytes that covers it also starts
somewhere else.  Sorting the suffixes at all positions moves hundreds of times
the corpus; here the suffixes sorted are those at anchors.  In every string of
``length`` bytes the position whose gram of ``gram`` bytes has the least hash is
an anchor, so equal strings have an anchor at the same place.

1. An anchor's context is the bytes before and after its gram that a string
   around it can reach.  Grams are counted, with the least and the greatest
   hash of their contexts.  Those that occur once are done with.  Where all
   contexts of a gram are equal every string around it repeats, and no bytes
   need to move.
2. The others send their contexts' bytes, those of a task that are equal once.  A
   hot gram, with more than ``HOT`` occurrences, sends each of its different
   contexts from one place only.  If there are more than ``WIDE`` of these, its
   splitters are longer: the strings around it are dealt, by how far before the
   anchor they start, into ``PIECES`` ranges, and all strings of a range share most
   of their bytes.  These leading bytes are counted as grams are.
3. Sampled splitters range-partition the contexts by their leading bytes, so
   equal ones share a bucket and no match crosses a boundary.  A bucket is read
   in their order, about ``HELD`` contexts at a time, and those are
   sorted by multikey quicksort (8 bytes a character), forwards from the anchor
   and backwards from it; neighbours' common lengths tell, for each place of
   the string around the anchor, which contexts agree on all of it.
4. The contexts found are joined with the places that have them (a row for each,
   without bytes), merged for each document and cut out.

Bit tables, sized by what they hold (``BITS``), say in the tasks which grams and
contexts matter; what passes beyond is told apart by exact joins or is harmless.

Null text counts as empty.  Matches never cross documents.  Repeated rows
repeat each other, so all their long strings go.  Leading bytes, and contexts
that are equal, are told apart by 64-bit hashes; the strings are compared byte by
byte.  Only the key and the text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import U64, mix, powers, text_buffer
from .staging import Both, arrow_map, bit_table, staged

LENGTH, GRAM = 200, 64
#: Bytes whose anchors are found at a time, about: the arrays of 8 bytes for each of them stay in the processor's cache.
CHUNK = 1 << 16
#: Multiplies a gram's hash before the least is taken (the hash of two grams may differ in its last bits only).
_SPREAD = 0xD6E8FEB86659FD93
#: Bits of a bit table: 8 to 16 for each entry, between these powers of two (beyond, more contexts pass than needed).
BITS = (20, 29)
#: Occurrences that make a gram hot, and different contexts from which on they are dealt further; contexts sorted at a time, about.
HOT, WIDE, HELD = 2000, 2000, 20_000
#: Ranges of places that the strings around a gram of very many contexts are dealt into.
PIECES = 8


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, offset in the row, bytes and bounds of pieces of texts; long texts come in pieces that overlap by length - 1."""
    data, bounds = text_buffer(column)
    rows: list[int] = []
    spans: list[tuple[int, int]] = []
    held = 0

    def out():
        parts = [data[s:e] for s, e in spans]
        at = np.cumsum([0, *(len(p) for p in parts)])
        return np.array(rows), np.array([s for s, _ in spans]) - bounds[rows], np.concatenate(parts), at

    for i in range(len(column)):
        s, e = int(bounds[i]), int(bounds[i + 1])
        while e - s >= length:
            cut = min(e, s + CHUNK)
            rows.append(i)
            spans.append((s, cut))
            held += cut - s
            if held >= CHUNK:
                yield out()
                rows.clear()
                spans.clear()
                held = 0
            if cut == e:
                break
            s = cut - length + 1
    if rows:
        yield out()


def _totals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums up to each byte, and the factors by which differences of them are the hashes from each byte."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    each = total[1:]
    np.add(data, U64(1), out=each, dtype=U64)
    each *= up[: len(data)]
    np.cumsum(each, out=each)
    return total, down


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors; each piece has length bytes at least."""
    n = len(data)
    total, down = _totals(data)
    count = n - gram + 1
    h = total[gram:] - total[:-gram]
    h *= down[:count]
    # the same for all pieces, so that of equal leading bits the first counts in each
    mask = U64((1 << max(n, 2 * CHUNK).bit_length()) - 1)
    width = length - gram + 1
    padded = np.full(-(-count // width) * width, ~U64(0), U64)
    spread = padded[:count]
    np.multiply(h, U64(_SPREAD), out=spread)
    spread &= ~mask
    spread |= np.arange(count, dtype=U64)
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(table, axis=1).ravel()
    windows = n - length + 1
    least = np.minimum(ahead[:windows], behind[width - 1 : width - 1 + windows])
    least = np.concatenate([least[s : e - length + 1] for s, e in zip(bounds[:-1], bounds[1:])])
    new = np.flatnonzero(least[1:] != least[:-1])
    at = (np.r_[least[:1], least[1:][new]] & mask).astype(np.int64)
    return at, mix(h[at])


def _unique_anchors(column: pa.Array, length: int, gram: int):
    """Pieces with their anchors; an anchor in the overlap of two pieces comes once."""
    last = -1
    for rows, offsets, data, bounds in _pieces(column, length):
        at, h = anchors(data, bounds, length, gram)
        piece = np.searchsorted(bounds, at, side="right") - 1
        place = at - bounds[piece] + offsets[piece]
        row = rows[piece]
        spot = (row.astype(np.int64) << 40) + place
        before = np.maximum.accumulate(np.r_[last, spot])
        fresh = spot > before[:-1]
        last = int(before[-1])
        yield data, bounds, at[fresh], h[fresh], piece[fresh], row[fresh], place[fresh]


class _Anchored:
    """A column's anchors (some at a time), and the ranges of places around them.

    A range is (anchor, key, first and last place, start and end of the context); key
    is the hash of the leading bytes, and start and end are in the column's bytes.
    """

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray, row: np.ndarray, place: np.ndarray, h: np.ndarray, length: int, gram: int):
        self.batch, self.data, self.row, self.place, self.h = batch, data, row, place, h
        self.length, self.reach = length, length - gram
        self.at = bounds[row] + place
        self.start, self.end = np.maximum(self.at - self.reach, bounds[row]), np.minimum(self.at + length, bounds[row + 1])
        self.base = int(self.start.min())
        part = data[self.base : int(self.end.max())]
        self.total, self.down = _totals(part)

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        start, end = start - self.base, end - self.base
        return mix((self.total[end] - self.total[start]) * self.down[start])

    def contexts(self, anchor: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        at = self.at[anchor]
        return self.hashed(start, end) ^ mix((at - start).astype(U64) * U64(1000003) + (end - at).astype(U64))

    def owners(self, anchor: np.ndarray) -> np.ndarray:
        """A hash of whose and which place it is: the batch has hashes of key and text in its second and third columns."""
        dh, th = (self.batch.column(k).to_numpy().view(U64)[self.row[anchor]] for k in (1, 2))
        return mix(dh ^ mix(th + self.place[anchor].astype(U64)))

    def whole(self) -> tuple[np.ndarray, ...]:
        n = len(self.h)
        return np.arange(n), self.h, np.zeros(n, np.int64), np.full(n, self.reach), self.start, self.end

    def pieces(self, of: np.ndarray) -> tuple[np.ndarray, ...]:
        """The ranges around some anchors."""
        parts = []
        for p, places in enumerate(np.array_split(np.arange(self.reach + 1), min(PIECES, self.reach + 1))):
            lo, hi = int(places[0]), int(places[-1])
            at = self.at[of]
            # places that have a whole string: as far as the text goes before and after the anchor
            fits = np.maximum(lo, self.length - (self.end[of] - at)) <= np.minimum(hi, at - self.start[of])
            a, at = of[fits], at[fits]
            salt = U64((p + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            key = mix(self.hashed(at - lo, at + self.length - hi) + salt)
            parts.append((a, key, np.full(len(a), lo), np.full(len(a), hi), np.maximum(at - hi, self.start[a]), np.minimum(at + self.length - lo, self.end[a])))
        return tuple(np.concatenate(c) for c in zip(*parts))

    def ranges(self, wide) -> tuple[np.ndarray, ...]:
        """Whole contexts, and pieces of those of the grams that the table (if there is one) holds."""
        whole = self.whole()
        if wide is None:
            return whole
        dealt = wide.test(self.h)
        return tuple(np.concatenate([x[~dealt], y]) for x, y in zip(whole, self.pieces(np.flatnonzero(dealt))))

    def all_ranges(self, wide, repeated, but) -> tuple[np.ndarray, ...]:
        """Whole contexts, and pieces of those of the grams that the first table (if there is one) holds.

        Contexts that the second table holds, but not the third, repeat as a whole and need no pieces.
        """
        whole = self.whole()
        if wide is None:
            return whole
        of = np.flatnonzero(wide.test(self.h))
        k = _pair(self.h[of], self.contexts(of, self.start[of], self.end[of]))
        of = of[~repeated.test(k) | but.test(k)]
        return tuple(np.concatenate([x, y]) for x, y in zip(whole, self.pieces(of)))


def _anchored(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[_Anchored]:
    """The anchors of batches whose last column is the text."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        data, bounds = text_buffer(column)
        for _, _, _, h, _, row, place in _unique_anchors(column, length, gram):
            if len(h):
                yield _Anchored(batch, data, bounds, row, place, h, length, gram)


def _firsts(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the columns, and where in it the different ones begin."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order, np.flatnonzero(new)


def _signed(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64) if c.dtype == U64 else c.astype(np.int64)) for c in columns]


def _grams(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Each gram with its count and the least and greatest hash of its contexts."""
    for anchored in _anchored(batches, length, gram):
        anchor, h, _, _, start, end = anchored.whole()
        c = anchored.contexts(anchor, start, end).view(np.int64)
        order, first = _firsts(h)
        h, c = h[order], c[order]
        yield pa.RecordBatch.from_arrays(_signed(h[first], np.diff(np.r_[first, len(h)]), np.minimum.reduceat(c, first), np.maximum.reduceat(c, first)), ["h", "n", "x", "y"])


def _hot(batches: Iterator[pa.RecordBatch], shared, pieces: bool, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Contexts around the grams that the table holds (or pieces of them), with count and one owner."""
    for anchored in _anchored(batches, length, gram):
        if pieces:
            anchor, h, _, _, start, end = anchored.pieces(np.flatnonzero(shared.value.test(anchored.h)))
        else:
            keep = shared.value.test(anchored.h)
            anchor, h, _, _, start, end = (x[keep] for x in anchored.whole())
        if not len(h):
            continue
        c = anchored.contexts(anchor, start, end)
        order, first = _firsts(h, c)
        owner = np.minimum.reduceat(anchored.owners(anchor)[order].view(np.int64), first)
        yield pa.RecordBatch.from_arrays(_signed(h[order][first], c[order][first], np.diff(np.r_[first, len(h)]), owner), ["h", "c", "n", "owner"])


def _contexts(batches: Iterator[pa.RecordBatch], mixed, hot, owners, wide, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Hashes, leading bytes, first and last place, before and after (bytes), and count of contexts that may match others."""
    for anchored in _anchored(batches, length, gram):
        ranges = anchored.ranges(wide and wide.value)
        keep = mixed.value.test(ranges[1])
        if hot:
            # the table also holds other grams, whose contexts have owners too; pieces have them whatever it holds
            keep &= ~(hot.value.test(ranges[1]) | (ranges[3] - ranges[2] < anchored.reach)) | owners.value.test(anchored.owners(ranges[0]))
        anchor, h, lo, hi, start, end = (x[keep] for x in ranges)
        if not len(h):
            continue
        c = anchored.contexts(anchor, start, end)
        order, first = _firsts(h, c)
        times, one = np.diff(np.r_[first, len(h)]), order[first]
        at, lo, hi, start, end = anchored.at[anchor[one]], lo[one], hi[one], start[one], end[one]
        parts = [_gathered(anchored.data, s, e) for s, e in ((at - lo, at + length - hi), (start, at), (at, end))]
        yield pa.RecordBatch.from_arrays([*_signed(h[one], c[one], lo, hi, times), *parts], ["h", "c", "lo", "hi", "times", "lead", "before", "after"])


def _pair(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(h ^ mix(c))


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with one hash of the hashes of gram and context."""
    for batch in batches:
        h, c = (batch.column(k).to_numpy().view(U64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([*batch.columns, *_signed(_pair(h, c))], [*batch.schema.names, "k"])


def _held(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    """The rows whose last column the table holds."""
    for batch in batches:
        yield batch.filter(pa.array(table.value.test(batch.column(batch.num_columns - 1).to_numpy().view(U64))))


def _places(batches: Iterator[pa.RecordBatch], found, wide, repeated, but, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Who has the contexts that the table holds, where, and how far they go before and after the anchor."""
    for anchored in _anchored(batches, length, gram):
        anchor, h, _, _, start, end = anchored.all_ranges(*(t and t.value for t in (wide, repeated, but)))
        c = anchored.contexts(anchor, start, end)
        keep = np.flatnonzero(found.value.test(_pair(h, c)))
        if not len(keep):
            continue
        a = anchor[keep]
        at, row = anchored.at[a], pa.array(anchored.row[a])
        yield pa.RecordBatch.from_arrays([*_signed(h[keep], c[keep]), anchored.batch.column(0).take(row), anchored.batch.column(2).take(row), *_signed(anchored.place[a], at - start[keep], end[keep] - at)], ["h", "c", "doc_id", "th", "at", "left", "right"])


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(starts - bounds[:-1], size) + np.arange(bounds[-1])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _matrix(column: pa.Array, width: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes, padded with zeros, and their lengths."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.diff(bounds)
    out = np.zeros((len(column), width), np.uint8)
    row = np.repeat(np.arange(len(column)), size)
    col = np.arange(bounds[-1] - bounds[0]) - np.repeat(bounds[:-1] - bounds[0], size)
    if backwards:
        col = size[row] - 1 - col
    out[row, col] = data[bounds[0] : bounds[-1]]
    return out, size


def multikey_sort(table: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the rows by group, then bytes, then size: multikey quicksort with characters of 8 bytes.

    Rows that are alone in their range of equal leading characters are left alone.
    """
    chars = np.ascontiguousarray(table).view(">u8")
    order = np.lexsort((size, group))
    of = group[order]
    new = np.r_[True, of[1:] != of[:-1]]
    for k in range(chars.shape[1]):
        rank = np.cumsum(new)
        alone = new & np.r_[new[1:], True]
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        c = chars[order[at], k].astype(U64)
        within = np.lexsort((c, rank[at]))
        order[at], c, r = order[at][within], c[within], rank[at][within]
        new[at] |= np.r_[True, (c[1:] != c[:-1]) | (r[1:] != r[:-1])]
    return order


def _common(table: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common length of each row, in order, with the one before it."""
    out = np.zeros(len(order), np.int64)
    for s in range(1, len(order), 8192):
        b = order[s : s + 8192]
        a = order[s - 1 : s - 1 + len(b)]
        differ = table[a] != table[b]
        n = np.where(differ.any(1), differ.argmax(1), table.shape[1])
        out[s : s + 8192] = np.minimum(n, np.minimum(size[a], size[b]))
    return out


def _ordered(table: np.ndarray, size: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by class and bytes, and each one's common length with the one before it (-1 at the first of a class)."""
    order = multikey_sort(table, size, cls)
    common = _common(table, size, order)
    common[1:][cls[order][1:] != cls[order][:-1]] = -1
    common[0] = -1
    return order, common


def _bucket(batches: Iterator[pa.RecordBatch], length: int, gram: int, most: int) -> Iterator[pa.RecordBatch]:
    """The first and last place of the strings around contexts that repeat; contexts come sorted by leading bytes and first place."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < most:
            continue
        lead = batch.column(5)
        cut = pc.not_equal(lead, lead[-1]).to_numpy(zero_copy_only=False)
        if cut.any():  # the last leading bytes may go on in the next batch
            at = int(np.flatnonzero(cut)[-1]) + 1
            yield from _compared([*held[:-1], batch.slice(0, at)], length, gram)
            held = [batch.slice(at)]
    if held:
        yield from _compared(held, length, gram)


def _compared(held: list[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    whole = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)
    if not whole:
        return
    whole = whole[0]
    n = whole.num_rows
    reach = length - gram
    lo, hi, times = (whole.column(k).to_numpy() for k in (2, 3, 4))
    lead = whole.column(5)
    same = pc.equal(lead[1:], lead[:-1]).to_numpy(zero_copy_only=False).astype(bool) & (lo[1:] == lo[:-1]) & (hi[1:] == hi[:-1])
    cls = np.cumsum(np.r_[True, ~same])
    after, a_size = _matrix(whole.column(7), -(-length // 8) * 8, False)
    before, b_size = _matrix(whole.column(6), -(-reach // 8) * 8, True)
    order, right = _ordered(after, a_size, cls)
    back, left = _ordered(before, b_size, cls)
    # only classes with several occurrences matter
    seen = np.bincount(cls, weights=times)[cls] > 1
    low, high = np.full(n, reach + 1), np.full(n, -1)
    ids = np.empty((2, n), np.int64)
    for o in range(reach + 1):  # the string starts o bytes before the anchor
        ids[0][order] = np.cumsum(right < length - o)
        ids[1][back] = np.cumsum(left < o)
        rows = np.flatnonzero(seen & (lo <= o) & (o <= hi) & (b_size >= o) & (a_size >= length - o))
        if not len(rows):
            continue
        _, inverse = np.unique(ids[0][rows] * (n + 1) + ids[1][rows], return_inverse=True)
        rows = rows[np.bincount(inverse, weights=times[rows])[inverse] > 1]
        low[rows] = np.minimum(low[rows], o)
        high[rows] = np.maximum(high[rows], o)
    rows = np.flatnonzero(high >= 0)
    yield pa.RecordBatch.from_arrays([whole.column(0).take(pa.array(rows)), whole.column(1).take(pa.array(rows)), pa.array(low[rows]), pa.array(high[rows])], ["h", "c", "low", "high"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            part = batch.slice(first, 512)
            kept, spans, sizes = [], [], []
            data, bounds = text_buffer(part.column(1))
            for i, found in enumerate(part.column(2).to_pylist()):
                text = data[bounds[i] : bounds[i + 1]].tobytes()
                runs: list[list[int]] = []
                for x in sorted((x["s"], x["e"]) for x in found or ()):
                    if runs and x[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x[1])
                    else:
                        runs.append(list(x))
                edges = [0, *(p for r in runs for p in r), len(text)]
                kept.append(b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2])))
                spans.append([{"start": s, "end": e} for s, e in runs])
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])


def _table(df: DataFrame, column: str = "h"):
    """A bit table of a column of hashes, sized by their count."""
    least, most = BITS
    return bit_table(df, column, min(most, max(least, (8 * df.count()).bit_length())))


def remove(df: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, removed (maximal spans, in bytes), kept (the other bytes).

    gram: bytes that an anchor is chosen by, below length.
    """
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(key)).alias("dh"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    how = {"length": length, "gram": gram}
    counts = arrow_map(docs.select("t"), partial(_grams, **how), "h long, n long, x long, y long").groupBy("h").agg(F.sum("n").alias("n"), F.min("x").alias("x"), F.max("y").alias("y")).filter("n > 1")
    grams = staged(counts.select("h", "x", (F.col("x") == F.col("y")).alias("alike"), (F.col("n") > HOT).alias("hot")), "grams")
    mixed, whole = grams.filter("not alike").select("h"), grams.filter("alike").select("h", F.col("x").alias("c"))
    hot = owners = wide = repeated = but = None
    if grams.filter("hot and not alike").limit(1).count():
        # different contexts of the hot grams, once each
        around = lambda table, pieces: staged(arrow_map(docs, partial(_hot, shared=table, pieces=pieces, **how), "h long, c long, n long, owner long").groupBy("h", "c").agg(F.sum("n").alias("n"), F.min("owner").alias("owner")), "hot")
        hot = _table(grams.filter("hot and not alike"))
        contexts = around(hot, False)
        many = contexts.groupBy("h").agg(F.count("*").alias("m")).filter(F.col("m") > WIDE).select("h")
        if many.limit(1).count():
            wide = Both(_table(many), hot)  # so that contexts has all that passes
            pieces = around(wide, True)
            several = pieces.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1").select("h")
            mixed = mixed.union(several)
            whole = whole.union(pieces.filter("n > 1").select("h", "c"))
            # contexts that repeat as a whole, and those that only the bit table takes for such
            paired = arrow_map(contexts.select("h", "c", "n"), _paired, "h long, c long, n long, k long")
            repeated = _table(paired.filter("n > 1"), "k")
            but = _table(arrow_map(paired.filter("n = 1").select("k"), partial(_held, table=repeated), "k long"), "k")
            contexts = contexts.union(pieces.join(several, "h"))
        owners = _table(contexts, "owner")
        whole = whole.union(contexts.filter("n > 1").select("h", "c"))
    binary = "lead binary, before binary, after binary"
    met = arrow_map(docs, partial(_contexts, mixed=_table(mixed), hot=hot, owners=owners, wide=wide, **how), f"h long, c long, lo long, hi long, times long, {binary}")
    met = arrow_map(met.repartitionByRange("lead").sortWithinPartitions("lead", "lo"), partial(_bucket, most=HELD, **how), "h long, c long, low long, high long")
    none = F.lit(None).cast("long")
    found = met.union(whole.select("h", "c", none.alias("low"), none.alias("high"))).groupBy("h", "c")
    # a context without places is whole: all strings around the anchor repeat
    least = lambda f, c: F.when(F.count(c) == F.count(F.lit(1)), f(c)).alias(c)
    found = found.agg(least(F.min, "low"), least(F.max, "high"))
    found = staged(arrow_map(found, _paired, "h long, c long, low long, high long, k long"), "found")
    places = arrow_map(docs, partial(_places, found=_table(found, "k"), wide=wide, repeated=repeated, but=but, **how), f"h long, c long, doc_id {kind}, th long, at long, left long, right long")
    high, low = F.coalesce("high", "left"), F.coalesce(length - F.col("low"), F.col("right"))
    spans = places.join(found.drop("k"), ["h", "c"]).select("doc_id", "th", (F.col("at") - high).alias("s"), (F.col("at") + low).alias("e"))
    spans = staged(spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "e")).alias("found")), "spans")
    both = docs.alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.th") == F.col("s.th")), "left").select("d.doc_id", "t", "found")
    out = arrow_map(both, _cut, f"doc_id {kind}, n_bytes long, removed array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumnRenamed("doc_id", key) if key != "doc_id" else out
