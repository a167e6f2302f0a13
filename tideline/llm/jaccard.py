"""N-gram Jaccard join: size-aware, heavy and light sets apart, exact.

A document is the set of its distinct word shingles (64-bit hashes).  Equal
sets are one class from the start.  Tokens are ordered by frequency, rare ones
first, and of two linked sets of n shingles each the smallest common tokens lie
among the first e + 1 (the two smallest: e + 2), where e = n - ceil(t * n).

* Small sets: all subsets of two tokens of the first e + 2 are enumerated; a
  linked pair has one in common.
* Large sets: the inverted lists of the first e + 1 tokens are scanned.  Of two
  sets of n and m shingles that are linked, c or more are common, so their first
  common token is among the first n - c + 1 of the one and m - c + 1 of the
  other; other meetings are left out.
* The boundary is the size where enumerating costs what scanning does, from
  the median length of the lists.

Hot groups: before the join, pairs of each MinHash bucket's members with a
pivot (the set whose shingles are the most frequent, as the original of many
near copies is) are verified and linked, and the join then leaves out pairs that are
in one component already, so a group of thousands of near copies is a star,
not all its pairs.  Lists whose sets are all in one component are dropped.
Every link is verified on the whole sets.  Before the texts are moved for that,
pairs are left out by parity bitmaps: each set has PARITY bits, one flipped for
every shingle, and two sets differ in at least as many shingles as their bitmaps
in bits, so no link is lost.

``percent`` is 51 to 100: from one half down, sets of one and two shingles link by a
single common one, which two-token subsets do not see.

Null text, empty text and texts without words have no set and link with
nothing.  Repeated rows share their class; rows are told apart by a number
staged with them, so ids may repeat.  Only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .grid import U64, chunks, mix, not_space, packed, shingles, word_hashes, LOWER
from .staging import arrow_map, bit_table, give_back, staged

BANDS, BAND_ROWS = 6, 3
#: Pivots tried for each set before the exact join.
PIVOTS = 2
#: Frequencies kept for the order of tokens, at most (16 MB).  The order decides cost only, never the result.
FREQUENT = 1_000_000
#: Hashes counted at a time in a task.
COUNTED = 1_500_000
BITS, DOC_BITS = 26, 24
#: Sets that are compared with another one in one task, about.
TOGETHER = 64
#: Bits of a set's parity bitmap.
PARITY = 2048
_WORD = not_space()


def _sets(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, by row and hash, and the rows' bounds."""
    h, _, _, wb = word_hashes(LOWER[data], bounds, _WORD)
    x, row, _ = shingles(h, wb, k, whole_short=True)
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    x, row = x[first], row[first]
    return x, np.searchsorted(row, np.arange(len(bounds)))


def _count(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Shingles that several rows among some millions have, with counts."""
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        x, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x[n > 1].view(np.int64)), pa.array(n[n > 1])], ["h", "n"])

    for batch in batches:
        for _, _, data, bounds in chunks(batch.column(0)):
            held.append(_sets(data, bounds, k)[0])
            if sum(map(len, held)) > COUNTED:
                yield out()
    if held:
        yield out()


def _prefixes(batches: Iterator[pa.RecordBatch], shared, k: int, percent: int) -> Iterator[pa.RecordBatch]:
    known, freq = (np.frombuffer(x, t) for x, t in zip(shared.value, (U64, np.int64)))
    seeds = mix(np.arange(1, BANDS * BAND_ROWS + 4, dtype=U64) * U64(0x9E3779B97F4A7C15))
    for batch in batches:
        for a, b, data, bounds in chunks(batch.column(batch.num_columns - 1)):
            x, sb = _sets(data, bounds, k)
            n = np.diff(sb)
            some = np.flatnonzero(n)
            zero = np.zeros(b - a, U64)
            digests, bands = [zero.copy(), zero.copy()], [zero.copy() for _ in range(BANDS)]
            prefix, pb = np.zeros(0, U64), np.zeros(b - a + 1, np.int64)
            central = np.zeros(b - a)
            parity = np.zeros((b - a) * (PARITY // 64), U64)
            if len(some):
                for j in range(2):
                    digests[j][some] = np.add.reduceat(mix(x ^ seeds[j]), sb[some])
                for j in range(BANDS):
                    rows = [np.minimum.reduceat(mix(x ^ seeds[2 + j * BAND_ROWS + i]), sb[some]) for i in range(BAND_ROWS)]
                    bands[j][some] = mix(rows[0] + mix(rows[1] + mix(rows[2] + U64(j))))
                row = np.repeat(np.arange(b - a), n)
                bit = mix(x ^ seeds[-1]) % U64(PARITY)
                np.bitwise_xor.at(parity, row * (PARITY // 64) + (bit >> U64(6)).astype(np.int64), U64(1) << (bit & U64(63)))
                f = np.zeros(len(x), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    f = np.where(known[at] == x, freq[at], 0)
                central[some] = np.add.reduceat(np.log1p(f), sb[some]) / n[some]
                order = np.lexsort((x, f, row))
                size = np.minimum(n, n + (-percent * n) // 100 + 2)  # e + 2
                prefix = x[order][np.arange(len(x)) - sb[row] < size[row]]
                pb = np.concatenate([[0], np.cumsum(size)])
            cols = [pa.array(n.astype(np.int64)), pa.array(central), *(pa.array(d.view(np.int64)) for d in digests), packed(np.stack(bands, 1).reshape(-1).view(np.int64), np.arange(b - a + 1) * BANDS, pa.int64()), packed(prefix.view(np.int64), pb, pa.int64()), packed(parity.view(np.int64), np.arange(b - a + 1) * (PARITY // 64), pa.int64())]
            yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[:-1]), *cols], [*batch.schema.names[:-1], "n", "central", "d1", "d2", "bands", "prefix", "parity"])


def _verify(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """a and b of the pairs that are similar enough.

    Rows are (b, chunk, role, a, t), sorted by the first three: b's own text (role 0),
    then those of the sets to compare with it.
    """
    at, hub = None, np.zeros(0, U64)
    for batch in batches:
        b, chunk, role, a = (batch.column(c).to_numpy() for c in range(4))
        good = np.zeros(batch.num_rows, bool)
        for first, _, data, bounds in chunks(batch.column(4)):
            x, sb = _sets(data, bounds, k)
            for i, (s, e) in enumerate(zip(sb, sb[1:]), first):
                if role[i] == 0:
                    at, hub = (b[i], chunk[i]), x[s:e].copy()
                elif e > s and len(hub):
                    assert at == (b[i], chunk[i])
                    place = np.minimum(np.searchsorted(hub, x[s:e]), len(hub) - 1)
                    both = int((hub[place] == x[s:e]).sum())
                    good[i] = both > 0 and 100 * both >= percent * (len(hub) + int(e - s) - both)
        yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])


def _crossing(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The prefixes' tokens that the bit table holds, with their places."""
    table = shared.value
    for batch in batches:
        prefix = batch.column(batch.num_columns - 1)
        values = prefix.flatten().to_numpy(zero_copy_only=False)
        size = np.diff(prefix.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), size)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        hit = np.flatnonzero(table.test(values.view(U64)))
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row[hit])) for c in batch.columns[:-1]), pa.array(values[hit]), pa.array(pos[hit].astype(np.int32))], [*batch.schema.names[:-1], "h", "pos"])


def _wanted(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The rows whose key (first column) the bit table holds."""
    for batch in batches:
        yield batch.filter(pa.array(shared.value.test(batch.column(0).to_numpy().view(U64))))


def _frequencies(docs: DataFrame, k: int):
    """The most frequent shingles with counts over all documents (those of one row among millions left out)."""
    counts = staged(arrow_map(docs, partial(_count, k=k), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "frequencies")
    level = F.floor(F.log2("n") * 8).cast("int")
    least, total = 1 << 20, 0
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("c")).orderBy(F.desc("level")).collect():  # at most 512 rows
        total += r["c"]
        if total > FREQUENT:
            break
        least = r["level"]
    top = counts.filter(level >= least).toArrow()
    h, n = (top.column(c).to_numpy() for c in ("h", "n")) if top.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(h.view(U64))
    return docs.sparkSession.sparkContext.broadcast((h[order].astype(np.int64).tobytes(), n[order].astype(np.int64).tobytes()))


def _missing(n: str, percent: int):
    """e: how many of a set's n tokens a linked set may lack."""
    return F.col(n) - F.ceil(F.col(n) * percent / F.lit(100)).cast("long")


def _possible(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs of (a, b) whose parity bitmaps differ in no more bits than linked sets of their sizes in shingles."""
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    maps = staged(wanted.join(rows.select(F.col("row").alias("sid"), "n", "parity"), "sid"), "parities")
    of = lambda x: maps.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    # s shingles in both sets together, of which linked sets have percent * s / (100 + percent) in common or more
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, rows: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The linked pairs of (a, b); only the texts of sets in a possible pair are moved."""
    pairs = staged(_possible(staged(pairs, "pairs"), rows, percent), "possible")
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct().join(sets.select("sid", "doc_id", "th"), "sid")
    wanted = staged(wanted, "wanted")
    key = F.xxhash64("doc_id", "th").alias("k")
    texts = docs.select("doc_id", F.xxhash64("t").alias("th"), "t").select(key, "doc_id", "th", "t")
    texts = arrow_map(texts, partial(_wanted, shared=bit_table(wanted.select(key), "k", DOC_BITS)), texts.schema)
    texts = wanted.join(texts, wanted["doc_id"].eqNullSafe(texts["doc_id"]) & (wanted["th"] == texts["th"])).select("sid", "t")
    # a set that many are compared with is sent once for every TOGETHER of them
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("m"))
    dealt = staged(pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("m")).cast("int").alias("chunk")), "dealt")
    roles = dealt.select("b", "chunk", F.lit(1).alias("role"), F.col("a").alias("sid")).union(dealt.select("b", "chunk", F.lit(0), "b").distinct())
    rows = roles.join(texts, "sid").select("b", "chunk", "role", F.col("sid").alias("a"), "t")
    rows = rows.repartition("b", "chunk").sortWithinPartitions("b", "chunk", "role")
    return staged(arrow_map(rows, partial(_verify, k=k, percent=percent), "a long, b long").distinct(), "links")


def classes(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles, component_id (smallest key reachable by links, itself included)."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    docs = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    shared = _frequencies(docs.select("t"), words)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("t").alias("th"), "t")
    rows = staged(arrow_map(rows, partial(_prefixes, shared=shared, k=words, percent=percent), f"row long, doc_id {kind}, th long, n long, central double, d1 long, d2 long, bands array<bigint>, prefix array<bigint>, parity array<bigint>"), "sets")
    give_back(docs.sparkSession)  # here and below: what the driver has freed over the many plans before
    some = rows.filter("n > 0")
    sets = staged(some.groupBy("d1", "d2").agg(F.min(F.struct("row", "doc_id", "th", "n", "central", "bands")).alias("r"), F.min("doc_id").alias("least")).select("d1", "d2", F.col("r.row").alias("sid"), "r.doc_id", "r.th", "r.n", "r.central", "r.bands", "least"), "classes")

    # Stars: every set of a bucket with the bucket's pivot.
    buckets = sets.select("sid", "n", "central", F.posexplode("bands").alias("band", "key"))
    pivots = buckets.groupBy("band", "key").agg(F.max(F.struct("central", "n", "sid")).alias("p"), F.count("*").alias("m")).filter("m > 1").select("band", "key", F.col("p.sid").alias("b"), F.col("p.n").alias("nb"))
    stars = buckets.join(pivots, ["band", "key"]).filter((F.col("sid") != F.col("b")) & (100 * F.least("n", "nb") >= percent * F.greatest("n", "nb")))
    stars = stars.groupBy(F.col("sid").alias("a"), "b").agg(F.count("*").alias("m")).groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("m", "b")), asc=False), 1, PIVOTS).alias("p"))  # a set has BANDS pivots at most
    first = _verified(stars.select("a", F.explode("p.b").alias("b")), sets, rows, docs, words, percent)
    give_back(docs.sparkSession)
    roots = staged(components(first), "roots")
    give_back(docs.sparkSession)

    # The exact join, between components only.
    tokens = sets.join(roots, sets["sid"] == roots["node"], "left").select("sid", F.coalesce("root", "sid").alias("comp"), "n")
    tokens = staged(tokens.join(rows.select(F.col("row").alias("sid"), "prefix"), "sid"), "tokens")
    lists = tokens.select("comp", F.explode("prefix").alias("h")).groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m")).filter("x < y")
    lists = staged(lists.select("h", "m"), "lists")
    postings = staged(arrow_map(tokens.select("sid", "comp", "n", "prefix"), partial(_crossing, shared=bit_table(lists, "h", BITS)), "sid long, comp long, n long, h long, pos int"), "postings")
    usual = lists.agg(F.percentile_approx("m", 0.5)).first()[0] or 1
    # enumerating: (p + 1) p / 2 subsets; scanning: p lists of the usual length; p = e + 1
    boundary = int(max(0, 2 * usual - 1) * 100 / max(100 - percent, 1))
    small = postings.filter(F.col("n") <= boundary)
    two = small.alias("x").join(small.select("sid", F.col("h").alias("g"), F.col("pos").alias("q")), "sid").filter("pos < q")
    two = two.select("sid", "comp", "n", F.xxhash64("h", "g").alias("s"))
    mixed = two.groupBy("s").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("s")
    two = two.join(mixed, "s")
    near = (F.col("x.comp") < F.col("y.comp")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
    light = two.alias("x").join(two.alias("y"), (F.col("x.s") == F.col("y.s")) & near).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()
    large = postings.filter((F.col("n") * 100 >= percent * boundary) & (F.col("pos") <= _missing("n", percent)))
    both = F.col("x.n") + F.col("y.n")
    common = F.ceil(both * percent / F.lit(100 + percent))  # tokens that a linked pair has in common, at least
    early = (F.col("x.pos") <= F.col("x.n") - common) & (F.col("y.pos") <= F.col("y.n") - common)  # so its first one stands here
    heavy = large.alias("x").join(large.alias("y"), (F.col("x.h") == F.col("y.h")) & near & (F.greatest("x.n", "y.n") > boundary) & early)
    heavy = heavy.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()
    links = first.union(_verified(light.union(heavy).distinct(), sets, rows, docs, words, percent))

    give_back(docs.sparkSession)
    roots = components(links)
    labels = sets.join(roots, sets["sid"] == roots["node"], "left").select("d1", "d2", F.coalesce("root", "sid").alias("comp"), "least")
    labels = staged(labels, "labels")
    label = labels.groupBy("comp").agg(F.min("least").alias("component"))
    labels = labels.join(label, "comp").select("d1", "d2", "component")
    out = rows.select("doc_id", "n", "d1", "d2").join(labels.withColumn("n0", F.lit(0)), ["d1", "d2"], "left")
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
