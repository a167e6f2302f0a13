"""Array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def get_index(a: Column, i: int) -> Column:
    """Element from 0, null if there is none."""
    return F.get(a, F.lit(i))


def get_index_rev(a: Column, i: int) -> Column:
    return F.get(a, F.size(a) - 1 - F.lit(i))


def last_n(a: Column, n: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)


def chunks_of(a: Column, n: int) -> Column:
    ends = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(n))
    return F.when(F.size(a) > 0, F.transform(ends, lambda i: F.slice(a, i, n))).otherwise(F.array(a))


def find_indices(a: Column, p) -> Column:
    return F.filter(F.transform(a, lambda x, i: F.when(p(x), i)), lambda i: i.isNotNull())


def drop_while(a: Column, p) -> Column:
    """Without the longest prefix that p holds for: from the first element it fails on."""
    first = F.array_position(F.transform(a, lambda x: ~p(x)), True)
    return F.when(first == 0, F.slice(a, 1, 0)).otherwise(F.slice(a, F.greatest(first, F.lit(1)).cast("int"), F.size(a)))


def drop_around(a: Column, p) -> Column:
    return F.reverse(drop_while(F.reverse(drop_while(a, p)), p))


def splice(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def partition(a: Column, p) -> Column:
    return F.struct(F.filter(a, p).alias("yes"), F.filter(a, lambda x: ~p(x)).alias("no"))


def byte_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: shorter first, bytes decide between equal lengths."""
    n, m = F.octet_length(a), F.octet_length(b)
    return F.when(n < m, -1).when(n > m, 1).when(a < b, -1).when(a > b, 1).otherwise(0)


def is_prefix(a: Column, b: Column) -> Column:
    return F.slice(b, 1, F.size(a)) == a


def is_suffix(a: Column, b: Column) -> Column:
    return is_prefix(F.reverse(a), F.reverse(b))


def is_subsequence(a: Column, b: Column) -> Column:
    """All of a, in order, somewhere in b."""
    left = F.aggregate(b, F.lit(1), lambda k, x: F.when(F.get(a, k - 1).eqNullSafe(x) & (k <= F.size(a)), k + 1).otherwise(k))
    return left > F.size(a)


def head(a: Column) -> Column:
    return F.get(a, F.lit(0))


def last(a: Column) -> Column:
    return get_index_rev(a, 0)


def tail(a: Column) -> Column:
    """Null for the empty array, as for init."""
    return F.when(F.size(a) > 0, F.slice(a, F.lit(2), F.size(a)))


def init(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1))


def uncons(a: Column) -> Column:
    """struct(head, tail), null for the empty array."""
    return F.when(F.size(a) > 0, F.struct(head(a).alias("head"), tail(a).alias("tail")))


def unsnoc(a: Column) -> Column:
    """struct(init, last), null for the empty array."""
    return F.when(F.size(a) > 0, F.struct(init(a).alias("init"), last(a).alias("last")))


def slice_of(a: Column, start: Column | int, length: Column | int) -> Column:
    """From a position (from 0), so many items or as many as there are."""
    start, length = (F.lit(x) if isinstance(x, int) else x for x in (start, length))
    return F.slice(a, start + 1, length)


def slices_of(a: Column, start: int, length: int) -> Column:
    """Slices of one length from a position on; the last may be shorter."""
    return F.filter(chunks_of(F.slice(a, F.lit(start + 1), F.greatest(F.size(a) - start, F.lit(0))), length), lambda c: F.size(c) > 0)


def indices_from_then_to(a: Column, start: int, then: int, end: int) -> Column:
    """The items at start, then, ... up to end, as far as there are such."""
    at = F.sequence(F.lit(start), F.lit(end), F.lit(then - start))
    return F.transform(F.filter(at, lambda i: i < F.size(a)), lambda i: F.get(a, i))


def split_at(a: Column, n: Column | int) -> Column:
    """struct(before, after)."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.struct(F.slice(a, F.lit(1), n).alias("before"), F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0))).alias("after"))


def break_end_by(a: Column, p, keep: bool = True) -> Column:
    """struct(before, after): before ends with the first item that p holds for (or before it); after is empty if there is none."""
    first = F.coalesce(F.get(find_indices(a, p), F.lit(0)), F.size(a))
    whole = split_at(a, F.least(first + 1, F.size(a)))
    return whole if keep else whole.withField("before", F.slice(a, F.lit(1), first))


def break_end_by_last(a: Column, p, keep: bool = True) -> Column:
    """struct(before, after): after begins behind the last item that p holds for; before is empty if there is none."""
    at = F.coalesce(last(find_indices(a, p)), F.lit(-1))
    whole = split_at(a, at + 1)
    return whole if keep else whole.withField("before", F.slice(a, F.lit(1), F.greatest(at, F.lit(0))))


def split_end_by(a: Column, p, keep: bool = True) -> Column:
    """Parts that each end with an item that p holds for (left out unless keep); a rest without one counts."""
    at = find_indices(a, p)
    starts = F.concat(F.array(F.lit(0)), F.transform(at, lambda i: i + 1))
    ends = F.concat(F.transform(at, lambda i: i + (1 if keep else 0)), F.array(F.size(a)))
    parts = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), F.slice(a, s + 1, F.greatest(e - s, F.lit(0))).alias("v")))
    rest = F.filter(parts, lambda x: x["s"] < F.size(a))
    return F.transform(rest, lambda x: x["v"])


def split_on(a: Column, p) -> Column:
    """Parts between the items that p holds for."""
    at = find_indices(a, p)
    starts = F.concat(F.array(F.lit(0)), F.transform(at, lambda i: i + 1))
    return F.zip_with(starts, F.concat(at, F.array(F.size(a))), lambda s, e: F.slice(a, s + 1, e - s))


def concat_sep_by(a: Column, separator: Column) -> Column:
    """Arrays one after another with an item between two."""
    return F.flatten(F.transform(a, lambda x, i: F.when(i > 0, F.concat(F.array(separator), x)).otherwise(x)))


def concat_end_by(a: Column, end: Column) -> Column:
    """Arrays one after another, each with an item after it."""
    return F.flatten(F.transform(a, lambda x: F.concat(x, F.array(end))))


def compact_max(a: Column, most: int) -> Column:
    """Neighbouring arrays joined as long as the join has at most so many items; longer ones stay as they are."""
    def step(acc, x):
        now = last(acc)
        fits = (F.size(acc) > 0) & (F.size(now) + F.size(x) <= most)
        return F.when(fits, F.concat(init(acc), F.array(F.concat(now, x)))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(a, F.slice(a, 1, 0), step)


def compact_min(a: Column, least: int) -> Column:
    """Neighbouring arrays joined until the join has so many items; the last may have fewer."""
    def step(acc, x):
        now = last(acc)
        short = (F.size(acc) > 0) & (F.size(now) < least)
        return F.when(short, F.concat(init(acc), F.array(F.concat(now, x)))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(a, F.slice(a, 1, 0), step)


def put_index(a: Column, i: Column | int, x: Column) -> Column:
    """The item at a position replaced; no change if there is none."""
    return modify_index(a, i, lambda _: x)


def put_indices(a: Column, at: Column, x: Column) -> Column:
    return F.transform(a, lambda y, k: F.when(F.array_contains(at, k), x).otherwise(y))


def modify_index(a: Column, i: Column | int, f) -> Column:
    return F.transform(a, lambda y, k: F.when(k == i, f(y)).otherwise(y))


def modify_indices(a: Column, at: Column, f) -> Column:
    return F.transform(a, lambda y, k: F.when(F.array_contains(at, k), f(y, k)).otherwise(y))


def swap_indices(a: Column, i: int, j: int) -> Column:
    return F.transform(a, lambda y, k: F.when(k == i, F.get(a, F.lit(j))).when(k == j, F.get(a, F.lit(i))).otherwise(y))


def insert_last_of(a: Column, x: Column, n: int) -> Column:
    """A ring of the last n items: x put in, the oldest out if it is full."""
    return last_n(F.concat(a, F.array(x)), n)


def rotated(a: Column, by: int) -> Column:
    """The ring read from another place: by items forward (or back)."""
    n = F.pmod(F.lit(by), F.greatest(F.size(a), F.lit(1)))
    return F.concat(F.slice(a, n + 1, F.size(a)), F.slice(a, F.lit(1), n))


def range_of(a: Column) -> Column:
    """struct(least, greatest), null for the empty array."""
    return F.when(F.size(a) > 0, F.struct(F.array_min(a).alias("least"), F.array_max(a).alias("greatest")))


def merge_by(a: Column, b: Column) -> Column:
    """Two sorted arrays in one sorted array."""
    return F.array_sort(F.concat(a, b))


def divide_by(a: Column, p) -> Column:
    """Items that p does not hold for, then the others, both in their order."""
    return F.concat(F.filter(a, lambda x: ~p(x)), F.filter(a, p))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: by the first items that differ, a prefix is smaller."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def fold(a: Column, zero: Column, step, right: bool = False) -> Column:
    return F.aggregate(F.reverse(a) if right else a, zero, step)


def binary_search(a: Column, x: Column) -> Column:
    """The position of x in a sorted array, null if it is not there."""
    i = F.array_position(a, x)
    return F.when(i > 0, i - 1)


def strip_prefix(a: Column, prefix: Column) -> Column:
    """Null if it does not begin so."""
    return F.when(is_prefix(prefix, a), F.slice(a, F.size(prefix) + 1, F.size(a)))


def strip_suffix(a: Column, suffix: Column) -> Column:
    return F.when(is_suffix(suffix, a), F.slice(a, F.lit(1), F.greatest(F.size(a) - F.size(suffix), F.lit(0))))


def is_infix(a: Column, b: Column) -> Column:
    """All of a, one after another, somewhere in b."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(b) - F.size(a) + 1, F.lit(1)))
    return (F.size(a) == 0) | F.exists(starts, lambda s: F.slice(b, s, F.greatest(F.size(a), F.lit(1))) == a)
