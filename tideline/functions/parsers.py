"""Parsers, in two forms.

Over arrays: functions that give struct(ok, value, rest), where ``value`` is what was
taken from the front (null if it failed) and ``rest`` what is left (all of it then).

Over text: ``P``, a pattern built from smaller ones, which runs as one regular
expression in the JVM.  A pattern takes as much as it can and never gives back what
a part has taken, as parsers without backtracking do.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Test = Callable[[Column], Column]

# arrays


def _parsed(ok: Column, a: Column, n: Column) -> Column:
    """n items taken if ok."""
    return F.struct(ok.alias("ok"), F.when(ok, F.slice(a, F.lit(1), n)).alias("value"), F.when(ok, F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))).otherwise(a).alias("rest"))


def _run_length(a: Column, p: Test) -> Column:
    """How many items at the front p holds for (null is false)."""
    first = F.array_position(F.transform(a, lambda x: ~F.coalesce(p(x), F.lit(False))), True)
    return F.when(first == 0, F.size(a)).otherwise(first - 1).cast("int")


def take_between(a: Column, least: int, most: int) -> Column:
    return _parsed(F.size(a) >= least, a, F.least(F.size(a), F.lit(most)))


def take_eq(a: Column, n: int) -> Column:
    return take_between(a, n, n)


def take_ge(a: Column, n: int) -> Column:
    return _parsed(F.size(a) >= n, a, F.size(a))


def take_up_to(a: Column, n: int) -> Column:
    return take_between(a, 0, n)


def take_while(a: Column, p: Test, least: int = 0) -> Column:
    """The run that p holds for; least = 1 fails if there is none."""
    n = _run_length(a, p)
    return _parsed(n >= least, a, n)


def drop_while(a: Column, p: Test) -> Column:
    return take_while(a, p)["rest"]


def take_end_by(a: Column, p: Test, keep: bool = True) -> Column:
    """Up to the first item that p holds for, which is taken too (and left out of the value unless keep); all if there is none."""
    n = _run_length(a, lambda x: ~F.coalesce(p(x), F.lit(False)))
    whole = _parsed(F.lit(True), a, F.least(n + 1, F.size(a)))
    return whole if keep else whole.withField("value", F.slice(a, F.lit(1), n))


def take_begin_by(a: Column, p: Test, keep: bool = True) -> Column:
    """An item that p holds for and what follows it up to the next such; fails if the first is none (unless it is empty)."""
    begins = F.coalesce(p(F.get(a, F.lit(0))), F.lit(False))
    tail = F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    n = _run_length(tail, lambda x: ~F.coalesce(p(x), F.lit(False))) + 1
    whole = _parsed(begins | (F.size(a) == 0), a, F.least(n, F.size(a)))
    return whole if keep else whole.withField("value", F.when(whole["ok"], F.slice(a, F.lit(2), F.greatest(n - 1, F.lit(0)))))


def span(a: Column, p: Test) -> Column:
    """struct(yes, no): the run that p holds for and the rest."""
    taken = take_while(a, p)
    return F.struct(taken["value"].alias("yes"), taken["rest"].alias("no"))


def group_by(a: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The items at the front that are the same as the first; fails on the empty array."""
    n = _run_length(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), lambda x: same(F.get(a, F.lit(0)), x)) + 1
    return _parsed(F.size(a) > 0, a, F.least(n, F.size(a)))


def group_by_rolling(a: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The items at the front of which each is the same as the one before."""
    joined = F.transform(a, lambda x, i: (i == 0) | F.coalesce(same(F.get(a, i - 1), x), F.lit(False)))
    return _parsed(F.size(a) > 0, a, _run_length(joined, lambda x: x))


def list_eq(a: Column, items: Column) -> Column:
    """The items themselves at the front."""
    n = F.size(items)
    return _parsed(F.slice(a, F.lit(1), n).eqNullSafe(items), a, n)


def subsequence(a: Column, items: Column) -> Column:
    """Up to the place where all items have come in order, others between them."""
    left = F.aggregate(a, F.struct(F.lit(0).alias("k"), F.lit(0).alias("n")), lambda s, x: F.when(s["k"] == F.size(items), s).otherwise(F.struct((s["k"] + F.when(F.get(items, s["k"]).eqNullSafe(x), 1).otherwise(0)).alias("k"), (s["n"] + 1).alias("n"))))
    return _parsed(left["k"] == F.size(items), a, left["n"])


def satisfy(a: Column, p: Test) -> Column:
    """One item that p holds for."""
    return _parsed(F.coalesce(p(F.get(a, F.lit(0))), F.lit(False)) & (F.size(a) > 0), a, F.lit(1))


def one(a: Column) -> Column:
    return _parsed(F.size(a) > 0, a, F.lit(1))


def one_eq(a: Column, x: Column) -> Column:
    return satisfy(a, lambda y: y.eqNullSafe(x))


def one_not_eq(a: Column, x: Column) -> Column:
    return satisfy(a, lambda y: ~y.eqNullSafe(x))


def one_of(a: Column, xs: Column) -> Column:
    return satisfy(a, lambda y: F.array_contains(xs, y))


def none_of(a: Column, xs: Column) -> Column:
    return satisfy(a, lambda y: ~F.array_contains(xs, y))


def peek(a: Column) -> Column:
    """The first item, nothing taken; fails at the end."""
    return F.struct((F.size(a) > 0).alias("ok"), F.slice(a, 1, 1).alias("value"), a.alias("rest"))


def eof(a: Column) -> Column:
    return _parsed(F.size(a) == 0, a, F.lit(0))


def look_ahead(parsed: Column, a: Column) -> Column:
    """What a parser gives, nothing taken."""
    return parsed.withField("rest", a)


def alt(first: Column, second: Column) -> Column:
    """The first that succeeds."""
    return F.when(first["ok"], first).otherwise(second)


def split_with(first: Column, then: Callable[[Column], Column], a: Column) -> Column:
    """One parser, then another on what it leaves: struct(ok, first, second, rest)."""
    second = then(first["rest"])
    ok = first["ok"] & second["ok"]
    return F.struct(ok.alias("ok"), F.when(ok, first["value"]).alias("first"), F.when(ok, second["value"]).alias("second"), F.when(ok, second["rest"]).otherwise(a).alias("rest"))


def deintercalate(a: Column, separator: Test) -> Column:
    """struct(contents, separators): runs between separator items, and those items."""
    at = F.filter(F.transform(a, lambda x, i: F.when(separator(x), i)), lambda i: i.isNotNull())
    starts = F.concat(F.array(F.lit(0)), F.transform(at, lambda i: i + 1))
    ends = F.concat(at, F.array(F.size(a)))
    return F.struct(F.zip_with(starts, ends, lambda s, e: F.slice(a, s + 1, e - s)).alias("contents"), F.filter(a, separator).alias("separators"))


# text


class P:
    """A pattern over text; see the module."""

    def __init__(self, fragment: str):
        self.fragment = fragment

    def __add__(self, other: P) -> P:
        """One, then the other."""
        return P(self.fragment + other.fragment)

    def __or__(self, other: P) -> P:
        """The first that succeeds."""
        return P(f"(?>{self.fragment}|{other.fragment})")

    def many(self) -> P:
        return P(f"(?:{self.fragment})*+")

    def some(self) -> P:
        return P(f"(?:{self.fragment})++")

    def count(self, n: int) -> P:
        return P(f"(?:{self.fragment}){{{n}}}+")

    def between(self, least: int, most: int) -> P:
        return P(f"(?:{self.fragment}){{{least},{most}}}+")

    def optional(self) -> P:
        return P(f"(?:{self.fragment})?+")

    def many_till(self, end: P) -> P:
        """Repeated until end succeeds, which is taken."""
        return P(f"(?:(?!{end.fragment}){self.fragment})*+{end.fragment}")

    def sep_by(self, separator: P) -> P:
        return self.sep_by1(separator).optional()

    def sep_by1(self, separator: P) -> P:
        return P(f"{self.fragment}(?:{separator.fragment}{self.fragment})*+")

    def ahead(self) -> P:
        """Succeeds where this would, and takes nothing."""
        return P(f"(?={self.fragment})")

    def not_ahead(self) -> P:
        return P(f"(?!{self.fragment})")

    def value(self) -> P:
        """What this takes is the value of the whole (once in a pattern)."""
        return P(f"(?<v>{self.fragment})")

    # running it

    def _whole(self) -> str:
        return self.fragment if "(?<v>" in self.fragment else f"(?<v>{self.fragment})"

    def parse(self, s: Column) -> Column:
        """struct(ok, value, rest) for the front of a text."""
        pattern = rf"\A(?s:{self._whole()})"
        ok = s.rlike(pattern)
        taken = F.regexp_extract(s, pattern, 0)
        return F.struct(ok.alias("ok"), F.when(ok, F.regexp_extract(s, pattern, 1)).alias("value"), F.when(ok, F.substring(s, F.length(taken) + 1, F.length(s))).otherwise(s).alias("rest"))

    def parse_many(self, s: Column) -> Column:
        """The values of repeated parses from the front, until one fails or takes nothing."""
        return F.regexp_extract_all(s, F.lit(rf"\G(?=.)(?s:{self._whole()})"), F.lit(1))

    def parse_many_rest(self, s: Column) -> Column:
        """What repeated parses leave."""
        return F.regexp_replace(s, rf"\A(?s:{re.sub(r'[(][?]<v>', '(?:', self.fragment)})*+", "")


def any_char() -> P:
    return P("(?s:.)")


def char(c: str) -> P:
    return P(re.escape(c))


def char_ignore_case(c: str) -> P:
    return P(f"(?i:{re.escape(c)})")


def string(s: str) -> P:
    return P(re.escape(s))


def string_ignore_case(s: str) -> P:
    return P(f"(?i:{re.escape(s)})")


def chars_in(cs: str) -> P:
    return P("[" + "".join(re.escape(c) for c in cs) + "]")


def chars_not_in(cs: str) -> P:
    return P("[^" + "".join(re.escape(c) for c in cs) + "]")


def end() -> P:
    return P(r"\z")


#: Spaces, as many as there are, or one at least.
SPACES, SOME_SPACE = P(r"\s*+"), P(r"\s++")
DIGITS = P("[0-9]++")


def take_end_by_escaped(escape: str, ending: str) -> P:
    """Up to an ending character that no escape character stands before."""
    e, x = re.escape(escape), re.escape(ending)
    return P(f"(?<v>(?:[^{e}{x}]|{e}(?s:.))*+){x}")


def framed(opening: str, closing: str, escape: str | None = None) -> P:
    """What stands between an opening and the next closing character; escaped ones are inside."""
    o, c = re.escape(opening), re.escape(closing)
    inside = f"(?:[^{c}{re.escape(escape)}]|{re.escape(escape)}(?s:.))*+" if escape else f"[^{c}]*+"
    return P(f"{o}(?<v>{inside}){c}")


def nested_block(opening: str, closing: str, depth: int = 8) -> P:
    """An opening character and all up to the closing one that matches it, blocks inside counted, as deep as ``depth``."""
    o, c = re.escape(opening), re.escape(closing)
    block = f"{o}[^{o}{c}]*+{c}"
    for _ in range(depth - 1):
        block = f"{o}(?:[^{o}{c}]|{block})*+{c}"
    return P(block)


def words_by(separators: str) -> P:
    """Separators dropped, then a word up to the next."""
    s = "".join(re.escape(c) for c in separators)
    return P(f"[{s}]*+(?<v>[^{s}]++)")


def quoted_word(quotes: str = "\"'", escape: str = "\\") -> P:
    """A word up to white space outside quotes; quotes and escapes are kept."""
    q, e = "".join(map(re.escape, quotes)), re.escape(escape)
    parts = "|".join([f"[^{q}{e}\\s]", f"{e}(?s:.)", *(f"{re.escape(x)}(?:[^{re.escape(x)}{e}]|{e}(?s:.))*+{re.escape(x)}" for x in quotes)])
    return P(rf"\s*+(?<v>(?:{parts})++)")


def words_with_quotes(s: Column, keep: bool = False, quotes: str = "\"'", escape: str = "\\") -> Column:
    """The words of a text by quoting rules; quotes and escapes are taken off unless keep."""
    words = quoted_word(quotes, escape).parse_many(s)
    if keep:
        return words
    q, e = "".join(map(re.escape, quotes)), re.escape(escape)
    return F.transform(words, lambda w: F.regexp_replace(w, f"{e}((?s:.))|[{q}]", "$1"))


def spaced_outside_quotes(s: Column, separator: str, by: str, quote: str = '"') -> Column:
    """Every separator outside quotes replaced."""
    q = re.escape(quote)
    return F.regexp_replace(s, rf"\G((?:[^{q}{re.escape(separator)}]|{q}[^{q}]*+{q})*+){re.escape(separator)}", "$1" + by.replace("$", r"\$"))


def chain_left(s: Column, operators: dict[str, Callable[[Column, Column], Column]]) -> Column:
    """A chain of whole numbers with operators of one precedence, folded from the left; null if the text is no such chain."""
    ops = "".join(re.escape(o) for o in operators)
    numbers = F.transform(F.split(s, rf"\s*[{ops}]\s*", -1), lambda x: F.trim(x).try_cast("long"))
    signs = F.regexp_extract_all(s, F.lit(f"([{ops}])"), F.lit(1))

    def step(acc: Column, x: Column) -> Column:
        out = acc
        for o, f in operators.items():
            out = F.when(x["signs"] == o, f(acc, x["numbers"])).otherwise(out)
        return F.when(x["numbers"].isNull() | acc.isNull(), F.lit(None).cast("long")).otherwise(out).cast("long")

    rest = F.arrays_zip(signs.alias("signs"), F.slice(numbers, F.lit(2), F.size(signs)).alias("numbers"))
    return F.aggregate(rest, F.get(numbers, F.lit(0)), step)


def chain_right(s: Column, operator: str, f: Callable[[Column, Column], Column]) -> Column:
    """A chain of whole numbers with one operator, folded from the right."""
    numbers = F.reverse(F.transform(F.split(s, rf"\s*{re.escape(operator)}\s*", -1), lambda x: F.trim(x).try_cast("long")))
    return F.aggregate(F.slice(numbers, F.lit(2), F.size(numbers)), F.get(numbers, F.lit(0)), lambda acc, x: f(x, acc).cast("long"))
