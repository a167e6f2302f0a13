"""Text, Unicode, number and byte-order functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s ]+"


def words(s: Column) -> Column:
    """Runs of non-space characters; empty ones are dropped."""
    return F.filter(F.split(s, _SPACE), lambda w: w != "")


def count_words(s: Column) -> Column:
    """How many words: each is replaced by one character, without making arrays."""
    return (F.octet_length(F.regexp_replace(s, r"^\s+|\S+\s*", "x")) - s.rlike(r"^\s").cast("int")).cast("long")


def count_lines(s: Column) -> Column:
    """How many lines: newlines, and a last line that has none."""
    ended = F.endswith(s, F.lit("\n")) | (s == "")
    return (F.octet_length(s) - F.octet_length(F.replace(s, F.lit("\n"), F.lit(""))) + F.when(ended, 0).otherwise(1)).cast("long")


def word_counts(df, column: str, word: str = "word", n: str = "n"):
    """Each word of a text column with its count; words are counted in each task before they are shuffled."""
    each = df.select(F.explode(F.split(F.col(column), _SPACE)).alias(word))
    return each.filter(F.col(word) != "").groupBy(word).agg(F.count("*").alias(n))


def unwords(a: Column) -> Column:
    return F.array_join(a, " ")


def lines(s: Column) -> Column:
    """Lines ended by newline; a last line need not be."""
    whole = F.split(F.regexp_replace(s, r"\n\z", ""), "\n", -1)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(whole)


def unlines(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.concat(x, F.lit("\n"))), "")


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def replace_matches(s: Column, pattern: str, by: str) -> Column:
    """All leftmost, non-overlapping occurrences of a literal; an empty pattern changes nothing."""
    return F.replace(s, F.lit(pattern), F.lit(by)) if pattern else s


def split_sep_by_seq(s: Column, pattern: str) -> Column:
    """Infix split by a literal; the empty text has no parts."""
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, re.escape(pattern), -1))


def split_end_by_seq(s: Column, pattern: str) -> Column:
    """Parts that a literal ends; a rest without it counts, an empty rest does not."""
    parts = F.split(s, re.escape(pattern), -1)
    return F.when(s == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip_prefix(s: Column, prefix: str) -> Column:
    """Null if it does not begin so."""
    return F.when(F.startswith(s, F.lit(prefix)), F.substring(s, len(prefix) + 1, 1 << 30))


def decimal(s: Column) -> Column:
    return F.try_to_number(F.regexp_extract(s, r"^[0-9]+", 0), F.lit("9" * 18)).cast("long")


def hexadecimal(s: Column) -> Column:
    """Null for no digits and for more than 63 bits."""
    digits = F.regexp_extract(s, "^0*([0-9A-Fa-f]+)", 1)
    return F.when((F.length(digits) > 0) & (F.length(digits) <= 16), F.conv(digits, 16, 10).try_cast("long"))


def signed(s: Column) -> Column:
    return F.regexp_extract(s, "^[+-]?[0-9]+", 0).try_cast("long")


def double(s: Column) -> Column:
    return F.regexp_extract(s, r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?", 0).try_cast("double")


def encode_utf8(s: Column) -> Column:
    return F.encode(s, "UTF-8")


def decode_utf8_lax(b: Column) -> Column:
    """Malformed parts become U+FFFD."""
    return F.make_valid_utf8(b.cast("string"))


def decode_utf8_strict(b: Column) -> Column:
    """Null for malformed bytes."""
    return F.try_validate_utf8(b.cast("string"))


def encode_int(x: Column, width: int, big: bool = True) -> Column:
    """Two's complement bytes of a whole number."""
    digits = F.right(F.lpad(F.hex(x.cast("long")), 16, "0"), F.lit(2 * width))
    return F.unhex(digits if big else F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))), ""))


def decode_int(b: Column, width: int, big: bool = True, signed_: bool = True) -> Column:
    digits = F.hex(b) if big else F.array_join(F.reverse(F.regexp_extract_all(F.hex(b), F.lit("(..)"), F.lit(1))), "")
    value = F.conv(digits, 16, 10).cast("decimal(20,0)")
    whole = F.lit(str(1 << (8 * width))).cast("decimal(20,0)")
    return F.when((value * 2 >= whole) & F.lit(signed_), value - whole).otherwise(value).cast("long" if signed_ or width < 8 else "decimal(20,0)")


def path_join(a: Column, b: Column) -> Column:
    return F.concat(F.regexp_replace(a, "/+$", ""), F.lit("/"), b)


def path_file(p: Column) -> Column:
    return F.regexp_extract(p, r"([^/]*)/*$", 1)


def path_extension(p: Column) -> Column:
    return F.regexp_extract(path_file(p), r"^.+?(\.[^.]+)$", 1)


def split_by_one_of(s: Column, patterns: list[str]) -> Column:
    """Infix split by any of some literals, the longest that fits first; the empty text has no parts."""
    pattern = "|".join(re.escape(p) for p in sorted(patterns, key=len, reverse=True))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, pattern, -1))


def strip_suffix(s: Column, suffix: str) -> Column:
    """Null if it does not end so."""
    return F.when(F.endswith(s, F.lit(suffix)), F.left(s, F.length(s) - len(suffix)))


def take_until(s: Column, pattern: str, keep: bool = True) -> Column:
    """Up to and with (or without) the first occurrence of a literal; all if there is none."""
    at = F.instr(s, pattern)
    return F.when(at == 0, s).otherwise(F.left(s, at - 1 + F.lit(len(pattern) if keep else 0)))


def expand_vars(s: Column, values: Column) -> Column:
    """``$name`` and ``${name}`` replaced by a map's values, nothing for a name it has not."""
    names = F.regexp_extract_all(s, F.lit(r"\$(?:\{([A-Za-z_][A-Za-z0-9_]*)\}|([A-Za-z_][A-Za-z0-9_]*))"), F.lit(0))
    bare = F.transform(names, lambda n: F.regexp_replace(n, r"[${}]", ""))
    pieces = F.split(s, r"\$(?:\{[A-Za-z_][A-Za-z0-9_]*\}|[A-Za-z_][A-Za-z0-9_]*)", -1)
    filled = F.transform(bare, lambda n: F.coalesce(F.try_element_at(values, n), F.lit("")))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(pieces.alias("p"), filled.alias("f")), lambda x: F.array(x["p"], F.coalesce(x["f"], F.lit(""))))), "")


def rejoined(df, keys: list[str], order: list[str], chunk: str, end: str, name: str = "record"):
    """Records of chunked texts that each end with a literal, whatever chunks they lie in: (keys, at, record).

    A key's chunks are put together in one row, so a key's text must fit one.
    """
    whole = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(chunk).alias("__c")))).alias("__a"))
    text = F.array_join(F.transform("__a", lambda x: x["__c"]), "")
    return whole.select(*keys, F.posexplode(split_end_by_seq(text, end)).alias("at", name))
