"""Codecs, normal forms, floats as bytes.

What the JVM side offers is used as it is; normal forms go through Python a few
rows at a time, as texts can be long, and the bytes of floats in Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT_LATIN1 = r"[^\x{0}-\x{ff}]"


def encode_latin1(s: Column) -> Column:
    """Null if a character has no byte."""
    return F.when(~s.rlike(_NOT_LATIN1), F.encode(F.regexp_replace(s, _NOT_LATIN1, "?"), "ISO-8859-1"))


def encode_latin1_lax(s: Column) -> Column:
    """A question mark for every character that has no byte."""
    return F.encode(F.regexp_replace(s, _NOT_LATIN1, "?"), "ISO-8859-1")


def decode_latin1(b: Column) -> Column:
    return F.decode(b, "ISO-8859-1")


def encode_utf16(s: Column, big: bool = False) -> Column:
    return F.encode(s, "UTF-16BE" if big else "UTF-16LE")


def decode_utf16(b: Column, big: bool = False) -> Column:
    return F.decode(b, "UTF-16BE" if big else "UTF-16LE")


def swap_bytes(b: Column) -> Column:
    """The two bytes of each unit changed over; the length is even."""
    return F.unhex(F.regexp_replace(F.hex(b), "(..)(..)", "$2$1"))


def normalize(s: Column, form: str = "NFC") -> Column:
    """Unicode normal form: NFC, NFD, NFKC or NFKD."""

    def normal(t: str | None) -> str | None:
        import unicodedata

        return t if t is None or t.isascii() else unicodedata.normalize(form, t)

    # pickled, 100 rows at a time; an Arrow batch would hold 10,000 whole texts, and each result of them
    return F.udf(normal, "string", useArrow=False)(s)


def is_ascii_alpha(s: Column) -> Column:
    return s.rlike(r"\A[A-Za-z]+\z")


def encode_float(x: Column, width: int = 8, big: bool = True) -> Column:
    """IEEE 754 bytes of a float of 4 or 8 bytes."""
    from pyspark.sql.functions import pandas_udf

    kind = f"{'>' if big else '<'}f{width}"

    @pandas_udf("binary")
    def made(v: pd.Series) -> pd.Series:
        data = v.to_numpy(dtype=kind).tobytes()
        return pd.Series([data[k : k + width] for k in range(0, len(data), width)])

    return F.when(x.isNotNull(), made(F.coalesce(x.cast("double"), F.lit(0.0))))


def decode_float(b: Column, width: int = 8, big: bool = True) -> Column:
    """Null unless there are just so many bytes."""
    from pyspark.sql.functions import pandas_udf

    kind = f"{'>' if big else '<'}f{width}"

    @pandas_udf("double")
    def read(v: pd.Series) -> pd.Series:
        import numpy as np

        whole = [x if x is not None and len(x) == width else b"\0" * width for x in v]
        return pd.Series(np.frombuffer(b"".join(whole), kind).astype("float64"))

    return F.when(F.octet_length(b) == width, read(b))


def encode_bool(x: Column) -> Column:
    return F.unhex(F.when(x, "01").otherwise("00"))


def decode_bool(b: Column) -> Column:
    """Null for any other byte."""
    return F.when(F.hex(b) == "01", True).when(F.hex(b) == "00", False)


def encode_ordering(x: Column) -> Column:
    """-1, 0 and 1 as bytes 0, 1 and 2."""
    return F.unhex(F.lpad((x + 1).cast("string"), 2, "0"))


def decode_ordering(b: Column) -> Column:
    return F.when(F.hex(b).isin("00", "01", "02"), F.conv(F.hex(b), 16, 10).cast("int") - 1)


def encode_list(items: Column) -> Column:
    """Encoded items (binary) of any lengths in one: the count, then each with its length before it."""
    sized = F.transform(items, lambda b: F.concat(F.lpad(F.hex(F.octet_length(b)), 16, "0"), F.hex(b)))
    return F.unhex(F.concat(F.lpad(F.hex(F.size(items)), 16, "0"), F.array_join(sized, "")))


def decode_list(b: Column) -> Column:
    """The items of encode_list."""
    digits = F.hex(b)
    count = F.conv(F.substring(digits, 1, 16), 16, 10).cast("int")

    def step(acc: Column, _: Column) -> Column:
        size = F.conv(F.substring(digits, acc["at"], F.lit(16)), 16, 10).cast("int") * 2
        return F.struct((acc["at"] + 16 + size).cast("int").alias("at"), F.concat(acc["out"], F.array(F.unhex(F.substring(digits, acc["at"] + 16, size)))).alias("out"))

    none = F.array().cast("array<binary>")
    return F.when(count > 0, F.aggregate(F.sequence(F.lit(1), count), F.struct(F.lit(17).alias("at"), none.alias("out")), step, lambda a: a["out"])).otherwise(none)


def pack(chars: Column) -> Column:
    """Characters in one text."""
    return F.array_join(chars, "")


def unpack(s: Column) -> Column:
    """The characters of a text."""
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))


def strip_head(s: Column) -> Column:
    """Without white space at the front."""
    return F.regexp_replace(s, r"\A\s+", "")


def interpolated(s: Column, values: dict[str, Column]) -> Column:
    """``#{name}`` replaced by the value of that name (other names stay)."""
    out = s
    for name, value in values.items():
        out = F.replace(out, F.lit("#{" + name + "}"), value.cast("string"))
    return out
