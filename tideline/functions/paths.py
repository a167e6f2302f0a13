"""Paths as text columns: absolute ones begin with a slash; repeated slashes and ``.`` parts mean nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid(p: Column) -> Column:
    """Not empty and without a zero byte."""
    return (p != "") & ~p.contains("\0")


def validated(p: Column) -> Column:
    """Null unless valid."""
    return F.when(is_valid(p), p)


def is_rooted(p: Column) -> Column:
    return p.startswith("/")


def is_unrooted(p: Column) -> Column:
    return ~is_rooted(p)


def split_root(p: Column) -> Column:
    """struct(root, stem): the leading slashes as one, and the rest."""
    return F.struct(F.when(is_rooted(p), "/").otherwise("").alias("root"), F.regexp_replace(p, "^/+", "").alias("stem"))


def split_path(p: Column) -> Column:
    """The parts, a root among them; no empty ones and no ``.`` but a leading one."""
    parts = F.filter(F.split(p, "/+"), lambda x: x != "")
    kept = F.filter(parts, lambda x, i: (x != ".") | ((i == 0) & ~is_rooted(p)))
    return F.when(is_rooted(p), F.concat(F.array(F.lit("/")), kept)).otherwise(kept)


def split_file(p: Column) -> Column:
    """struct(dir, file): the last part and what stands before it; a path that ends with a slash has no file."""
    return F.struct(F.regexp_replace(p, "[^/]*$", "").alias("dir"), F.regexp_extract(p, "([^/]*)$", 1).alias("file"))


def take_directory(p: Column) -> Column:
    return split_file(p)["dir"]


def take_file_name(p: Column) -> Column:
    return split_file(p)["file"]


def split_extension(p: Column) -> Column:
    """struct(base, extension): the last dot of the file's name and what follows it, unless the name begins there."""
    extension = F.regexp_extract(p, r"[^/](\.[^./]+)$", 1)
    return F.struct(F.left(p, F.length(p) - F.length(extension)).alias("base"), extension.alias("extension"))


def take_extension(p: Column) -> Column:
    return split_extension(p)["extension"]


def drop_extension(p: Column) -> Column:
    return split_extension(p)["base"]


def add_extension(p: Column, extension: str) -> Column:
    return F.concat(p, F.lit(extension if extension.startswith(".") else f".{extension}"))


def replace_extension(p: Column, extension: str) -> Column:
    return add_extension(drop_extension(p), extension)


def add_trailing_separator(p: Column) -> Column:
    return F.when(p.endswith("/"), p).otherwise(F.concat(p, F.lit("/")))


def drop_trailing_separators(p: Column) -> Column:
    return F.when(p.rlike("^/+$"), "/").otherwise(F.regexp_replace(p, "/+$", ""))


def join(a: Column, b: Column) -> Column:
    """b under a; null if b is rooted."""
    return F.when(is_unrooted(b), F.concat(add_trailing_separator(a), b))


def normalized(p: Column) -> Column:
    """One slash between parts, none at the end, no ``.`` parts."""
    parts = split_path(p)
    text = F.array_join(F.filter(parts, lambda x: x != "/"), "/")
    return F.when(is_rooted(p), F.concat(F.lit("/"), text)).otherwise(F.when(text == "", ".").otherwise(text))


def equal(a: Column, b: Column) -> Column:
    """Do they name the same, as far as the text tells?"""
    return normalized(a) == normalized(b)
