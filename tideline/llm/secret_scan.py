"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

The patterns (assignments, access keys, hex runs) give the base spans.  The
method adds spans of kind ``random``: runs of key-like characters that a
byte-level BPE vocabulary encodes poorly (few characters a token).  Runs of
``LONG`` characters are tested, and from ``SHORT`` on those that mix digits with
letters.  Excluded are known digests, UUIDs, numbers and identifiers whose words by
themselves are encoded well; a run that an assignment to a secret's name holds
is no known digest, whatever its length.  Other runs that touch a base span are
left to it.

Null text counts as empty and has no spans.  Spans are in code points, end
exclusive.  Repeated rows give repeated results; texts of any length go whole,
and only the keys and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import read_ranks
from .staging import arrow_map

# The base patterns and the least lengths of their matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16

#: Runs that may be random: length, and at most so many characters a token.
SHORT, LONG = 16, 20
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORT},}}")
MOST_EFFICIENT = 2.0
#: The same for runs of lower-case letters alone, which long words of rare languages come near to.
MOST_EFFICIENT_LOWER = 1.85
# Lengths in hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
_UUID = re.compile(r"[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}", re.I)
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_NAME = re.compile(r"(?:[A-Za-z]*|[0-9]{1,4})(?:[-_/+=](?:[A-Za-z]*|[0-9]{1,4}))*")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def excluded(run: str, count, assigned: bool = False) -> bool:
    """Known digests (unless assigned), UUIDs, numbers and identifiers made of words that count, the tokens of a string, finds efficient."""
    if not any(c.isalpha() for c in run):
        return True
    if len(run) < LONG and not any(c.isdigit() for c in run):
        return True
    if not assigned and _HEX.fullmatch(run) and len(run) in DIGEST_LENGTHS or _UUID.fullmatch(run):
        return True
    if not _NAME.fullmatch(run):
        return False
    words = _WORD.findall(run)
    return sum(map(len, words)) > MOST_EFFICIENT * sum(map(count, words))


def random_spans(text: str, base: list[tuple[int, int, str]], count) -> list[tuple[int, int, str]]:
    """count: tokens of a string."""
    found, starts = [], [s for s, _, _ in base]
    ends = list(accumulate((e for _, e, _ in base), max))
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        first, after = bisect_right(ends, start), bisect_left(starts, end)  # base spans that may touch the run
        assigned = any(s <= start and end <= e and kind == "assign" for s, e, kind in base[first:after])
        if not assigned and any(s < end and start < e for s, e, _ in base[first:after]):
            continue
        run = m[0]
        most = MOST_EFFICIENT_LOWER if run.isalpha() and run.islower() else MOST_EFFICIENT
        if len(run) <= most * count(run) and not excluded(run, count, assigned):
            found.append((start, end, "random"))
    return found


@lru_cache(2)
def _encoding(key: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=_RANKS[key], special_tokens={})


_RANKS: dict[str, dict[bytes, int]] = {}


def _scan(batches: Iterator[pa.RecordBatch], shared, pattern: str, text: str, out: list[str]) -> Iterator[pa.RecordBatch]:
    key, ranks = shared.value
    _RANKS.setdefault(key, ranks)
    encoding = _encoding(key, pattern)
    count = lambda s: len(encoding.encode_ordinary(s))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for s, e, k in spans]
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            rows = []
            for t in part.column(part.schema.get_field_index(text)).to_pylist():
                base = base_spans(t or "")
                rows.append((base, random_spans(t or "", base, count)))
            more = [sorted(b + r, key=lambda x: (x[0], KINDS.index(x[2]))) for b, r in rows]
            made = [pa.array([as_rows(b) for b, _ in rows], kind), pa.array([as_rows(m) for m in more], kind)]
            yield pa.RecordBatch.from_arrays([*(c for c, f in zip(part.columns, part.schema) if f.name in out), *made], out)


def scan(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",), base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """The keys, and two arrays of (kind, start, end) for each row: base spans, all spans."""
    fields = [df.schema[k] for k in keys] + [T.StructField(base, SPANS), T.StructField(spans, SPANS)]
    shared = df.sparkSession.sparkContext.broadcast((ranks_path, read_ranks(ranks_path)))
    names = dict.fromkeys([*keys, text])
    return arrow_map(df.select(*names), partial(_scan, shared=shared, pattern=pattern, text=text, out=[f.name for f in fields]), T.StructType(fields))
