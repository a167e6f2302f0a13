"""Byte-level BPE encoding and decoding with the tokenizers library.

Method: the library's BPE model over Arrow batches.  Bytes are written as the
byte-level alphabet's characters, the merges are derived from the ranks, and
every match of the splitting pattern is a word of its own, so a bounded cache
of words saves most of the work.  Decoding reverses the byte table: ids give
bytes, and a character split over tokens comes together in the bytes.

Null text counts as empty, an empty text has no ids.  Repeated rows give
repeated results.  Any other column of the input is left alone; name those to
keep in ``keys``.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cached_property, lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .grid import packed
from .staging import arrow_map

#: Words kept with their ids in each Python worker.
CACHE = 150_000
#: Rows are passed on when they hold so many bytes of text.
BATCH_BYTES = 1 << 20

# The classes of the splitting pattern within Latin-1.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t-\r \u0085 "


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def split_rank(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes the token, after all merges of lower rank."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, i = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= limit:
            raise ValueError(f"no merges lead to {token!r}")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


class _Known(dict):
    """Ids (bytes of int32) by word; looking up an unknown word notes it."""

    def __init__(self):
        self.missing: set[str] = set()

    def __missing__(self, word: str) -> bytes:
        self.missing.add(word)
        return b""


class Codec:
    """Encoder and decoder of one vocabulary; one for each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import re

        import regex

        self.ranks, by_rank = ranks, sorted(ranks, key=ranks.get)
        # \s is Unicode's White_Space, as in the pattern's own engine
        wide = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.split_any = regex.compile(wide).findall
        narrow = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACE}{_LETTER}{_NUMBER}]").replace(r"\p{L}", f"[{_LETTER}]").replace(r"\p{N}", f"[{_NUMBER}]").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
        self.split_latin = None if r"\p" in narrow else re.compile(narrow).findall
        self.known = _Known()
        size = max(ranks.values()) + 1
        self.lengths = np.zeros(size, np.int64)
        self.lengths[list(ranks.values())] = [len(t) for t in ranks]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.table = np.frombuffer(b"".join(by_rank), np.uint8)

    @cached_property
    def model(self):
        """The tokenizers library's BPE over the byte alphabet; workers that only decode never build it."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        alphabet = byte_alphabet()
        name = lambda t: "".join(alphabet[b] for b in t)
        merges = [tuple(map(name, split_rank(t, self.ranks))) for t in sorted(self.ranks, key=self.ranks.get) if len(t) > 1]
        model = Tokenizer(models.BPE(vocab={name(t): i for t, i in self.ranks.items()}, merges=merges, cache_capacity=0))
        model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return model

    def split(self, text: str) -> list[str]:
        """The matches of the pattern, one after another (they cover the text)."""
        if self.split_latin:
            try:
                text.encode("latin-1")
                return self.split_latin(text)
            except UnicodeEncodeError:
                pass
        return self.split_any(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (int32) and the texts' bounds in them."""
        words, known = [self.split(t) for t in texts], self.known
        if len(known) > CACHE:
            known.clear()
        made = [b"".join(map(known.__getitem__, ws)) for ws in words]
        if known.missing:
            missing, known.missing = list(known.missing), set()
            for i in range(0, len(missing), 4096):
                part = missing[i : i + 4096]
                known.update(zip(part, (np.array(e.ids, np.int32).tobytes() for e in self.model.encode_batch_fast(part, add_special_tokens=False))))
            made = [b"".join(map(known.__getitem__, ws)) for ws in words]
        return np.frombuffer(b"".join(made), np.int32), np.cumsum([0, *(len(m) // 4 for m in made)])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all rows of ids, and the rows' bounds in them."""
        size = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.starts[ids] - ends[:-1], size) + np.arange(ends[-1])
        return self.table[at], ends[bounds]

    def offsets(self, text: str, ids: np.ndarray) -> list[tuple[int, int]]:
        """Start and end of each token in characters; a token inside a character covers it whole."""
        data = np.frombuffer(text.encode(), np.uint8)
        char = np.concatenate([np.cumsum((data & 0xC0) != 0x80), [len(text) + 1]]) - 1
        ends = np.cumsum(self.lengths[ids])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return [(int(char[s]), int(char[e - 1]) + 1) for s, e in zip(starts, ends)] if len(ids) else []


@lru_cache(2)
def _codec(key: str, pattern: str) -> Codec:
    return Codec(_RANKS[key], pattern)


_RANKS: dict[str, dict[bytes, int]] = {}


def _codec_of(shared, pattern: str) -> Codec:
    key, ranks = shared.value
    _RANKS.setdefault(key, ranks)
    return _codec(key, pattern)


def _groups(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about BATCH_BYTES bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(column):
        base = sizes[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(sizes, base + BATCH_BYTES, side="right")))
        yield first, end
        first = end


def _bytes(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _encode_batches(batches: Iterator[pa.RecordBatch], shared, pattern: str, text: str, out: list[str], offsets: bool, decoded: bool) -> Iterator[pa.RecordBatch]:
    codec = _codec_of(shared, pattern)
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        rest = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != text]
        for a, b in _groups(column):
            texts = [t or "" for t in column[a:b].to_pylist()]
            ids, bounds = codec.encode(texts)
            made: list = [packed(ids, bounds, pa.int32())]
            if offsets:
                spans = [codec.offsets(t, ids[s:e]) for t, s, e in zip(texts, bounds, bounds[1:])]
                made.append(pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            if decoded:
                made.append(_bytes(*codec.decode(ids, bounds)))
            yield pa.RecordBatch.from_arrays([*(c[a:b] for c in rest), *made], out)
    codec.known.clear()  # workers are kept between tasks


def _decode_batches(batches: Iterator[pa.RecordBatch], shared, pattern: str, ids: str, out: list[str]) -> Iterator[pa.RecordBatch]:
    codec = _codec_of(shared, pattern)
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            column = part.column(part.schema.get_field_index(ids))
            bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, _bytes(*codec.decode(column.flatten().to_numpy(zero_copy_only=False), bounds))], out)


def _shared(df: DataFrame, ranks: dict[bytes, int], path: str):
    return df.sparkSession.sparkContext.broadcast((path, ranks))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",), ids: str = "ids", offsets: str | None = None, decoded: str | None = None) -> DataFrame:
    """The keys and the ids of every text (array of int).

    offsets: name of a further column, each token's character span; decoded: of one
    with the bytes that the ids decode to, made in the same pass over the data.

    The vocabulary (one entry for each id, so of fixed size) is broadcast.
    """
    names = [k for k in keys if k != text]
    fields = [df.schema[k] for k in names] + [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if offsets:
        fields.append(T.StructField(offsets, T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))))
    if decoded:
        fields.append(T.StructField(decoded, T.BinaryType()))
    shared = _shared(df, read_ranks(ranks_path), ranks_path)
    return arrow_map(df.select(*names, text), partial(_encode_batches, shared=shared, pattern=pattern, text=text, out=[f.name for f in fields], offsets=bool(offsets), decoded=bool(decoded)), T.StructType(fields))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df and the bytes that its ids stand for (null ids: no bytes)."""
    schema = T.StructType([f for f in df.schema if f.name != decoded] + [T.StructField(decoded, T.BinaryType())])
    shared = _shared(df, read_ranks(ranks_path), ranks_path)
    return arrow_map(df.select(*schema.names[:-1]), partial(_decode_batches, shared=shared, pattern=pattern, ids=ids, out=schema.names), schema)
