"""Language identification by hierarchical discrimination.

First the language family, then one-versus-one linear support vector machines
among the languages of that family.  Features are the shares of hashed letter
bigrams and trigrams, computed with numpy over the whole text.

The model is fitted on a sample of labelled rows of every language
(``per_language`` and ``most_rows``, but ``FEWEST`` rows of each): the first by a
hash of the row's id, so it is the same for the same table.  Counting the languages covers all rows.  Null text and texts without a
letter give ``und`` with score 0.  Without labelled rows all is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grid import chunks, row_of
from .staging import arrow_map

BITS = 11
SIZE = 2 << BITS
#: Rows fitted on, at most: of each language and in all.
PER_LANGUAGE, MOST_ROWS = 500, 4000
#: Rows of each language, if it has them, even if that makes more than MOST_ROWS.
FEWEST = 10
UNKNOWN = "und"
#: Rows whose features are held at a time (SIZE counts each).
ROWS = 256

# Families of the common languages; a language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu"),
}


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def _folded() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    t[65:91] = np.arange(97, 123)
    t[97:123] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


_FOLD = _folded()


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the hashed bigrams and trigrams of each row (rows x SIZE), and whether it has an ASCII letter."""
    rows = len(bounds) - 1
    low = _FOLD[data]
    upper = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)
    low[1:][upper] += 0x20  # capital Latin-1 letters in UTF-8
    x, row = low.astype(np.uint32), row_of(bounds)
    counts = np.zeros(rows * SIZE, np.int64)
    for n, mult in ((2, (0x9E3779B1, 0x85EBCA6B)), (3, (0xC2B2AE35, 0x27D4EB2F, 0x165667B1))):
        if len(x) < n:
            continue
        m = len(x) - n + 1
        h = x[:m] * np.uint32(mult[0])
        blank = low[:m] == 32
        for j in range(1, n):
            h += x[j : m + j] * np.uint32(mult[j])
            blank &= low[j : m + j] == 32
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        keep = ~blank & (row[:m] == row[n - 1 :])
        at = row[:m][keep] * SIZE + ((n - 2) << BITS) + (h[keep] >> np.uint32(32 - BITS)).astype(np.int64)
        counts += np.bincount(at, minlength=rows * SIZE)
    counts = counts.reshape(rows, SIZE)
    ascii_letter = np.zeros(rows, bool)
    ascii_letter[row[(low >= 97) & (low <= 122)]] = True
    return (counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32), ascii_letter


@dataclass
class Model:
    """Linear classifiers over features: pairs of families, then pairs of languages of a family."""

    languages: list[str]
    family_pairs: list[tuple[str, str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        margins = x @ self.weights.T + self.bias
        names = sorted({family(v) for v in self.languages})
        fam, sure = _vote(names, self.family_pairs, margins[:, : len(self.family_pairs)])
        langs = np.empty(len(x), object)
        score = np.empty(len(x))
        for k, name in enumerate(names):
            rows = np.flatnonzero(fam == k)
            own = [v for v in self.languages if family(v) == name]
            mine = [i for i, p in enumerate(self.pairs) if p[0] in own and p[1] in own]
            best, s = _vote(own, [self.pairs[i] for i in mine], margins[rows][:, [len(self.family_pairs) + i for i in mine]])
            langs[rows] = [own[i] for i in best]
            score[rows] = sure[rows] * s
        return list(langs), score


def _vote(names: list[str], pairs: list[tuple[str, str]], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The name with most one-versus-one wins (then the larger margins), and a logistic score of its least margin."""
    wins = np.zeros((len(margins), len(names)))
    least = np.full((len(margins), len(names)), 30.0)
    for k, (a, b) in enumerate(pairs):
        for name, m in ((names.index(a), margins[:, k]), (names.index(b), -margins[:, k])):
            wins[:, name] += (m > 0) + 1e-3 * np.tanh(m)
            least[:, name] = np.minimum(least[:, name], m)
    best = wins.argmax(1)
    return best, 1 / (1 + np.exp(-2 * np.clip(least[np.arange(len(best)), best], -30, 30)))


def linear_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: float = 300.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss over some rows of x, by accelerated gradient steps.

    y: 1 or -1 for each of the rows.  Classes weigh the same whatever their sizes.
    """
    z = np.empty((len(y), x.shape[1] + 1), np.float32)
    for k in range(0, len(y), ROWS):  # the picked rows have no copy besides z
        z[k : k + ROWS, :-1] = x[rows[k : k + ROWS]]
    scale = (0.2 / np.sqrt(z[:, :-1].mean(0) + 1e-5)).astype(np.float32)
    z[:, :-1] *= scale
    z[:, -1] = 1
    y = y.astype(np.float32)
    weight = (np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * cost).astype(np.float32)
    v = np.ones(z.shape[1], np.float32)
    for _ in range(20):
        v = z.T @ (weight * (z @ v))
        v /= np.linalg.norm(v) or 1
    step = 1 / (1 + 2 * 1.1 * np.linalg.norm(z.T @ (weight * (z @ v))))
    w = old = np.zeros(z.shape[1], np.float32)
    for k in range(steps):
        at = w + np.float32(k / (k + 3)) * (w - old)
        slack = np.maximum(0, 1 - y * (z @ at))
        old, w = w, at - np.float32(step) * (at - 2 * (z.T @ (weight * y * slack)))
    return w[:-1] * scale, float(w[-1])


def _featured(batches: Iterator[pa.RecordBatch], text: str, lang: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column, langs = (batch.column(batch.schema.get_field_index(c)) for c in (text, lang))
        for a, b, data, bounds in chunks(column, most=ROWS):
            x, _ = features(data, bounds)
            yield pa.RecordBatch.from_arrays([langs[a:b], pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["lang", "x"])


def _sampled(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Languages and features (rows x SIZE, half precision, as they came) of the sample."""
    x = [np.frombuffer(v.as_buffer(), np.float16) for v in table.column("x")]
    return np.array(table.column("lang").to_pylist(), object), np.concatenate([*x, np.zeros(0, np.float16)]).reshape(-1, SIZE)


def fit(df: DataFrame, train: Column | None = None, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> Model:
    """A model from the labelled rows first by the hash of the key: at most per_language of a language and most_rows in all, but FEWEST of each."""
    labelled = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (train if train is not None else F.lit(True)))
    counts = labelled.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).collect()
    if not counts:
        return Model([], [], [], np.zeros((0, SIZE)), np.zeros(0))
    each = min(per_language, max(FEWEST, most_rows // len(counts)))
    bound = lambda n: int(min(1.0, (2 * each + 40) / n) * (1 << 30)) + 1  # noqa: E731  # each rows lie below it, all but surely
    bounds = df.sparkSession.createDataFrame([(r["l"], bound(r["n"])) for r in counts], "l string, bound long")
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("fit")), F.lit(1 << 30))
    drawn = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key"), draw.alias("draw"))
    drawn = drawn.join(F.broadcast(bounds), F.col("lang") == F.col("l")).filter("draw < bound")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "key", "text"))
    sample = arrow_map(drawn.withColumn("at", first).filter(F.col("at") <= each).select("text", "lang"), partial(_featured, text="text", lang="lang"), "lang string, x binary")
    langs, x = _sampled(sample.toArrow())
    order = np.lexsort((x[:, :64].astype(np.float32).sum(1), langs.astype(str)))  # the fit does not depend on the order of arrival
    langs, x = langs[order], x[order]
    names = sorted(set(langs))
    fams = np.array([family(v) for v in langs], object)
    family_pairs = list(combinations(sorted(set(fams)), 2))
    pairs = [(a, b) for a, b in combinations(names, 2) if family(a) == family(b)]
    fitted = [linear_svm(x, m, np.where(of[m] == a, 1.0, -1.0)) for of, ps in ((fams, family_pairs), (langs, pairs)) for a, b in ps for m in [np.flatnonzero((of == a) | (of == b))]]
    return Model(names, family_pairs, pairs, np.array([w for w, _ in fitted]).reshape(-1, SIZE), np.array([b for _, b in fitted]))


def _predict(batches: Iterator[pa.RecordBatch], shared, text: str, out: list[str]) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        rest = [c for c, f in zip(batch.columns, batch.schema) if f.name in out]
        for a, b, data, bounds in chunks(column, most=ROWS):
            x, letters = features(data, bounds)
            for i in np.flatnonzero(~letters):
                letters[i] = any(c.isalpha() for c in (column[a + int(i)].as_py() or ""))
            langs, score = model.predict(x)
            made = [pa.array([v if ok else UNKNOWN for v, ok in zip(langs, letters)], pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64())]
            yield pa.RecordBatch.from_arrays([*(c[a:b] for c in rest), *made], out)


def predict(df: DataFrame, model: Model, text: str = "text", keys: tuple[str, ...] = ("doc_id",), lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The keys, the predicted language of every row and a score from 0 to 1.

    The model (SIZE weights for each pair of learned languages) is broadcast.
    A key may not bear the name of an output.
    """
    fields = [df.schema[k] for k in keys] + [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]
    shared = df.sparkSession.sparkContext.broadcast(model)
    renamed = F.col(text).alias("__text")
    return arrow_map(df.select(*keys, renamed), partial(_predict, shared=shared, text="__text", out=[f.name for f in fields]), T.StructType(fields))
