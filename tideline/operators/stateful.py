"""State carried along each key's sorted rows, in Arrow batches.

Rows are dealt by key and sorted within partitions (which spills), then read as a
stream: a key's rows may span batches, and only its state is kept between them.
One key is one sequence, so a hot key is one task's work, but never its memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..shipping import ship

Step = Callable[[object, dict[str, pa.Array]], tuple[object, dict[str, object]]]


def _changes(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Where a row's key is not that of the row before."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        c = batch.column(batch.schema.get_field_index(k))
        null = c.is_null().to_numpy(zero_copy_only=False)
        other = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        new[1:] |= other | (null[1:] != null[:-1])
    return new


def _key(batch: pa.RecordBatch, keys: Sequence[str], row: int) -> tuple:
    return tuple(batch.column(batch.schema.get_field_index(k))[row].as_py() for k in keys)


def _run(batches: Iterator[pa.RecordBatch], step: Step, keys: list[str], made: list[str], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    state, at = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if _key(batch, keys, 0) != at:
            state = None
        cuts = [0, *np.flatnonzero(_changes(batch, keys)), batch.num_rows]
        parts: list[dict] = []
        for a, b in zip(cuts, cuts[1:]):
            if a:
                state = None
            state, out = step(state, {n: c for n, c in zip(batch.schema.names, batch.slice(a, b - a).columns)})
            parts.append(out)
        at = _key(batch, keys, batch.num_rows - 1)
        new = [pa.concat_arrays([pa.array(p[m], kind) for p in parts]) for m, kind in zip(made, kinds)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *new], names)


def scan_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, made: dict[str, T.DataType]) -> DataFrame:
    """df with the columns that ``step`` makes (map-accumulate).

    step(state, columns) gets the state so far (None at the first row of a key) and
    some consecutive rows of that key as Arrow arrays, and returns the state after
    them and a list or array for each new column.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in made.items())])
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(partial(_run, step=step, keys=list(keys), made=list(made), kinds=[to_arrow_type(t) for t in made.values()], names=schema.names), schema)
