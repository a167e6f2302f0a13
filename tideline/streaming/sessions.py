"""Sessions, intervals and sampling by event time.

The same functions serve batch and, where they only use event-time windows
(``intervals``, ``keep_alive_windows``), streaming DataFrames with a watermark.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stateful import scan_sorted
from ..seq import Seq


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def keep_alive(seq: Seq, ts: str, gap: float, name: str = "session") -> DataFrame:
    """Numbers sessions: a new one begins where the event before is gap seconds away or more."""
    out = seq.like(seq.lagged("__p", micros(F.col(ts))))
    start = F.when(F.col("__p").isNull() | (micros(F.col(ts)) - F.col("__p") >= int(gap * 1e6)), 1).otherwise(0)
    return out.running(name, start.cast("long")).drop("__p")


def keep_alive_windows(df: DataFrame, keys: Sequence[str], ts: str, gap: str, *aggs: Column, watermark: str | None = None) -> DataFrame:
    """Sessions as event-time windows; batch or streaming."""
    source = df.withWatermark(ts, watermark) if watermark else df
    w = F.session_window(ts, gap)
    return source.groupBy(*keys, w.alias("w")).agg(*aggs).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in _names(aggs)])


def _names(aggs: Sequence[Column]) -> list[str]:
    return [a._jc.toString().rpartition(" AS ")[2].strip("`") for a in aggs]


def intervals(df: DataFrame, ts: str, length: str, *aggs: Column, keys: Sequence[str] = (), watermark: str | None = None) -> DataFrame:
    """Tumbling windows of a length; batch or streaming."""
    source = df.withWatermark(ts, watermark) if watermark else df
    return source.groupBy(*keys, F.window(ts, length).alias("w")).agg(*aggs).withColumn("start", F.col("w.start")).drop("w")


def sample_interval(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], length: str, end: bool) -> DataFrame:
    """The last or first event of each tumbling window."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if end else F.min_by
    return df.groupBy(*keys, F.window(ts, length).alias("w")).agg(pick(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def sample_burst(seq: Seq, ts: str, gap: float, end: bool) -> DataFrame:
    """The last or first event of each burst; a burst ends before a gap of so many seconds."""
    step = 1 if end else -1
    now = micros(F.col(ts))
    out = seq.lagged("__n", now, 1) if not end else seq.df.withColumn("__n", F.lead(now).over(seq.by()))
    far = F.col("__n").isNull() | (step * (F.col("__n") - now) >= int(gap * 1e6))
    return out.filter(far).drop("__n")


def take_interval(seq: Seq, ts: str, seconds: float, drop: bool = False) -> DataFrame:
    """Events of the first seconds since the first event, or the others."""
    first = seq.df.groupBy(*seq.keys).agg(F.min(ts).alias("__t"))
    out = seq.df.join(first, seq.keys) if seq.keys else seq.df.crossJoin(F.broadcast(first))
    inside = micros(F.col(ts)) - micros(F.col("__t")) < int(seconds * 1e6)
    return out.filter(~inside if drop else inside).drop("__t")


def _fixed(state, columns, limit: int):
    """Sessions of one key's sorted times; state: the session's first time and its number."""
    times = columns["__us"].to_numpy(zero_copy_only=False)
    anchor, number = state or (None, -1)
    out = np.empty(len(times), np.int64)
    at = 0
    while at < len(times):
        if anchor is None or times[at] - anchor >= limit:
            anchor, number = int(times[at]), number + 1
        end = at + int(np.searchsorted(times[at:], anchor + limit))
        out[at:end] = number
        at = end
    return (anchor, number), {"session": out}


def fixed_sessions(df: DataFrame, keys: Sequence[str], ts: str, order: str, seconds: float, name: str = "session") -> DataFrame:
    """Numbers sessions of a fixed duration, each anchored at its first event (after the end of the one before).

    Sequential within a key: one pass over the key's sorted times, a step for each
    session.  Rows without a time have no session.
    """
    timed = df.withColumn("__us", micros(F.col(ts)))
    out = scan_sorted(timed.filter("__us IS NOT NULL"), keys, ["__us", order], partial(_fixed, limit=int(seconds * 1e6)), {"session": T.LongType()})
    rest = timed.filter("__us IS NULL").withColumn("session", F.lit(None).cast("long"))
    return out.unionByName(rest).drop("__us").withColumnRenamed("session", name)


def timed_groups(seq: Seq, ts: str, n: int, seconds: float, name: str = "group") -> DataFrame:
    """Numbers groups that end after n events, or so many seconds after their first."""
    timed = seq.df.withColumn("__us", micros(F.col(ts)))
    return scan_sorted(timed, seq.keys, seq.order, partial(_timed, n=n, limit=int(seconds * 1e6)), {"group": T.LongType()}).drop("__us").withColumnRenamed("group", name)


def _timed(state, columns, n: int, limit: int):
    """State: the group's first time, its number and how many it has."""
    times = columns["__us"].to_numpy(zero_copy_only=False)
    anchor, number, has = state or (None, -1, 0)
    out = np.empty(len(times), np.int64)
    at = 0
    while at < len(times):
        if anchor is None or has == n or times[at] - anchor >= limit:
            anchor, number, has = int(times[at]), number + 1, 0
        end = min(at + int(np.searchsorted(times[at:], anchor + limit)), at + n - has)
        out[at:end] = number
        has += end - at
        at = end
    return (anchor, number, has), {"group": out}


def ticks(spark: SparkSession, start: str, end: str, every: str, name: str = "ts") -> DataFrame:
    """Times from start to end, so far apart."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"interval {every}"))).alias(name))


def tick_stream(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """An unbounded stream of ticks (timestamp, value)."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def interjected(df: DataFrame, ts: str, marks: DataFrame, mark: str = "mark") -> DataFrame:
    """The rows and those of marks (times) in one, told apart by ``mark``; columns that marks lack are null."""
    return df.withColumn(mark, F.lit(False)).unionByName(marks.withColumn(mark, F.lit(True)), allowMissingColumns=True)


def fixed_sessions_stream(df: DataFrame, keys: Sequence[str], ts: str, seconds: float, watermark: str) -> DataFrame:
    """(keys, start, end, n) of each session of a fixed duration, as the watermark passes its end; for streams.

    A session is anchored at the first event of its key that the one before does not
    hold; events that come late, but not beyond the watermark, count in the session
    that is open then.  The state of a key is its open session.
    """
    limit = int(seconds * 1e6)
    source = df.withWatermark(ts, watermark)
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def step(key, frames, state):
        anchor, n = state.get if state.exists else (None, 0)
        closed = []
        if state.hasTimedOut:
            closed.append((*key, anchor, anchor + limit, n))
            state.remove()
        else:
            times = np.sort(np.concatenate([f[ts].to_numpy().astype("datetime64[us]").astype(np.int64) for f in frames]))
            for t in times.tolist():
                if anchor is not None and t - anchor >= limit:
                    closed.append((*key, anchor, anchor + limit, n))
                    anchor, n = None, 0
                anchor, n = t if anchor is None else anchor, n + 1
            state.update((anchor, n))
            state.setTimeoutTimestamp(max(-(-(anchor + limit) // 1000), state.getCurrentWatermarkMs() + 1))
        out = pd.DataFrame(closed, columns=[*keys, "start", "end", "n"])
        out["start"], out["end"] = (pd.to_datetime(out[c].astype("int64"), unit="us") for c in ("start", "end"))
        yield out

    return source.groupBy(*keys).applyInPandasWithState(step, f"{kinds}, start timestamp, end timestamp, n long", "anchor long, n long", "append", "EventTimeTimeout")
