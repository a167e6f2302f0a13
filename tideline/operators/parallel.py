"""Concurrency: how many tasks evaluate a table, and several jobs at once.

Spark evaluates a table's partitions concurrently by itself; what is left to say is
how many there are, whether order is kept, and which jobs run side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, as_completed, wait
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..seq import Seq, interleaved, merged, zipped

Job = Callable[[], object]


def evaluated(df: DataFrame, tasks: int, ordered: Sequence[str] = ()) -> DataFrame:
    """df in so many partitions: ranges of the order if there is one, else dealt out by turns."""
    return df.repartitionByRange(tasks, *ordered).sortWithinPartitions(*ordered) if ordered else df.repartition(tasks)


def mapped(df: DataFrame, tasks: int, **columns: Column) -> DataFrame:
    """Columns made in so many tasks."""
    return evaluated(df, tasks).withColumns(columns)


def concatenated(parts: Iterable[DataFrame]) -> DataFrame:
    """All rows of all tables, whose tasks run side by side, in no order."""
    return reduce(DataFrame.unionByName, parts)


def zipped_rows(left: Seq, right: Seq, f: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    return f(zipped(left, right))


def merged_rows(left: Seq, right: Seq, columns: Sequence[str], value: str) -> DataFrame:
    return merged(left, right, columns, value)


def interleaved_rows(parts: Sequence[Seq], columns: Sequence[str]) -> DataFrame:
    return interleaved(parts, columns)


def counted(df: DataFrame, name: str, p: Column | None = None) -> DataFrame:
    """df itself; how many rows (that p holds for) have gone by is reported to query listeners under the name."""
    return df.observe(name, F.count(F.when(p, 1) if p is not None else F.lit(1)).alias("n"))


def _threaded(job: Job) -> Job:
    """The job with the properties and tags of the thread that asked for it."""
    spark = SparkSession.getActiveSession()
    return inheritable_thread_target(spark)(job) if spark else job


def run(jobs: Sequence[Job], threads: int = 4) -> list:
    """The results of all jobs, in their order; so many run at a time."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(lambda job: job(), [_threaded(j) for j in jobs]))


def run_as_completed(jobs: Sequence[Job], threads: int = 4) -> Iterator[tuple[int, object]]:
    """(place, result) of each job as it ends."""
    with ThreadPoolExecutor(threads) as pool:
        futures = {pool.submit(_threaded(job)): k for k, job in enumerate(jobs)}
        for f in as_completed(futures):
            yield futures[f], f.result()


def run_first(spark: SparkSession, jobs: Sequence[Job], group: str = "first") -> tuple[int, object]:
    """(place, result) of the job that ends first; the Spark jobs of the others are cancelled."""
    def tagged(job: Job) -> object:
        spark.addTag(group)
        try:
            return job()
        finally:
            spark.removeTag(group)

    pool = ThreadPoolExecutor(len(jobs))
    futures = {pool.submit(inheritable_thread_target(spark)(tagged), job): k for k, job in enumerate(jobs)}
    done, _ = wait(futures, return_when=FIRST_COMPLETED)
    spark.interruptTag(group)
    pool.shutdown(wait=False)
    first = min(done, key=futures.get)
    return futures[first], first.result()
