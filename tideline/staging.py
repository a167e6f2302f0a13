"""Tables written to the shared checkpoint folder, to cut lineage.

A staged table survives lost executors: it is Parquet in the folder that the
cluster names in ``spark.checkpoint.dir``.  Where that is unset a folder under
/tmp/checkpoints is used if the master is local (tests); on a cluster that
raises, as executors would not see each other's files.  ``release`` removes what
this process has staged, and so does its end.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL = "/tmp/checkpoints"
_RUN = uuid.uuid4().hex[:12]


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = f"file://{LOCAL}"
    return folder.rstrip("/")


def release(spark: SparkSession) -> None:
    """Removes this process's staged tables; results that were read from them must be written by then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/staged/{_RUN}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        if spark := SparkSession.getActiveSession():
            release(spark)


atexit.register(_at_exit)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged/{_RUN}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
