"""Makes this package importable in the executors' Python workers."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def _remove(name: str) -> None:
    with contextlib.suppress(OSError):
        os.remove(name)


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application's files, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(suffix=".zip", prefix=f"{top.name}-")
    os.close(handle)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(name)
    atexit.register(_remove, name)
    _shipped.add(context.applicationId)
