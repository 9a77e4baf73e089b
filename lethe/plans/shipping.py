"""Python workers import this package wherever they run: its sources go out with the application."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ensure_shipped(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="lethe-src-")
    path = os.path.join(folder, f"{root.name}_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
