"""Sessions: the package on every worker, and settings for local use."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers of the application, once."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return spark
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="lecterna-"), "lecterna_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
    return spark


def local(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session of this machine, for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
