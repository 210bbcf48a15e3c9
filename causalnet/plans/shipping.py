"""Python code for the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, unless their Python path has it already."""
    home = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if str(home.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or app in _shipped:
        return
    to = Path(tempfile.mkdtemp(prefix="package-")) / f"{home.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)
