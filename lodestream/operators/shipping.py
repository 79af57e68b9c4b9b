"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if getattr(sc, "_lodestream_core_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="lodestream-core-"), "lodestream_core.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, str(p.relative_to(package.parent)))
    sc.addPyFile(target)
    sc._lodestream_core_shipped = True
