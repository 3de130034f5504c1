"""Session helpers: make the package importable on the executors."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application, unless their PYTHONPATH has it already."""
    root = Path(__file__).resolve().parent.parent
    sc = spark.sparkContext
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if sc.applicationId in _SHIPPED or str(root) in on_path:
        return
    archive = Path(sc._temp_dir) / "weftline-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "weftline").rglob("*.py")):
            out.write(path, path.relative_to(root))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
