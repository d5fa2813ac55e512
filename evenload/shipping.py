"""Makes the package importable on executors that were not started with it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once per application.

    Spark's own file service sends it, so nothing needs to be shared or installed.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    if package.suffix == ".zip" or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="evenload-")) / "evenload_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, Path(package.name) / path.relative_to(package))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
