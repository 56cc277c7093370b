"""What a session needs before Python functions of this package run on its executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application: they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # else the package itself came as a zip file
        target = Path(tempfile.mkdtemp(prefix="rankeval-")).resolve() / "rankeval_package.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(target))
    _sent.add(context.applicationId)
