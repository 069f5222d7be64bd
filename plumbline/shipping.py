"""Sends this package to the Python workers, which need not have it installed or share the driver's folders."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's context as a zip, once a context."""
    context = spark.sparkContext
    if getattr(context, "_plumbline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="plumbline-ship-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "plumbline.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    context.addPyFile(target)
    context._plumbline_shipped = True
