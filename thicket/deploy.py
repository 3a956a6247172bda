"""Makes this library importable in the Python workers of a session."""

from __future__ import annotations

import atexit
import importlib.util
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to executors, once per application. Where the
    library is installed on every machine this changes nothing."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(importlib.util.find_spec("thicket").origin).parent
    folder = tempfile.mkdtemp()  # the driver's own; Spark sends the file when a worker asks
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/thicket-{app}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
        beside = root.parent / "corpus_pipeline.py"
        if beside.exists():
            z.write(beside, beside.name)
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
