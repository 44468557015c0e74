"""Give executors this package where their path doesn't have it."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once; Spark copies it to every executor.

    Nothing to do where ``PYTHONPATH`` names the folder, as on a cluster that
    has the package installed or was given it with ``--py-files``.
    """
    application = spark.sparkContext.applicationId
    on_path = str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if application in _SHIPPED or on_path or not (_ROOT / "cohortkit").is_dir():
        return
    folder = tempfile.mkdtemp(prefix="cohortkit-")
    packed = shutil.make_archive(f"{folder}/cohortkit", "zip", _ROOT, "cohortkit")
    spark.sparkContext.addPyFile(packed)
    _SHIPPED.add(application)
