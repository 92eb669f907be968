"""The package for the executors' Python workers, where it isn't installed on them."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

import gapline


def archive(path: str) -> str:
    """The package as a zip file that Python can import from."""
    root = os.path.dirname(os.path.abspath(gapline.__file__))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, names, files in os.walk(root):
            names[:] = sorted(n for n in names if n != "__pycache__")
            for f in sorted(files):
                if not f.endswith(".pyc"):
                    z.write(os.path.join(folder, f), os.path.join("gapline", os.path.relpath(os.path.join(folder, f), root)))
    return path


def ship(spark: SparkSession) -> None:
    """Sends the package to all executors, those that start later too. Call it once for a session that was started in another folder. The archive stays for as
    long as the driver runs: executors fetch it from there."""
    folder = tempfile.mkdtemp(prefix="gapline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(archive(f"{folder}/gapline-{uuid.uuid4().hex[:12]}.zip"))
