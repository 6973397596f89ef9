"""Sends this package to the executors, so that their Python workers can import it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark import SparkContext
from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's source to the application once."""
    sc: SparkContext = spark.sparkContext
    if sc.applicationId in _sent:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="kerbside-code-"), "kerbside_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for top, dirs, files in os.walk(home):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(top, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    sc.addPyFile(target)
    _sent.add(sc.applicationId)
