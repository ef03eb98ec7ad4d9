"""A SparkSession with the settings the library is tested with."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the package to executors that can't import it from a folder (once for each context); Spark distributes the file."""
    sc = spark.sparkContext
    if getattr(sc, "_stratum_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(os.path.join(root, "stratum")):
        made = os.path.join(tempfile.mkdtemp(prefix="stratum-"), "stratum_ship.zip")
        with zipfile.ZipFile(made, "w") as z:
            for top, _, names in os.walk(os.path.join(root, "stratum")):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(top, name)
                        z.write(path, os.path.relpath(path, root))
        sc.addPyFile(made)
    sc._stratum_shipped = True


def session(master: str | None = None, name: str = "stratum", **conf: str) -> SparkSession:
    """UTC, adaptive execution on; further settings by keyword, dots as double underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
