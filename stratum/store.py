"""Tables between steps: written to the folder that driver and executors share, so lineage ends there and any executor may be lost."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str = "") -> str:
    """A new path under spark.checkpoint.dir; without that setting, under a temporary folder on a local master, and under the warehouse on any other."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        named = tempfile.mkdtemp(prefix="stratum-tables-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stratum_tables"
    return f"{named.rstrip('/')}/stratum/{name}{'-' if name else ''}{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "") -> DataFrame:
    """df as a table in the shared folder: computed once, read from there."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stratum_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete a table that stored() wrote and nothing will read again."""
    path = getattr(df, "_stratum_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        with contextlib.suppress(Exception):
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
