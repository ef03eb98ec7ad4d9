"""Chains that still grow, as streams: statistics of saved models as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from stratum.operators.moments import finished, power_sums


def growing(spark: SparkSession, path: str, schema: StructType, files_at_once: int | None = None) -> DataFrame:
    """A folder of Parquet files of saved models as a stream."""
    reader = spark.readStream.schema(schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(path)


def running_moments(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, standard deviation and skewness so far: power sums are all the state there is."""
    return finished(power_sums(samples, keys, F.col(value)), keys)


def windowed_misfit(models: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Mean misfit of each chain in windows of the time a model was saved; models later than `late` are left out and windows leave the state."""
    w = F.window(time, width)
    return models.withWatermark(time, late).groupBy(w, "chain").agg(F.avg("misfit").alias("misfit"), F.count("*").alias("n"))


def started(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """The stream's result so far as an in-memory table, for small results."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).start()
