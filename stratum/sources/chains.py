"""Saved chains as Parquet, partitioned by chain, so burn-in and field choices reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators.select import drop_burn_in


def save(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Tables with a column chain under path/<name>/chain=<n>; others under path/<name>."""
    for name, df in tables.items():
        writer = df.write.mode(mode)
        (writer.partitionBy("chain") if "chain" in df.columns else writer).parquet(f"{path}/{name}")


def save_model_grid(grid: DataFrame, path: str, iteration: int) -> None:
    """A snapshot of the lattice that rays were traced in, under path/grid/iteration=<n>."""
    grid.write.mode("errorifexists").parquet(f"{path}/grid/iteration={iteration}")


def load_metrics(spark: SparkSession, path: str, num_burn: int = 0) -> DataFrame:
    """(chain, iteration, misfit, temperature, accepted, noise, nuclei): the metrics of every saved model, with its number of nuclei."""
    models = load(spark, path, "models", num_burn)
    counts = spark.read.parquet(f"{path}/cells").groupBy("chain", "iteration").agg(F.count("*").alias("nuclei"))
    return models.join(counts, ["chain", "iteration"])


def chain_number(chains: int, chunk: int, chain: int) -> int:
    """Number of a chain of a chunk (both from 1) among all chunks."""
    return chains * (chunk - 1) + chain


def load(spark: SparkSession, path: str, name: str, num_burn: int = 0, fields: list[str] | None = None) -> DataFrame:
    """A saved table without each chain's first num_burn saved models, and of some fields only."""
    whole = spark.read.parquet(f"{path}/{name}")
    df = whole if fields is None else whole.where(F.col("field").isin(fields))
    if not num_burn:
        return df
    if name == "models":
        return drop_burn_in(df, ["chain"], ["iteration"], num_burn)
    # models are counted whether or not they have rows of the chosen fields
    saved = drop_burn_in(whole.select("chain", "iteration").distinct(), ["chain"], ["iteration"], num_burn)
    return df.join(saved, ["chain", "iteration"], "left_semi")
