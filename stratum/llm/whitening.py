"""Embedding whitening: Spark's RowMatrix over exactly centred rows gives the Gramian, whose eigenvectors are found on the driver; the whitening goes to every task as a broadcast.

Entries become whole numbers x = floor(scale * c) + shift, so sums are exact, and a centred entry (n*x - S) / n is the nearest
double to its true value (while n*x stays under 2^53). The Gramian is summed over the centred rows; it and the components are
of the vectors' length squared, whatever the number of rows.

Cases: rows whose vector is null or holds null or non-finite entries go, as do entries beyond a long. Vectors are of one
length: of several, the commonest counts (of equals the longest) and the others go; without entries (length 0), and in an empty table,
there is nothing. Repeated rows and null ids are rows like others; other columns are ignored. A component without variance
has no whitened value (null) and takes no part in identity_error; without any variance explained is null. deviation is null
where it is beyond a long; deviation_exact is a decimal of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import cut, lean, ship

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
LONG = 1 << 63
#: Eigenvalues under this share of the largest count as none.
NOTHING = 1e-13


def whole(df: DataFrame, scale: int = SCALE, shift: int = SHIFT, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x array of long) of the rows that have a vector of finite entries."""
    v = F.transform(F.col(f"`{vector}`"), lambda c: F.floor(c.cast("double") * scale))
    fine = F.forall(F.col(f"`{vector}`"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < float(1 << 62)))
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col(f"`{key}`").alias("_key"), F.transform(v, lambda c: c.cast("long") + shift).alias("x"))


def partial_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (sums of the entries, count, a bound of the entries) for each batch of vectors of one length."""
    for b in batches:
        x = b.column(0).values.to_numpy()[b.column(0).offsets[0].as_py() : b.column(0).offsets[-1].as_py()].reshape(len(b), -1) if len(b) else np.zeros((0, 0), np.int64)
        if len(x):
            top = int(np.abs(x).max()) + 1
            sums = x.sum(0) if top < LONG // len(x) else np.array([sum(map(int, c)) for c in x.T], object)
            yield pa.RecordBatch.from_arrays([pa.array([[str(int(s)) for s in sums]], pa.list_(pa.string())), pa.array([len(x)], pa.int64()), pa.array([top], pa.int64())], names=["sums", "n", "top"])


def sums(x: DataFrame) -> tuple[int, list[int], int]:
    """n, the exact sum of each dimension (partial sums of batches, summed by dimension as decimals), a bound of the entries. x: (x array of long), all of one length."""
    parts = x.select("x").mapInArrow(lean(partial_sums), "sums array<string>, n long, top long")
    rows = parts.select("n", "top", F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"), F.max("top").alias("top")).orderBy("i").collect()
    return rows[0]["n"], [int(r["s"]) for r in rows], rows[0]["top"]


def gramian(x: DataFrame, n: int, total: list[int], top: int) -> np.ndarray:
    """Covariance, divisor n, of exactly centred rows by RowMatrix.computeGramianMatrix."""
    if 2 * n * top < LONG:
        s, wide = F.array(*map(F.lit, total)), "long"
    else:
        s, wide = F.array(*(F.lit(str(t)).cast("decimal(38,0)") for t in total)), "decimal(19,0)"
    centred = F.zip_with("x", s, lambda a, b: (a.cast(wide) * F.lit(n) - b).cast("double") / F.lit(float(n)))
    rows = MLUtils.convertVectorColumnsFromML(x.select(array_to_vector(centred).alias("v")), "v")
    return RowMatrix(rows, n, len(total)).computeGramianMatrix().toArray() / n


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (rows), each with its largest entry positive."""
    e, w = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-e, kind="stable")[:most]
    e, w = np.maximum(e[order], 0), w[:, order].T
    sign = np.sign(w[np.arange(len(w)), np.abs(w).argmax(1)])
    return e, w * np.where(sign == 0, 1, sign)[:, None]


def whiten(df: DataFrame, most: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal): a row for each kept row and component up to `most`."""
    spark = df.sparkSession
    ship(spark)
    kind = df.schema[key].dataType.simpleString()
    x = whole(df, scale, shift, key, vector)
    lengths = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    empty = spark.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
    if not lengths or not lengths[0]["d"]:
        return empty
    x = x.where(F.size("x") == lengths[0]["d"])
    n, total, top = sums(x)
    v = gramian(x, n, total, top)
    values, vectors = components(v, most)
    has = values > NOTHING * max(float(values[0]), 1e-300)
    # to all tasks: of the vectors' length times `most`, whatever the number of rows
    shared = spark.sparkContext.broadcast((n, total, vectors / np.sqrt(np.where(has, values, 1))[:, None]))

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, axes = shared.value
        for b in parts:
            if not len(b):
                continue
            rows = np.stack(b["x"].to_numpy())
            top = (int(np.abs(rows).max()) + 1) * n + max(map(abs, total))
            if top < LONG:  # n*x - S in longs; else in whole numbers of any length
                d = rows * n - np.array(total, np.int64)
            else:
                d = rows.astype(object) * n - np.array(total, object)
            squares = (d * d).sum(1) if top * top * len(total) < LONG else (d.astype(object) ** 2).sum(1)
            w = (d.astype(np.float64) / float(n)) @ axes.T
            yield pd.DataFrame({"_key": b["_key"], "exact": [str(s) for s in squares], "w": list(w)})

    w = cut(x.mapInPandas(lean(run), f"_key {kind}, exact string, w array<double>"), "whitened")
    kept = [i for i in range(len(values)) if has[i]]
    pairs = list(combinations_with_replacement(kept, 2))
    error = None
    if pairs:  # means are taken off before products, in every group of rows
        found = w.agg(*(F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{k}") for k, (i, j) in enumerate(pairs))).first()
        error = max(abs(c - (i == j)) for (i, j), c in zip(pairs, found, strict=True))
    trace = float(np.trace(v))
    parts = F.array(*(F.struct(F.lit(i + 1).alias("component"), (F.col("w")[i] if has[i] else F.lit(None).cast("double")).alias("whitened"), F.lit(float(values[i]) / trace if trace > 0 else None).cast("double").alias("explained")) for i in range(len(values))))
    exact = F.col("exact").try_cast("decimal(38,0)")
    return w.select("_key", exact.alias("exact"), F.explode(parts).alias("c")).select(
        F.col("_key").alias(key), "c.component", F.lit(n).cast("long").alias("n"), F.col("exact").try_cast("long").alias("deviation"), "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"), F.col("exact").alias("deviation_exact")
    )
