"""What the operators of this folder share: code shipping, shared-folder tables, byte columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum import session
from stratum.store import drop_stored, stored

#: Most rows (each of a few longs) that any operator here lets Spark broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


#: Rows and bytes in an Arrow batch, in place of Spark's defaults of 10,000 and 64 MB: rows here are whole documents.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def ship(spark: SparkSession) -> None:
    """Give executors the package, and keep Arrow batches small unless the session has chosen a size."""
    session.ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(most, None) in ("67108864b", "64MB"):  # Spark's own value; its versions without the setting have none
        spark.conf.set(most, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable) -> Callable:
    """run (batches to batches), whose task's memory goes back to the system when it ends: workers live on between tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


#: Write a table under a name in the shared folder and read it back (lineage ends there and any executor may be lost), and delete one that nothing will read again.
cut, drop_cut = stored, drop_stored


def keyed_bytes(df: DataFrame, key: str, text: str) -> DataFrame:
    """The two columns an operator reads, as (doc_id long, data binary); a null text is empty. Any other column, of whatever name, is dropped."""
    return df.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("data"),
    )


def per_document(df: DataFrame, make: Callable[[], Callable[[bytes], tuple]], schema: str) -> DataFrame:
    """Apply make()'s function to data of each (doc_id, data) row; schema names the columns it returns."""
    full = f"doc_id long, {schema}"
    names = [f.name for f in df.sparkSession.createDataFrame([], full).schema.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for b in batches:
            data = b.column(1)
            rows = [one(data[i].as_py()) for i in range(len(data))]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names[1:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(typed(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[part.strip().split(" ")[1]] for part in schema.split(",")]

    def typed(values, kind):
        return pa.array(values, type=kind)

    ship(df.sparkSession)
    return df.mapInArrow(lean(run), full)


def small_ids(ids: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ids (a written table) has few enough rows to be broadcast."""
    return ids.limit(limit + 1).count() <= limit


def semi(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """df's rows whose key is in ids: a broadcast if ids is of checked size, else a shuffled semi join."""
    return df.join(F.broadcast(ids) if small_ids(ids) else ids, on, "left_semi")
