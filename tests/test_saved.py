import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratum.operators import grid, index
from stratum.sources import chains
from stratum.store import drop_stored, stored
from stratum.streaming import chains as streams


def test_windowed_misfit(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(c, start + dt.timedelta(minutes=m), float(m * c)) for c in (1, 2) for m in (0, 3, 9, 10, 25)]
    models = spark.createDataFrame(rows, "chain int, saved timestamp, misfit double")
    models.write.parquet(str(tmp_path / "m"))
    stream = streams.windowed_misfit(streams.growing(spark, str(tmp_path / "m"), models.schema), "saved", "10 minutes", "5 minutes")
    q = streams.started(stream, "windowed")
    try:
        q.processAllAvailable()
        got = {(r["window"]["start"], r["chain"]): (r["misfit"], r["n"]) for r in spark.table("windowed").collect()}
    finally:
        q.stop()
    at = lambda m: start + dt.timedelta(minutes=m)
    assert got == {(at(0), c): (4.0 * c, 3) for c in (1, 2)} | {(at(10), c): (10.0 * c, 1) for c in (1, 2)} | {(at(20), c): (25.0 * c, 1) for c in (1, 2)}


def test_late_models_leave_the_state(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    save = lambda name, minutes: spark.createDataFrame([(1, start + dt.timedelta(minutes=m), 1.0) for m in minutes], "chain int, saved timestamp, misfit double").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    save("m", [0, 60])
    stream = streams.windowed_misfit(streams.growing(spark, str(tmp_path / "m"), spark.read.parquet(str(tmp_path / "m")).schema), "saved", "10 minutes", "5 minutes")
    q = streams.started(stream, "late", "append")
    try:
        q.processAllAvailable()
        save("m", [1, 120])  # the first is late by now
        q.processAllAvailable()
        got = {r["window"]["start"].minute: r["n"] for r in spark.table("late").where("window.start < '2024-01-01 00:10:00'").collect()}
    finally:
        q.stop()
    assert got == {0: 1}


def test_model_grids(spark, tmp_path):
    g = grid.lattice(spark, (0.0, 1.0, 2), (0.0, 1.0, 2), (1.0, 2.0, 2)).withColumn("vp", F.col("r"))
    for i in (0, 5):
        chains.save_model_grid(g.withColumn("vp", F.col("vp") + i), str(tmp_path), i)
    back = spark.read.parquet(str(tmp_path / "grid"))
    assert {r["iteration"]: r["n"] for r in back.groupBy("iteration").agg(F.count("*").alias("n")).collect()} == {0: 8, 5: 8}
    assert back.where("iteration = 5").agg(F.sum("vp")).first()[0] == pytest.approx(12 + 40)
    with pytest.raises(Exception, match="already exists"):
        chains.save_model_grid(g, str(tmp_path), 5)


def test_stored_tables_are_deleted(spark, tmp_path):
    a = stored(spark.range(5), "kept")
    assert a.count() == 5 and "/stratum/kept-" in a._stratum_path
    drop_stored(a)
    with pytest.raises(Exception, match="(?i)not.*exist|no such"):
        spark.read.parquet(a._stratum_path).count()


def test_followed(spark):
    rows = [(i * 7 % 101 + (1000 if i > 50 else 0), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(4)
    got = {(r["id"], r["w"]) for r in index.followed(df, "id", "v", "w").collect()}
    rows.sort()
    assert got == {(a[0], b[1]) for a, b in zip(rows, rows[1:])}
    assert index.followed(df.limit(0), "id", "v", "w").count() == index.followed(df.limit(1), "id", "v", "w").count() == 0
