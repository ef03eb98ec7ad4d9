import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.operators import moments, nearest

KIND = "point_ix long, x double, y double, z double"


def brute(p, models):
    """{(point, model): (nucleus, d2)}: least distance, then least number."""
    out = {}
    for name, x in models.items():
        d2 = ((p[:, None, 0] - x[None, :, 0]) ** 2 + (p[:, None, 1] - x[None, :, 1]) ** 2) + (p[:, None, 2] - x[None, :, 2]) ** 2
        best = d2.argmin(1)
        out |= {(i, name): (int(best[i]), float(d2[i, best[i]])) for i in range(len(p))}
    return out


def places(n, seed, clumps=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[: n // 4] = np.round(x[: n // 4])  # many ties
    if clumps:
        x[: n // 3] = x[0]
    return x


def frames(spark, p, models):
    points = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], KIND)
    rows = [(m, i, float(i % 7), *map(float, q)) for m, x in models.items() for i, q in enumerate(x)]
    return points, spark.createDataFrame(rows, "chain int, nucleus_ix int, v double, x double, y double, z double")


@pytest.mark.parametrize("n", [1, 2, 31, 33, 500, 3000])
def test_tree(n):
    x, p = places(n, n), places(700, 1)
    tree = nearest.Tree(x)
    best, d2 = tree.nearest(p)
    want = brute(p, {0: x})
    assert [(int(a), float(b)) for a, b in zip(best, d2)] == [want[i, 0] for i in range(len(p))]


def test_boxes_opened_grow_with_the_logarithm(monkeypatch):
    tested = {}
    gaps = nearest.Boxes.gaps

    def counted(self, level, p, i, middle=False):
        tested[n] = tested.get(n, 0) + len(p)
        return gaps(self, level, p, i, middle)

    monkeypatch.setattr(nearest.Boxes, "gaps", counted)
    rng = np.random.default_rng(5)
    p = rng.random((300, 3))
    for n in (1_000, 32_000):
        nearest.Tree(rng.random((n, 3))).nearest(p)
    assert tested[32_000] < 3 * tested[1_000]  # 32 times the nuclei


@pytest.mark.parametrize("part", [16_384, 50])
def test_models_in_parts(spark, monkeypatch, part):
    """A model ten times a task's bound, and one with a third of its nuclei at one place, give what brute force gives; small models in the same call too."""
    monkeypatch.setattr(nearest, "PART", part)
    monkeypatch.setattr(nearest, "POINTS", 64)
    p = places(300, 2, clumps=1)
    models = {0: places(500, 3), 1: places(40, 4), 2: places(520, 6, clumps=1)}
    points, nuclei = frames(spark, p, models)
    rows = nearest.nearest_cells(points, nuclei, ["chain"], ["x", "y", "z"]).collect()
    assert len(rows) == len(p) * len(models)
    assert {(r["point_ix"], r["chain"]): (r["nucleus_ix"], r["d2"]) for r in rows} == brute(p, models)
    assert all(r["v"] == r["nucleus_ix"] % 7 for r in rows)


@pytest.mark.parametrize("part", [16_384, 50])
def test_no_task_holds_more_than_a_part(spark, monkeypatch, part):
    monkeypatch.setattr(nearest, "PART", part)
    points, nuclei = frames(spark, places(50, 2), {0: places(700, 3)})
    if part == 50:
        units, _, boxes = nearest.Ensemble(points, nuclei, ["chain"], ["x", "y", "z"], "point_ix", "nucleus_ix", "v").parts()
        assert units.groupBy("unit").count().agg(F.max("count")).first()[0] <= part and len(boxes) == 1
    sums = nearest.nearest_cell_sums(points, nuclei, ["chain"], ["x", "y", "z"], [])
    assert sums.count() == 50


@pytest.mark.parametrize("part", [16_384, 50])
def test_sums_equal_moments_of_rows(spark, monkeypatch, part):
    monkeypatch.setattr(nearest, "PART", part)
    points, nuclei = frames(spark, places(80, 2), {m: places(30 + 40 * m, m) for m in range(5)})
    nuclei = nuclei.withColumn("field", F.when(F.col("chain") < 2, "a").otherwise("b")).withColumn("v", F.when(F.col("nucleus_ix") % 11 != 5, F.col("v")))
    sample = lambda v, d2: np.where(d2 < 0.2, v, 1.5)
    got = moments.finished(nearest.nearest_cell_sums(points, nuclei, ["chain", "field"], ["x", "y", "z"], ["field"], sample), ["point_ix", "field"])
    rows = nearest.nearest_cells(points, nuclei, ["chain", "field"], ["x", "y", "z"]).withColumn("s", F.when(F.col("v").isNotNull(), F.when(F.col("d2") < 0.2, F.col("v")).otherwise(1.5)))
    want = moments.moments(rows, ["point_ix", "field"], F.col("s"))
    key = lambda r: (r["point_ix"], r["field"])
    a, b = ({key(r): r for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and len(a) == 160
    assert all(a[k]["n"] == b[k]["n"] and abs(a[k]["mean"] - b[k]["mean"]) < 1e-9 and abs(a[k]["sd"] - b[k]["sd"]) < 1e-7 for k in a)


def test_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PART", 3)
    points, nuclei = frames(spark, places(9, 2), {0: places(20, 3)})
    points = points.unionAll(points.limit(1)).unionAll(spark.createDataFrame([(99, None, 1.0, 1.0), (None, 0.0, 0.0, 0.0)], KIND))
    rows = nearest.nearest_cells(points, nuclei.withColumn("unit", F.lit(1)), ["chain"], ["x", "y", "z"]).collect()
    assert len(rows) == 11 and sorted(r["point_ix"] is None for r in rows)[-1]  # a repeated row counts twice, one without a place not at all
    assert nearest.nearest_cells(points, nuclei.limit(0), ["chain"], ["x", "y", "z"]).count() == 0
    assert nearest.nearest_cell_sums(points.limit(0), nuclei, ["chain"], ["x", "y", "z"], []).count() == 0
