import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.operators import grid
from stratum.sources import vtk

SPEC = (0.0, 1.0, 5), (0.0, 1.0, 4), (1.0, 2.0, 7)


def lattice(spark):
    g = grid.lattice(spark, *SPEC).select("node_ix", "x", "y", "z", (F.col("r") * 3).alias("v"), F.when(F.col("node_ix") % 9 == 0, float("nan")).otherwise(F.col("lat")).alias("w"), F.lit("text").alias("t"))
    return g.withColumns({"a": F.col("node_ix") / 7, "b": F.lit(-1e-300), "c": F.lit(float("inf"))}).repartition(3)


@pytest.mark.parametrize("piece", [10**6, 60, 20, 1])
def test_a_grid_of_more_points_than_a_piece(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(vtk, "PIECE", piece)
    g, path = lattice(spark), str(tmp_path / "g")
    vtk.write(g, path, (5, 4, 7), "node_ix", vectors={"axis": ["a", "b", "c"]})
    pieces = [p.name for p in (tmp_path / "g").iterdir() if p.suffix == ".vts"]
    assert len(pieces) == {10**6: 1, 60: 2, 20: 6, 1: 6}[piece]
    back, dims = vtk.read(spark, path)
    assert dims == (5, 4, 7) and back.columns == ["node_ix", "x", "y", "z", "v", "w", "axis_1", "axis_2", "axis_3"]
    want = g.select("node_ix", "x", "y", "z", "v", "w", "a", "b", "c").orderBy("node_ix").toPandas().to_numpy(float)
    assert np.array_equal(back.orderBy("node_ix").toPandas().to_numpy(float), want, equal_nan=True)
    some, _ = vtk.read(spark, path, ["axis"])
    assert some.columns == ["node_ix", "x", "y", "z", "axis_1", "axis_2", "axis_3"] and some.count() == 140
    assert back.rdd.getNumPartitions() == len(pieces)
    with pytest.raises(FileExistsError):
        vtk.write(g, path, (5, 4, 7), "node_ix")


def test_one_large_file_is_read_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vtk, "BLOCK", 7)
    monkeypatch.setattr(vtk, "CHUNK", 64)
    n = 3 * 2 * 11
    v = [float(i) / 3 for i in range(n)]
    points = [c for i in range(n) for c in (float(i), -float(i), 0.5)]
    lines = "\n".join(map(repr, v))
    path = tmp_path / "one.vts"
    path.write_text(f'<?xml version="1.0"?>\n<VTKFile type="StructuredGrid"><StructuredGrid WholeExtent="1 3 0 1 0 10">\n<Piece Extent="1 3 0 1 0 10"><PointData Scalars="v"><DataArray type="Float64" Name="v" format="ascii">\n{lines}\n</DataArray><DataArray type="Float64" Name="u" NumberOfComponents="1" format="ascii">{" ".join(["7"] * n)}</DataArray></PointData><CellData></CellData><Points><DataArray type="Float64" NumberOfComponents="3" format="ascii">{" ".join(map(str, points))}</DataArray></Points></Piece></StructuredGrid></VTKFile>')
    # the reader's module is imported anew in tasks, so its blocks are tried here
    rows = [tuple(r.values()) for b in vtk.Reader({"path": str(path), "fields": '["v"]'}).read(vtk.File(str(path), [1, 3, 0, 1, 0, 10])) for r in b.to_pylist()]
    assert rows == [(i + 1, float(i), -float(i), 0.5, v[i]) for i in range(n)]
    back, dims = vtk.read(spark, str(path), ["v"])
    assert dims == (3, 2, 11) and sorted(map(tuple, back.collect())) == rows


def test_wrong_sizes(spark, tmp_path):
    with pytest.raises(ValueError):
        vtk.write(lattice(spark).limit(100), str(tmp_path / "g"), (5, 4, 7), "node_ix")
    flat = grid.lattice(spark, (0.0, 1.0, 3), (0.0, 1.0, 2), (1.0, 1.0, 1)).select("node_ix", "x", "y", "z", F.when(F.col("node_ix") > 2, F.col("r")).alias("v"))
    vtk.write(flat, str(tmp_path / "flat"), (3, 2, 1), "node_ix")
    back, dims = vtk.read(spark, str(tmp_path / "flat"))
    assert dims == (3, 2, 1) and [np.isnan(r["v"]) for r in back.orderBy("node_ix").collect()] == [True, True, False, False, False, False]
