"""Structured-grid VTK files (XML, ASCII) as a Spark data source, in pieces.

A grid is a folder of piece files, each of some layers of the lattice, and an index (grid.pvts) that viewers open. Tasks write and read the pieces; neighbouring pieces share
a layer, as the format asks, which the reader gives once. A piece is read in blocks of points, and only the arrays that were asked for are parsed, so a file of one
large piece is read in bounded memory too, by one task. Paths may be local, or of any store that Arrow's file systems open; all executors must see them.
"""

from __future__ import annotations

import json
import re
import uuid
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import NumericType

from stratum.operators.select import fresh, positioned
from stratum.session import ship

#: Points of a piece, at about which a lattice is cut between layers; points read at once; bytes read at once.
PIECE, BLOCK, CHUNK = 1_000_000, 1 << 16, 1 << 22
INDEX = "grid.pvts"
TAG = re.compile(rb"<(/?)(\w+)([^<>]*?)(/?)>")
ATTRIBUTE = re.compile(rb'(\w+)\s*=\s*"([^"]*)"')


def opened(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def exists(path: str) -> bool:
    store, at = opened(path)
    return store.get_file_info(at).type != fs.FileType.NotFound


def tags(file) -> Iterator[tuple[int, int, bool, str, dict[str, str]]]:
    """(start, end, whether it closes, name, attributes) of every tag of an open file, read in chunks."""
    at, held = 0, b""
    while True:
        more = file.read(CHUNK)
        data = held + more
        last = 0
        for m in TAG.finditer(data):
            attributes = {k.decode(): v.decode() for k, v in ATTRIBUTE.findall(m[3])}
            yield at + m.start(), at + m.end(), bool(m[1]), m[2].decode(), attributes
            last = m.end()
        if not more:
            return
        open_ = data.rfind(b"<", last)  # a tag may go on in the next chunk; numbers before it are done with
        keep = len(data) if open_ < 0 else open_
        at, held = at + keep, data[keep:]


@dataclass
class Array:
    name: str
    components: int
    start: int
    end: int


@dataclass
class Piece:
    extent: list[int]
    points: Array | None
    data: list[Array]


def contents(file) -> tuple[list[int], list[Piece]]:
    """The whole extent of a file, and its pieces with the places of their arrays."""
    whole, pieces, inside, array = [], [], "", None
    for start, end, closes, name, attributes in tags(file):
        if name == "StructuredGrid" and not closes:
            whole = list(map(int, attributes["WholeExtent"].split()))
        elif name == "Piece" and not closes:
            pieces.append(Piece(list(map(int, attributes["Extent"].split())), None, []))
        elif name in ("PointData", "Points", "CellData"):
            inside = "" if closes else name
        elif name == "DataArray" and not closes:
            array = Array(attributes.get("Name", ""), int(attributes.get("NumberOfComponents", "1")), end, end)
            if attributes.get("format", "ascii") != "ascii":
                raise ValueError(f"array {array.name}: only ASCII data are read")
        elif name == "DataArray" and array is not None:
            array.end = start
            if inside == "Points":
                pieces[-1].points = array
            elif inside == "PointData":
                pieces[-1].data.append(array)
            array = None
    return whole, pieces


class Numbers:
    """The numbers of an array in a file, some at a time."""

    def __init__(self, file, array: Array):
        self.file, self.at, self.end, self.held, self.rest = file, array.start, array.end, [], b""
        self.ready = 0

    def read(self, n: int) -> np.ndarray:
        while self.ready < n and (self.at < self.end or self.rest):
            data = self.file.read_at(min(CHUNK, self.end - self.at), self.at) if self.at < self.end else b""
            self.at += len(data)
            text = self.rest + data
            cut = len(text) if self.at >= self.end else 1 + max(map(text.rfind, (b" ", b"\n", b"\t", b"\r")))
            text, self.rest = text[:cut], text[cut:]
            self.held.append(np.array(text.split(), dtype=np.float64))
            self.ready += len(self.held[-1])
            if not cut and self.at >= self.end:
                break
        whole = np.concatenate([np.empty(0), *self.held])
        if len(whole) < n:
            raise ValueError("an array ends too early")
        self.held, self.ready = [whole[n:]], len(whole) - n
        return whole[:n]


def columns_of(arrays: list[tuple[str, int]], fields: list[str] | None) -> list[tuple[str, list[str]]]:
    """Names of the columns of each wanted array: those of several components are numbered."""
    return [(name, [name] if n == 1 else [f"{name}_{i + 1}" for i in range(n)]) for name, n in arrays if fields is None or name in fields]


def listed(path: str) -> tuple[list[int], list[tuple[str, int]], list[str]]:
    """The whole extent, arrays (name, components) and piece files of a folder, an index or one file."""
    store, at = opened(path)
    prefix = path.rstrip("/")
    if store.get_file_info(at).type == fs.FileType.Directory:
        path, at = f"{prefix}/{INDEX}", f"{at.rstrip('/')}/{INDEX}"
    else:
        prefix = path.rpartition("/")[0]
    with store.open_input_file(at) as f:
        if not path.endswith(".pvts"):
            whole, pieces = contents(f)
            return whole, [(a.name, a.components) for a in pieces[0].data], [path]
        root = ElementTree.fromstring(f.read())  # an index: a line for each piece
    grid = next(root.iter("PStructuredGrid"))
    arrays = [(e.get("Name"), int(e.get("NumberOfComponents", "1"))) for e in grid.find("PPointData").iter("PDataArray")]
    return list(map(int, grid.get("WholeExtent").split())), arrays, [f"{prefix}/{e.get('Source')}" for e in grid.iter("Piece")]


@dataclass
class File(InputPartition):
    path: str
    whole: list[int]


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.fields = json.loads(options["fields"]) if "fields" in options else None

    def partitions(self):
        whole, _, files = listed(self.path)
        return [File(f, whole) for f in files]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        store, at = opened(partition.path)
        w = partition.whole
        nx, ny = w[1] - w[0] + 1, w[3] - w[2] + 1
        with store.open_input_file(at) as f:
            for piece in contents(f)[1]:
                e = piece.extent
                counts = [e[2 * k + 1] - e[2 * k] + 1 for k in range(3)]
                named = columns_of([(a.name, a.components) for a in piece.data], self.fields)
                arrays = {a.name: a for a in piece.data}
                cursors = [(Numbers(f, piece.points), 3), *((Numbers(f, arrays[name]), len(columns)) for name, columns in named)]
                names = ["node_ix", "x", "y", "z", *(c for _, columns in named for c in columns)]
                n = counts[0] * counts[1] * counts[2]
                for begin in range(0, n, BLOCK):
                    m = np.arange(begin, min(n, begin + BLOCK))
                    i, j, k = m % counts[0] + e[0], m // counts[0] % counts[1] + e[2], m // (counts[0] * counts[1]) + e[4]
                    # a layer that two pieces share is the one's last and the other's first
                    own = ((i > e[0]) | (e[0] == w[0])) & ((j > e[2]) | (e[2] == w[2])) & ((k > e[4]) | (e[4] == w[4]))
                    node = 1 + (i - w[0]) + nx * ((j - w[2]) + ny * (k - w[4]))
                    values = [v for cursor, width in cursors for v in cursor.read(len(m) * width).reshape(-1, width).T]
                    yield pa.RecordBatch.from_arrays([pa.array(node[own]), *(pa.array(v[own]) for v in values)], names=names)


@dataclass
class Written(WriterCommitMessage):
    pieces: list[tuple[str, list[int]]]


class Writer(DataSourceArrowWriter):
    """Batches of rows (slab, place in the lattice, point, arrays' columns), by slab and place."""

    def __init__(self, options):
        self.path = options["path"]
        self.dims, self.layers, self.arrays = json.loads(options["dims"]), int(options["layers"]), json.loads(options["arrays"])

    def extent(self, slab: int) -> list[int]:
        nx, ny, nz = self.dims
        top = max(1, nz - 1)
        return [0, nx - 1, 0, ny - 1, slab * self.layers, min(nz - 1, (slab + 1) * self.layers, top)]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, slab, held = [], None, []
        for batch in iterator:
            slabs = batch.column(0).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, slabs[1:] != slabs[:-1]]) if len(slabs) else []
            for a, b in zip(edges, [*edges[1:], len(slabs)], strict=True):
                if slabs[a] != slab:
                    if held:
                        done.append(self.piece(slab, held))
                    slab, held = slabs[a], []
                held.append(batch.slice(a, b - a))
        if held:
            done.append(self.piece(slab, held))
        return Written(done)

    def piece(self, slab: int, rows: list[pa.RecordBatch]) -> tuple[str, list[int]]:
        table = pa.Table.from_batches(rows)
        extent = self.extent(int(slab))
        name = f"piece-{int(slab):06d}-{uuid.uuid4().hex[:8]}.vts"
        store, at = opened(f"{self.path.rstrip('/')}/{name}")
        store.create_dir(at.rpartition("/")[0], recursive=True)
        text = lambda xs: " ".join(map(str, xs))
        with store.open_output_stream(at) as f:
            put = lambda s: f.write(s.encode())

            def array(title: str, columns: list[str]) -> None:
                put(f'<DataArray type="Float64" Name="{title}" NumberOfComponents="{len(columns)}" format="ascii">')
                values = np.stack([table.column(c).to_numpy().astype(float) for c in columns], 1)
                for begin in range(0, len(values), BLOCK):
                    put(" ".join(map(repr, values[begin : begin + BLOCK].ravel().tolist())) + " ")
                put("</DataArray>")

            put(f'<VTKFile type="StructuredGrid" version="1.0" byte_order="LittleEndian"><StructuredGrid WholeExtent="{text(self.whole())}"><Piece Extent="{text(extent)}"><PointData>')
            for title, columns in self.arrays.items():
                array(title, columns)
            put("</PointData><Points>")
            array("Points", ["_x", "_y", "_z"])
            put("</Points></Piece></StructuredGrid></VTKFile>")
        return name, extent

    def whole(self) -> list[int]:
        return [v for n in self.dims for v in (0, n - 1)]

    def commit(self, messages: list[Written | None]) -> None:
        """The index names the pieces of tasks that succeeded; others' files are never read."""
        text = lambda xs: " ".join(map(str, xs))
        root = ElementTree.Element("VTKFile", type="PStructuredGrid", version="1.0", byte_order="LittleEndian")
        grid = ElementTree.SubElement(root, "PStructuredGrid", WholeExtent=text(self.whole()), GhostLevel="0")
        data = ElementTree.SubElement(grid, "PPointData")
        for title, columns in self.arrays.items():
            ElementTree.SubElement(data, "PDataArray", type="Float64", Name=title, NumberOfComponents=str(len(columns)))
        ElementTree.SubElement(ElementTree.SubElement(grid, "PPoints"), "PDataArray", type="Float64", Name="Points", NumberOfComponents="3")
        for name, extent in sorted(p for m in messages if m for p in m.pieces):
            ElementTree.SubElement(grid, "Piece", Extent=text(extent), Source=name)
        store, at = opened(f"{self.path.rstrip('/')}/{INDEX}")
        with store.open_output_stream(at) as f:
            f.write(ElementTree.tostring(root))

    def abort(self, messages) -> None:
        """Piece files without an index are no grid."""


class VtkSource(DataSource):
    """format("stratum_vtk"): load(path) gives node_ix, x, y, z and the point data; option fields (a JSON list) names the arrays to read."""

    @classmethod
    def name(cls) -> str:
        return "stratum_vtk"

    def schema(self) -> str:
        fields = json.loads(self.options["fields"]) if "fields" in self.options else None
        named = columns_of(listed(self.options["path"])[1], fields)
        return ", ".join(["node_ix long", "x double", "y double", "z double", *(f"`{c}` double" for _, columns in named for c in columns)])

    def reader(self, schema):
        return Reader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options)


def registered(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(VtkSource)


def write(df: DataFrame, path: str, dims: tuple[int, int, int], order: str, points: tuple[str, str, str] = ("x", "y", "z"), vectors: dict[str, list[str]] | None = None) -> None:
    """Columns of df as point data of a grid at path (a folder): numeric ones as scalars, vectors (three or nine columns under one name) as such. order: what the lattice's points are sorted by, the first axis fastest. Nulls become NaN. Refuses to overwrite.

    A task holds the pieces it writes one at a time: PIECE points, or two layers where a layer has more.
    """
    if exists(path):
        raise FileExistsError(path)
    vectors = vectors or {}
    nx, ny, nz = dims
    rows = df.count()
    if rows != nx * ny * nz:
        raise ValueError(f"{rows} rows for {nx * ny * nz} points")
    used = {order, *points, *(c for v in vectors.values() for c in v)}
    arrays = {c: [c] for c in df.columns if c not in used and isinstance(df.schema[c].dataType, NumericType)} | vectors
    layers = max(1, PIECE // (nx * ny))
    slabs = max(1, -(-(nz - 1) // layers))
    at, slab = fresh(df, "_at"), fresh(df, "_slab")
    layer = F.floor((F.col(at) - 1) / (nx * ny)).cast("int")
    home = F.least(F.floor(layer / layers).cast("int"), F.lit(slabs - 1))
    both = F.when((layer % layers == 0) & (layer > 0) & (home == F.floor(layer / layers)), F.array(home, home - 1)).otherwise(F.array(home))
    names = sorted({c for columns in arrays.values() for c in columns})
    placed = positioned(df, [order], at).select(F.explode(both).alias(slab), at, *(F.col(f"`{p}`").cast("double").alias(f"_{axis}") for p, axis in zip(points, "xyz", strict=True)), *(F.col(f"`{c}`").cast("double").alias(c) for c in names))
    registered(df.sparkSession)
    # pieces are dealt by slab, so a task has whole ones
    dealt = placed.repartition(min(slabs, 20_000), slab).sortWithinPartitions(slab, at)
    dealt.write.format("stratum_vtk").option("dims", json.dumps(dims)).option("layers", layers).option("arrays", json.dumps(arrays)).mode("append").save(path)


def read(spark: SparkSession, path: str, fields: list[str] | None = None) -> tuple[DataFrame, tuple[int, int, int]]:
    """(node_ix, x, y, z and point data; components of vectors as <name>_1 ..., and the grid's dimensions), from a folder, an index or one file. fields: only these arrays are parsed."""
    registered(spark)
    source = spark.read.format("stratum_vtk")
    if fields is not None:
        source = source.option("fields", json.dumps(fields))
    e = listed(path)[0]
    return source.load(path), tuple(e[2 * k + 1] - e[2 * k] + 1 for k in range(3))
