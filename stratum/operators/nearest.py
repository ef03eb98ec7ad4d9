"""Nearest-neighbour joins."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators.select import fresh, positioned, short
from stratum.session import ship
from stratum.store import drop_stored, stored


#: Nuclei of a group of models that a task holds, points that meet it there, and points compared at once.
MODELS, POINTS, AT_ONCE = 100_000, 8192, 4096
#: Nuclei of a model beyond which it is dealt to tasks in parts, each of at most so many; most parts in all (their boxes are broadcast).
PART, MOST_PARTS = 16_384, 200_000
#: Nuclei in a leaf of a tree, pairs of point and leaf compared at once, and bits of a place's number on each axis.
LEAF, PAIRS, BITS = 32, 1 << 14, 12
#: Nodes on a side of a cube of a lattice, whose nuclei are picked together.
CUBE = 8
#: Squares are sums of rounded products: boxes this much further than the best one are opened as well.
SLACK = 1 + 1e-12


class Boxes:
    """Boxes in an order in which neighbours are near each other, and above them the boxes of two, of four and so on up to one."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.levels = [(low, high)]
        while len(low) > 1:
            pairs = np.arange(0, len(low), 2)
            low, high = np.minimum.reduceat(low, pairs), np.maximum.reduceat(high, pairs)
            self.levels.append((low, high))

    def gaps(self, level: int, p: np.ndarray, i: np.ndarray, middle: bool = False) -> np.ndarray:
        """Squared distances of points from boxes i of a level, or from their middles."""
        low, high = self.levels[level]
        out = np.zeros(len(p))
        for k in range(p.shape[1]):
            d = p[:, k] - (low[i, k] + high[i, k]) / 2 if middle else np.maximum(0.0, np.maximum(low[i, k] - p[:, k], p[:, k] - high[i, k]))
            out += d * d
        return out

    def nearest(self, p: np.ndarray) -> np.ndarray:
        """The box that each point comes to by taking the nearer half at every level: near, not always nearest."""
        i = np.zeros(len(p), np.int64)
        for level in range(len(self.levels) - 2, -1, -1):
            a, b = 2 * i, np.minimum(2 * i + 1, len(self.levels[level][0]) - 1)
            ga, gb = self.gaps(level, p, a), self.gaps(level, p, b)
            i = np.where((gb < ga) | (gb == ga) & (self.gaps(level, p, b, True) < self.gaps(level, p, a, True)), b, a)
        return i

    def within(self, p: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point, box), by point, no further apart than the point's reach (squared). Halves out of reach are not opened."""
        reach = reach * SLACK
        who, i = np.arange(len(p)), np.zeros(len(p), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            if level < len(self.levels) - 1:
                who, i = np.repeat(who, 2), (2 * i[:, None] + np.arange(2)).ravel()
            some = np.flatnonzero(i < len(self.levels[level][0]))
            some = some[self.gaps(level, p[who[some]], i[some]) <= reach[who[some]]]
            who, i = who[some], i[some]
        return who, i


class Tree:
    """Nuclei of one model (or a part of it), halved along the widest side until LEAF are left. The nearest one of many points at once, exactly; of equally near ones that with the lowest number."""

    def __init__(self, x: np.ndarray):
        rest, leaves = [(np.arange(len(x)), max(0, int(np.ceil(np.log2(max(1, len(x)) / LEAF)))))], []
        while rest:
            own, depth = rest.pop()
            if not depth:
                leaves.append(np.sort(own))
                continue
            side = np.ptp(x[own], axis=0).argmax()
            order = own[np.argpartition(x[own, side], len(own) // 2)]
            rest += [(order[len(own) // 2 :], depth - 1), (order[: len(own) // 2], depth - 1)]
        self.own = np.full((len(leaves), max(map(len, leaves))), len(x))
        for row, leaf in zip(self.own, leaves, strict=True):
            row[: len(leaf)] = leaf
        self.x = np.vstack([x, np.full(x.shape[1], np.inf)])  # the last one fills short leaves
        self.boxes = Boxes(np.stack([x[i].min(0) for i in leaves]), np.stack([x[i].max(0) for i in leaves]))

    def meet(self, p: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest nucleus of a leaf to each point, and its squared distance, summed coordinate by coordinate."""
        own = self.own[leaf]
        d2 = np.zeros(own.shape)
        for k in range(p.shape[1]):
            d = p[:, k, None] - self.x[own, k]
            d2 += d * d
        i = d2.argmin(1)
        n = np.arange(len(p))
        return own[n, i], d2[n, i]

    def nearest(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        home = self.boxes.nearest(p)
        best, d2 = self.meet(p, home)
        who, leaf = self.boxes.within(p, d2)
        other = leaf != home[who]
        who, leaf = who[other], leaf[other]
        for at in range(0, len(who), PAIRS):
            w = who[at : at + PAIRS]
            which, now = self.meet(p[w], leaf[at : at + PAIRS])
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.int64)
            least = np.minimum.reduceat(now, first)
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(w)]))
            lowest = np.minimum.reduceat(np.where(now == least[group], which, len(self.x)), first)
            some = w[first]
            better = (least < d2[some]) | (least == d2[some]) & (lowest < best[some])
            best[some[better]], d2[some[better]] = lowest[better], least[better]
        return best, d2


def met(nuclei: DataFrame, points: DataFrame, blocks: DataFrame | int, dims: int, tasks: int, report: str, make) -> DataFrame:
    """Each point of a unit with each model of that unit. nuclei: (unit, model, nucleus, value, x); points: (unit, point, x), point of any type.

    blocks: how many blocks the points of a unit are dealt to, each of which gets the unit's nuclei: a number, or a table (unit, blocks). A task
    holds one unit and streams a block past a tree of each model. make(models): a function of (points, models' trees) that yields Arrow batches of `report`.
    """
    none = lambda name, df: F.lit(None).cast(df.schema[name].dataType).alias(name)
    if isinstance(blocks, int):
        nuclei, points = (df.withColumn("blocks", F.lit(blocks)) for df in (nuclei, points))
    else:
        nuclei, points = (df.join(blocks, "unit") for df in (nuclei, points))
    a = nuclei.select("unit", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "model", "nucleus", "value", none("point", points), "x")
    b = points.select("unit", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("kind"), none("model", nuclei), none("nucleus", nuclei), none("value", nuclei), "point", "x")
    rows = a.unionByName(b).repartition(tasks, "unit", "block").sortWithinPartitions("unit", "block", "kind", "model", "nucleus")
    matrix = lambda column: column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)

    def run(batches):
        at, heads, trees, found = None, [], None, None
        joined = lambda k: pa.concat_arrays([h.column(k) for h in heads])

        def planted():
            models, nuclei_, values, x = joined(3), joined(4), joined(5), matrix(joined(7))
            keys = models.to_pylist()
            first = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            return [(models.slice(i, 1), nuclei_.slice(i, j - i), values.slice(i, j - i), Tree(x[i:j])) for i, j in zip(first, [*first[1:], len(keys)], strict=True)]

        for batch in batches:
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            edges = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)]) if len(batch) else []
            for i, j in zip(edges, [*edges[1:], len(batch)], strict=True):
                part = batch.slice(i, j - i)
                if tuple(key[:, i]) != at:
                    at, heads, trees = tuple(key[:, i]), [], None
                kinds = part.column(2).to_numpy(zero_copy_only=False)
                cut = int(np.searchsorted(kinds, 1))
                if cut:
                    heads.append(part.slice(0, cut))
                if cut == len(kinds) or not heads and trees is None:
                    continue
                if trees is None:
                    trees, heads = planted(), []
                    found = make([t[0] for t in trees])
                for k in range(cut, len(kinds), AT_ONCE):
                    some = part.slice(k, AT_ONCE)
                    yield from found(some, matrix(some.column(7)), trees)

    return rows.mapInArrow(run, report)


class Ensemble:
    """Points and models made ready to meet: small models in groups, large ones in parts of space."""

    def __init__(self, points: DataFrame, nuclei: DataFrame, model: list[str], coords: list[str], point: str, nucleus: str, value: str):
        self.spark, self.model, self.names, self.dims = points.sparkSession, model, (point, nucleus, value), len(coords)
        ship(self.spark)
        full = lambda df: df.where(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in coords]))
        xs = F.array(*(F.col(f"`{c}`").cast("double") for c in coords))
        own = full(nuclei).select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{m}`") for m in model)).alias("model"), F.col(f"`{nucleus}`").alias("nucleus"), F.col(f"`{value}`").alias("value"), xs.alias("x"))
        self.points = full(points).select(F.col(f"`{point}`").alias("point"), xs.alias("x"))
        sizes = stored(own.groupBy("model").agg(F.count("*").alias("size")))
        large = F.col("size") > PART
        kept = sizes.agg(F.coalesce(F.sum(F.when(~large, F.col("size"))), F.lit(0)).alias("few"), F.count(F.when(large, 1)).alias("many")).first()
        self.few, self.many = kept["few"], kept["many"]
        big = sizes.where(large).select("model")
        self.small = own.join(big, "model", "left_anti") if self.many else own
        self.large = own.join(big, "model", "left_semi") if self.many else None
        self.kinds = {f.name: f.dataType.simpleString() for f in [*own.schema.fields, *self.points.schema.fields]}

    def tasks(self, rows: int) -> int:
        return max(1, min(rows, 20_000))

    def small_met(self, report: str, make) -> DataFrame:
        """Small models are dealt to groups of about MODELS nuclei, points to blocks of about POINTS: a nucleus travels once for each block, a point once for each group (which has at least a row for each model of it to give)."""
        groups, blocks = max(1, -(-self.few // MODELS)), max(1, -(-self.points.count() // POINTS))
        nuclei = self.small.withColumn("unit", F.pmod(F.xxhash64("model"), F.lit(groups)))
        points = self.points.withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        return met(nuclei, points, blocks, self.dims, self.tasks(4 * groups * blocks), report, make)

    def parts(self) -> tuple[DataFrame, list, list[tuple[int, Boxes]]]:
        """The nuclei of large models with their unit, the models, and for each model its first unit and the boxes of its units.

        Of nuclei at one place of a model only the lowest can be nearest, so the others go first. A model's nuclei are then numbered along a curve through
        space (bits of the axes in turn), and every PART of them are a unit.
        """
        best = F.min(F.struct("nucleus", "value")).alias("best")
        alone = stored(self.large.groupBy("model", "x").agg(best).select("model", "x", "best.nucleus", "best.value"))
        sizes = alone.groupBy("model").agg(F.count("*").alias("size")).orderBy("model").collect()  # at most one for PART nuclei
        ends = [F.min(F.col("x")[k]) for k in range(self.dims)] + [F.max(F.col("x")[k]) for k in range(self.dims)]
        span = alone.agg(*(e.alias(f"e{i}") for i, e in enumerate(ends))).first()
        step = [(span[self.dims + k] - span[k]) / (1 << BITS) for k in range(self.dims)]
        bits = min(BITS, 62 // self.dims)
        cell = [F.least(F.lit((1 << BITS) - 1), ((F.col("x")[k] - span[k]) / step[k]).cast("int")) if step[k] > 0 else F.lit(0) for k in range(self.dims)]
        curve = reduce(lambda a, b: a + b, [F.shiftleft(F.shiftright(c, BITS - 1 - b).bitwiseAND(1).cast("long"), (bits - 1 - b) * self.dims + k) for k, c in enumerate(cell) for b in range(bits)])
        units = [max(1, -(-s["size"] // PART)) for s in sizes]
        if sum(units) > MOST_PARTS:
            raise ValueError(f"more than {MOST_PARTS} parts of {PART} nuclei: their boxes would not fit in a broadcast")
        first, base = np.r_[0, np.cumsum([s["size"] for s in sizes])], np.r_[0, np.cumsum(units)]
        kind = f"model {self.kinds['model']}, first long, base long, number int"
        table = self.spark.createDataFrame([(s["model"], int(f), int(b), i) for i, (s, f, b) in enumerate(zip(sizes, first[:-1], base[:-1], strict=True))], kind)
        counted = positioned(alone.withColumn("curve", curve), ["model", "curve", "nucleus"], "position").join(F.broadcast(table), "model")
        nuclei = stored(counted.select((F.col("base") + F.floor((F.col("position") - 1 - F.col("first")) / PART)).alias("unit"), "model", "number", "nucleus", "value", "x"))
        edge = [f(F.col("x")[k]).alias(f"{f.__name__}{k}") for f in (F.min, F.max) for k in range(self.dims)]
        boxes = np.array([tuple(r)[1:] for r in nuclei.groupBy("unit").agg(*edge).orderBy("unit").collect()])
        return nuclei, table, [(int(b), Boxes(boxes[b:e, : self.dims], boxes[b:e, self.dims :])) for b, e in zip(base[:-1], base[1:], strict=True)]

    def large_met(self) -> DataFrame:
        """(point, model, nucleus, value, d2) of large models in two passes: a point meets the part whose box it is in or nearest to, then only the parts that its distance so far reaches."""
        nuclei, models, boxes = self.parts()
        shared = self.spark.sparkContext.broadcast(boxes)
        dims = self.dims
        spots = stored(self.points.withColumn("row", F.monotonically_increasing_id()))
        matrix = lambda column: column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)
        batch_of = lambda unit, row, number, x: pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), row, pa.array(np.full(len(row), number), pa.int32()), x], names=["unit", "row", "number", "x"])

        def homes(batches):
            for b in batches:
                p = matrix(b.column(1))
                for number, (base, model_boxes) in enumerate(shared.value):
                    yield batch_of(base + model_boxes.nearest(p), b.column(0), number, b.column(1))

        def reached(batches):
            for b in batches:
                p, d2, unit, numbers = matrix(b.column(1)), b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).to_numpy()
                for number in np.unique(numbers):
                    base, model_boxes = shared.value[number]
                    own = np.flatnonzero(numbers == number)
                    who, i = model_boxes.within(p[own], d2[own])
                    who, i = own[who], base + i
                    other = i != unit[who]
                    who = pa.array(who[other])
                    yield batch_of(i[other], b.column(0).take(who), number, b.column(1).take(who))

        kinds = self.kinds
        report = f"point struct<row:bigint,number:int>, x array<double>, unit long, nucleus {kinds['nucleus']}, value {kinds['value']}, d2 double"

        def make(_):
            def found(some, p, trees):
                (_, nuclei_, values, tree), = trees
                best, d2 = tree.nearest(p)
                best = pa.array(best)
                yield pa.RecordBatch.from_arrays([some.column(6), some.column(7), some.column(0), nuclei_.take(best), values.take(best), pa.array(d2)], names=["point", "x", "unit", "nucleus", "value", "d2"])

            return found

        def passed(routed: DataFrame) -> DataFrame:
            routed = stored(routed)
            blocks = stored(routed.groupBy("unit").agg(F.ceil(F.count("*") / POINTS).cast("int").alias("blocks")))
            tasks = blocks.agg(F.sum("blocks")).first()[0] or 1
            own = nuclei.select("unit", F.col("number").alias("model"), "nucleus", "value", "x")
            out = stored(met(own, routed.select("unit", F.struct("row", "number").alias("point"), "x"), F.broadcast(blocks), dims, self.tasks(4 * tasks), report, make))
            drop_stored(routed)
            return out

        kind = "unit long, row long, number int, x array<double>"
        one = passed(spots.select("row", "x").mapInArrow(homes, kind))
        two = passed(one.select("point.row", "x", "d2", "unit", "point.number").mapInArrow(reached, kind))
        best = F.min(F.struct("d2", "nucleus", "value")).alias("best")
        all_ = one.unionAll(two).groupBy("point.row", "point.number").agg(best)
        return all_.join(spots.select("row", "point"), "row").join(F.broadcast(models.select("number", "model")), "number").select("point", "model", "best.nucleus", "best.value", "best.d2")


def nearest_cells(points: DataFrame, nuclei: DataFrame, model: list[str], coords: list[str], point: str = "point_ix", nucleus: str = "nucleus_ix", value: str = "v") -> DataFrame:
    """(point, model..., nucleus, v, d2): the nearest nucleus of every model (chain, iteration, field) to every point; of equally near ones the lowest index.

    Models of up to PART nuclei are searched whole, in groups; larger ones in parts of PART, where a point meets its own part and those that its
    distance reaches. In a task a point tests the boxes of a tree from the top, and opens those within its distance. No task holds more than a group or a
    part, and no row meets all nuclei. Rows with a null coordinate have no distance and are left out.
    """
    e = Ensemble(points, nuclei, model, coords, point, nucleus, value)
    kinds = e.kinds

    def make(_):
        def found(some, p, trees):
            for name, nuclei_, values, tree in trees:
                best, d2 = tree.nearest(p)
                best, same = pa.array(best), pa.array(np.zeros(len(p), np.int64))
                yield pa.RecordBatch.from_arrays([some.column(6), name.take(same), nuclei_.take(best), values.take(best), pa.array(d2)], names=["point", "model", "nucleus", "value", "d2"])

        return found

    rows = e.small_met(f"point {kinds['point']}, model {kinds['model']}, nucleus {kinds['nucleus']}, value {kinds['value']}, d2 double", make)
    if e.many:
        rows = rows.unionByName(e.large_met())
    return rows.select(F.col("point").alias(point), *(F.col(f"model.`{m}`").alias(m) for m in model), F.col("nucleus").alias(nucleus), F.col("value").alias(value), "d2")


def nearest_cell_sums(points: DataFrame, nuclei: DataFrame, model: list[str], coords: list[str], by: list[str], sample=None, order: int = 3, point: str = "point_ix", nucleus: str = "nucleus_ix", value: str = "v") -> DataFrame:
    """(point, by..., n, s1 .. s<order>): power sums, over all models that agree in `by` (some of `model`), of the values of the nearest nuclei: moments.finished() makes moments of them.

    Sums are made where points and models meet, so a row for each point, group of models and `by` leaves a task, not one for each model. sample: a function of numpy arrays
    (value, d2) that gives the number to be summed (the value by default). Points of equal ids count as one point. A null value is left out.
    """
    e = Ensemble(points, nuclei.withColumn(value, F.col(f"`{value}`").cast("double")), model, coords, point, nucleus, value)
    places = [model.index(b) for b in by]
    kind = e.kinds["point"]
    key = "struct<" + ",".join(["_:int", *(f"`{b}`:{nuclei.schema[b].dataType.simpleString()}" for b in by)]) + ">"
    powers = [f"s{i}" for i in range(1, order + 1)]

    def make(models):
        key_of = [tuple(list(m[0].as_py().values())[1 + k] for k in places) for m in models]

        def found(some, p, trees):
            sums: dict[tuple, np.ndarray] = {}
            for own, (_, _, values, tree) in zip(key_of, trees, strict=True):
                best, d2 = tree.nearest(p)
                v = values.to_numpy(zero_copy_only=False).astype(float)[best]
                missing = np.asarray(values.is_null())[best]
                v = v if sample is None else sample(v, d2)
                to = sums.setdefault(own, np.zeros((order + 1, len(p))))
                power = np.where(missing, 0.0, 1.0)
                for row in to:
                    row += power
                    power = power * np.where(missing, 0.0, v)
            for own, to in sums.items():
                names = pa.array([dict(zip(["_", *by], (0, *own), strict=True))] * len(p), key_type)
                yield pa.RecordBatch.from_arrays([some.column(6), names, pa.array(to[0].astype(np.int64)), *map(pa.array, to[1:])], names=["point", "key", "n", *powers])

        return found

    from pyspark.sql.pandas.types import to_arrow_type

    report = f"point {kind}, key {key}, n long, " + ", ".join(f"{s} double" for s in powers)
    key_type = to_arrow_type(e.spark.createDataFrame([], report).schema["key"].dataType)
    rows = e.small_met(report, make)
    if e.many:
        # of large models a point's rows come from several tasks: sums begin where they are brought together
        far = e.large_met()
        v = F.col("value")
        if sample is not None:
            picked = F.pandas_udf(lambda v, d2: pd.Series(sample(v.to_numpy(float), d2.to_numpy(float))), "double")
            v = F.when(v.isNotNull(), picked("value", "d2"))
        far = far.select("point", F.struct(F.lit(0).alias("_"), *(F.col(f"model.`{b}`").alias(b) for b in by)).alias("key"), v.alias("v"))
        rows = rows.unionByName(far.select("point", "key", F.col("v").isNotNull().cast("long").alias("n"), *(F.coalesce(F.pow("v", F.lit(i)), F.lit(0.0)).alias(s) for i, s in enumerate(powers, 1))))
    total = rows.groupBy("point", "key").agg(*(F.sum(c).alias(c) for c in ["n", *powers]))
    return total.select(F.col("point").alias(point), *(F.col(f"key.`{b}`").alias(b) for b in by), "n", *powers)


def cell_neighbours(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, faces): cells that touch, each pair once (a < b), and how many pairs of neighbouring lattice nodes lie on their border. labels: (node_ix, nucleus_ix), the cell of each node of a lattice, by nearest_cells(); pairs: (node_ix, neighbour_ix), each way round. Cells are neighbours as far as the lattice resolves their border."""
    other = labels.select(F.col("node_ix").alias("neighbour_ix"), F.col("nucleus_ix").alias("b"))
    touching = pairs.join(labels.select("node_ix", F.col("nucleus_ix").alias("a")), "node_ix").join(other, "neighbour_ix").where("a < b")
    return touching.groupBy("a", "b").agg(F.count("*").alias("faces"))


def distance2(x: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    """Squared distances of all places of a small lattice (places of each axis) from nuclei x, summed coordinate by coordinate."""
    a, b, c = (np.square(places[:, None] - x[:, k]) for k, places in enumerate(at))
    return (a[:, None, None] + b[None, :, None]) + c[None, None, :]


def lattice_labels(x: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    """The nearest of nuclei x to each place of a lattice (places of each axis); of equally near ones the first. The lattice is cut into cubes, which meet only the nuclei that can be nearest in them."""
    out, tree = np.empty([len(a) for a in at], np.int64), None
    for cube in np.ndindex(*(-(-len(a) // CUBE) for a in at)):
        own = tuple(slice(c * CUBE, (c + 1) * CUBE) for c in cube)
        some = [a[s] for a, s in zip(at, own, strict=True)]
        least, most = np.zeros(len(x)), np.zeros(len(x))
        for k, places in enumerate(some):
            low, high = places[0] - x[:, k], x[:, k] - places[-1]
            least += np.square(np.maximum(0.0, np.maximum(low, high)))
            most += np.square(np.maximum(np.abs(low), np.abs(high)))
        near = np.flatnonzero(least <= most.min() * SLACK)
        if len(near) == 1:
            out[own] = near[0]
        elif len(near) <= AT_ONCE:
            out[own] = near[distance2(x[near], some).argmin(-1)]
        else:
            tree = tree or Tree(x)
            out[own] = tree.nearest(np.stack(np.meshgrid(*some, indexing="ij"), -1).reshape(-1, 3))[0].reshape(out[own].shape)
    return out


def borders(label: np.ndarray, own: list[int], of: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, faces): labels (under `of`) of neighbouring nodes that differ, a < b. A pair is counted where its corner (the lower place on every axis) is among the `own` first places of each axis."""
    codes = []
    for step in np.ndindex(3, 3, 3):
        step = [s - 1 for s in step]
        if step <= [0, 0, 0]:
            continue  # the other way round
        one, two = [], []
        for d, n, have in zip(step, own, label.shape, strict=True):
            end = min(n, have - abs(d))
            one.append(slice(d < 0, end + (d < 0)))
            two.append(slice(d > 0, end + (d > 0)))
        a, b = label[tuple(one)].ravel(), label[tuple(two)].ravel()
        other = a != b
        a, b = a[other], b[other]
        codes.append(np.minimum(a, b) * of + np.maximum(a, b))
    code, faces = np.unique(np.concatenate(codes), return_counts=True)
    return code // of, code % of, faces


def lattice_borders(nuclei: DataFrame, coords: list[str], axes: list[tuple[float, float, int]], nucleus: str = "nucleus_ix") -> DataFrame:
    """cell_neighbours() of the nearest cells of a regular lattice (axes: least and greatest place and their number, for three coords), without a row for a node or a pair.

    The lattice is dealt to tasks in blocks, which overlap by a node. A block gets the nuclei that can be nearest to one of its nodes: no further from its box than the nucleus
    nearest to its middle is from the middle, and half its diagonal. Its nodes are made, labelled and counted there; only faces by pairs of cells leave it. A block has at least
    as many nodes as there are nuclei, so at most a row for each node is shuffled, however the nuclei lie.
    """
    spark = nuclei.sparkSession
    ship(spark)
    xs = [F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(coords)]
    # of nuclei at one place only the lowest can be nearest
    own = stored(nuclei.select(F.col(f"`{nucleus}`").alias("nucleus"), *xs).where("x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL").groupBy("x0", "x1", "x2").agg(F.min("nucleus").alias("nucleus")))
    count = own.count()
    side = CUBE * max(3, -(-(round(count ** (1 / 3)) + 2) // CUBE)) - 1
    blocks = [-(-n // side) for _, _, n in axes]
    total = blocks[0] * blocks[1] * blocks[2]
    number, step, boxes = F.col("block"), 1, spark.range(total).withColumnRenamed("id", "block")
    for k, ((low, high, n), many) in enumerate(zip(axes, blocks, strict=True)):
        first = F.pmod(F.floor(number / step), F.lit(many)) * side
        place = lambda i, low=low, high=high, n=n: F.lit(low) + (high - low) * i / max(1, n - 1)
        boxes = boxes.withColumns({f"low{k}": place(first), f"high{k}": place(F.least(first + side, F.lit(n - 1)))})
        step *= many
    middle = [((F.col(f"low{k}") + F.col(f"high{k}")) / 2).alias(f"x{k}") for k in range(3)]
    near = nearest_cells(boxes.select("block", *middle), own.withColumn("v", F.lit(0.0)), [], ["x0", "x1", "x2"], point="block", nucleus="nucleus").select("block", "d2")
    half = F.sqrt(sum((F.col(f"high{k}") - F.col(f"low{k}")) * (F.col(f"high{k}") - F.col(f"low{k}")) for k in range(3))) / 2
    boxes = stored(boxes.join(near, "block").withColumn("reach", (F.sqrt("d2") + half) * (1 + 1e-9)))
    gap = [F.greatest(F.lit(0.0), F.col(f"low{k}") - F.col(f"x{k}"), F.col(f"x{k}") - F.col(f"high{k}")) for k in range(3)]
    spread = own.repartition(max(1, min(20_000, count * total // 1_000_000)), "nucleus")
    met_ = spread.join(F.broadcast(boxes), sum(g * g for g in gap) <= F.col("reach") * F.col("reach")).select("block", "nucleus", "x0", "x1", "x2")

    def found(key, t):
        at, rest, mine = [], key[0].as_py(), []
        for (low, high, n), many in zip(axes, blocks, strict=True):
            first = rest % many * side
            rest //= many
            at.append(low + (high - low) * np.arange(first, min(n, first + side + 1)) / max(1, n - 1))
            mine.append(min(side, n - first))
        t = t.sort_by("nucleus")
        a, b, faces = borders(lattice_labels(np.stack([t.column(f"x{k}").to_numpy() for k in range(3)], 1), at), mine, len(t))
        name = t.column("nucleus").combine_chunks()
        return pa.table({"a": name.take(pa.array(a)), "b": name.take(pa.array(b)), "faces": pa.array(faces, pa.int64())})

    kind = own.schema["nucleus"].dataType.simpleString()
    parts = met_.repartition(min(total, 20_000), "block").groupBy("block").applyInArrow(found, f"a {kind}, b {kind}, faces long")
    return parts.groupBy("a", "b").agg(F.sum("faces").alias("faces"))


def nearest_value(queries: DataFrame, axis: DataFrame, query: str, position: str, index: str) -> DataFrame:
    """Each query with the index of the nearest value of a short axis (one array; lowest index of equally near ones), so that queries aren't shuffled or multiplied."""
    held = fresh(queries, "_axis")
    row = short(axis).agg(F.collect_list(F.struct(F.col(position).alias("p"), F.col(index).alias("i"))).alias(held))
    pick = F.array_min(F.transform(held, lambda x: F.struct(F.abs(x["p"] - F.col(query)).alias("d"), x["i"].alias("i"))))["i"]
    return queries.join(F.broadcast(row), F.lit(True)).withColumn(index, pick).drop(held)


def nearest_in_time(events: DataFrame, frames: DataFrame, time: str, frame_time: str, frame: str) -> DataFrame:
    """Each event with the frame nearest in time: an as-of join in both directions. frames is a short table, carried as one sorted array, so that events aren't shuffled or multiplied."""
    held = fresh(events, "_frames")
    row = short(frames).agg(F.sort_array(F.collect_list(F.struct(F.col(frame_time).alias("t"), F.col(frame).alias("f")))).alias(held))
    pick = F.array_min(F.transform(held, lambda x: F.struct(F.abs(x["t"] - F.col(time)).alias("d"), x["f"].alias("f"))))["f"]
    return events.join(F.broadcast(row), F.lit(True)).withColumn(frame, pick).drop(held)


def regular_frames(values: DataFrame, value: str, low: float, step: float, count: int, index: str = "frame") -> DataFrame:
    """Nearest point of a regular axis (1-based, halves up, held within the axis) by arithmetic."""
    from stratum.functions.geo import regular_index

    return values.withColumn(index, F.least(F.lit(count).cast("long"), F.greatest(F.lit(1).cast("long"), regular_index(F.col(value), low, step))))


def velocity_view(nodes: DataFrame, values: DataFrame, lows: list[float], steps: list[float], counts: list[int], coords: list[str], time: float, frames: DataFrame, fields: list[str]) -> DataFrame:
    """nodes with the fields of another lattice's nearest nodes in the frame nearest in time. values: (node_ix, frame, fields); frames: (frame, t), a short table."""
    frame = short(frames).orderBy(F.abs(F.col("t") - time), "frame").limit(1).select("frame")
    mapped = grid_map(nodes, lows, steps, counts, coords, "_other")
    own = values.join(F.broadcast(frame), "frame", "left_semi").select(F.col("node_ix").alias("_other"), *fields)
    return mapped.join(own, "_other", "left").drop("_other")


def grid_map(nodes: DataFrame, lows: list[float], steps: list[float], counts: list[int], coords: list[str], index: str = "other_ix") -> DataFrame:
    """Nodes with the index of the nearest node of another regular lattice: each axis on its own, then the linear index."""
    from stratum.functions.geo import linear_index, regular_index

    i, j, k = (F.least(F.lit(n).cast("long"), F.greatest(F.lit(1).cast("long"), regular_index(F.col(c), low, step))) for c, low, step, n in zip(coords, lows, steps, counts, strict=True))
    return nodes.withColumn(index, linear_index(i, j, k, counts[0], counts[1]))
