"""Near-duplicate vectors by an inverted multi-index.

Vectors are halved, and each half has a codebook of its own (k-means on at most SAMPLE vectors, a documented
bound; every vector is indexed). The product of the codebooks is a grid of cells. A query goes through the cells
in ascending order of the sum of both halves' squared bounds (multi-sequence traversal) and stops when no later
cell can hold a vector within reach: the bounds come from the planes between codewords, so at TARGET = 1 no link
is missed. A smaller target stops at that share of the reach that the sample shows to be enough. Each visited
cell is verified in double precision.

Equal vectors of a label are one class before any of it. Codebooks of 2, 4, 8 ... words are fitted, up to the square
root of the largest label's vectors over PER_CELL (and MOST_WORDS); each label takes, by its size, the one whose cells cost least
on the sample. Neighbouring cells make a group of about BLOCK_BYTES, and a crowded group is cut into blocks of that; a
vector is sent once to each block of the groups that its cells lie in (its list of cells travels without it), the queries
stream past the index in matrix products, and of the links found only a count for each query and a spanning forest leave the task. What a query costs
is the share of cells that can hold a link: small for vectors in clusters, large for vectors without any (of 51,282
random ones in 64 dimensions, 64 words leave 12 percent of all pairs to verify, 2 words 84 percent).

Cases: a null label, a null or zero vector, or one with null or non-finite components links with nothing, nor
do vectors of different lengths; repeated rows are vectors of their own; a null vec_id links with nothing and
keeps null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm.common import cut, lean, ship
from stratum.llm.components import components

COSINE, TARGET = 0.98, 1.0
#: Vectors that codebooks are fitted on, most words of each, and vectors of a label that a cell has on average.
SAMPLE, MOST_WORDS, PER_CELL = 8192, 1024, 4096
#: Bytes of an index block, queries that meet it in one product, and queries that meet one copy of it.
BLOCK_BYTES, QUERIES, MOST_QUERIES = 1 << 23, 256, 1 << 16
SLACK = 1e-9
#: Vectors of the sample that measure a grid, and what a visited cell and a vector met in it cost (microseconds, of which only the ratio counts).
PROBES, STEP_COST, VECTOR_COST = 64, 2.0, 0.02
#: Lengths of vectors that have grids, the commonest; others have one cell.
MOST_LENGTHS = 16


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(-1, keepdims=True)
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(5)
    words = np.unique(x[rng.permutation(len(x))[: 4 * k]], axis=0)
    words = words[rng.permutation(len(words))[:k]]
    for _ in range(rounds):
        near = ((words * words).sum(1) - 2 * x @ words.T).argmin(1)
        for j in range(len(words)):
            if (own := near == j).any():
                words[j] = x[own].mean(0)
    return np.unique(words, axis=0)


def bounds(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared lower bounds of the distance from each x to any vector whose nearest codeword is j: the planes between codewords."""
    d = ((x[:, None] - words[None]) ** 2).sum(2) if len(x) * words.size < 4e6 else (x * x).sum(1)[:, None] + (words * words).sum(1) - 2 * x @ words.T
    own = d.argmin(1)
    gap = np.sqrt(((words[:, None] - words[None]) ** 2).sum(2))
    between = gap[own]
    out = np.divide(d - d[np.arange(len(x)), own][:, None], 2 * between, out=np.zeros_like(d), where=between > 0)
    return np.maximum(0, out - SLACK) ** 2


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 22) // max(1, words.size))
    return np.concatenate([((x[i : i + step, None] - words[None]) ** 2).sum(2).argmin(1) for i in range(0, len(x), step)])


def visits(one: np.ndarray, two: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Cells (i, j) in ascending order of one[i] + two[j], while that is within reach."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    heap, out = [(one[a[0]] + two[b[0]], 0, 0)], []
    while heap and heap[0][0] <= reach:
        _, i, j = heapq.heappop(heap)
        out.append((int(a[i]), int(b[j])))
        if j + 1 < len(b):
            heapq.heappush(heap, (one[a[i]] + two[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (one[a[i + 1]] + two[b[0]], i + 1, 0))
    return out


class Grid:
    """Codebooks of both halves for one length of vectors, and the reach of a traversal."""

    def __init__(self, sample: np.ndarray, k: int, cosine: float, target: float):
        self.half = sample.shape[1] // 2
        x = unit(sample)
        k = min(k, max(1, len(x) // 4))
        self.words = [k_means(x[:, : self.half], k) if self.half else np.zeros((1, 0)), k_means(x[:, self.half :], k)]
        self.reach = 2 - 2 * cosine + SLACK
        if target < 1:  # the share of the reach that links of the sample's vectors with random neighbours at the limit need
            rng = np.random.default_rng(3)
            y = rng.normal(size=x.shape)
            y -= (y * x).sum(1, keepdims=True) * x
            y = cosine * x + (1 - cosine**2) ** 0.5 * unit(y)
            own = self.cells(y)
            one, two = self.bounds(x)
            n = np.arange(len(x))
            self.reach = min(self.reach, float(np.quantile(one[n, own[:, 0]] + two[n, own[:, 1]], target)) + SLACK)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.stack([nearest(h, w) for h, w in zip(self.halves(x), self.words, strict=True)], 1)

    def bounds(self, x: np.ndarray) -> list[np.ndarray]:
        return [bounds(h, w) for h, w in zip(self.halves(x), self.words, strict=True)]


class Grids:
    """Grids of 2, 4, 8 ... codewords for one length of vectors, of which a label takes the one that suits its size.

    Costs are measured on the sample: cells visited, each a step of the traversal, against vectors met in them. Vectors without clusters visit the same share of any
    number of cells, so more cells cost them more; with clusters the share falls.
    """

    def __init__(self, sample: np.ndarray, largest: int, cosine: float, target: float):
        most = int(min(MOST_WORDS, max(2, (largest / PER_CELL) ** 0.5)))
        words = [2]
        while words[-1] * 2 <= most:
            words.append(words[-1] * 2)
        self.grids = [Grid(sample, k, cosine, target) for k in words]
        x = unit(sample[:PROBES])
        # for each grid, cells visited and the share of all vectors that lie in them
        self.visited = np.array([self.probe(g, x, unit(sample)) for g in self.grids])

    def probe(self, grid: Grid, x: np.ndarray, sample: np.ndarray) -> tuple[float, float]:
        one, two = grid.bounds(x)
        own = grid.cells(sample)
        held = np.zeros((len(grid.words[0]), len(grid.words[1])))
        np.add.at(held, (own[:, 0], own[:, 1]), 1 / len(sample))
        seen = []
        for p, q in zip(one, two, strict=True):  # one vector at a time: a grid may have a million cells
            open_ = p[:, None] + q[None, :] <= grid.reach
            seen.append((open_.sum(), held[open_].sum()))
        return tuple(np.mean(seen, axis=0).tolist())

    def levels(self, size: np.ndarray) -> np.ndarray:
        """The grid for labels of these sizes."""
        cost = self.visited[:, 0] * STEP_COST + self.visited[:, 1] * size[:, None] * VECTOR_COST
        return cost.argmin(1)


def matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in column])


def packed(column: str):
    """array<double> as binary doubles."""

    @F.arrow_udf("binary")
    def one(vectors: pa.Array) -> pa.Array:
        return pa.array([np.asarray(v, np.float64).tobytes() for v in vectors.to_pylist()], pa.binary())

    return one(column)


def links_in(index: np.ndarray, queries: np.ndarray, cosine: float) -> np.ndarray:
    """Whether each query links with each index vector (both of length 1)."""
    c = queries @ index.T
    out = c >= cosine
    for q, i in zip(*np.nonzero(np.abs(c - cosine) < 1e-12), strict=True):  # the order of a product's sums must not decide
        out[q, i] = float(np.sum(queries[q] * index[i])) >= cosine
    return out


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links enough to join what the links (a[i], b[i]) join: at most one for each id."""
    root: dict[int, int] = {}

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


FOUND = "a long, b long, n long"


def matched(rows: DataFrame, cosine: float) -> DataFrame:
    """rows: (at: block and part, kind 0 index or 1 query, id, n, v), sorted by at and kind. (a, null, n): links of query a, weighted; (a, b, null): a link of the forest."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        at, ids, weights, vectors, index, waiting = None, [], [], [], None, []

        def answer():
            queries, of = unit(np.stack([v for _, v in waiting])), np.array([i for i, _ in waiting])
            linked = links_in(index, queries, cosine)
            own = np.array(ids)
            q, i = np.nonzero(linked)
            other = of[q] != own[i]
            edges = forest(of[q][other], own[i][other])
            n = linked @ np.array(weights)
            a = np.concatenate([of, np.array([e[0] for e in edges], np.int64)])
            b = pa.array([None] * len(of) + [e[1] for e in edges], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, pa.array([*n.tolist(), *[None] * len(edges)], pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            places, kinds, names, counts = (batch.column(k).to_pylist() for k in range(4))
            for place, kind, name, count, v in zip(places, kinds, names, counts, batch.column(4), strict=True):
                if place != at:
                    if waiting and index is not None:
                        yield answer()
                    at, ids, weights, vectors, index, waiting = place, [], [], [], None, []
                v = np.frombuffer(v.as_buffer(), np.float64)
                if kind == 0:
                    ids.append(name)
                    weights.append(count)
                    vectors.append(v)
                elif vectors or index is not None:
                    if index is None:
                        index, vectors = unit(np.stack(vectors)), []
                    waiting.append((name, v))
                    if len(waiting) == QUERIES:
                        yield answer()
                        waiting = []
        if waiting and index is not None:
            yield answer()

    return rows.mapInArrow(lean(run), FOUND)


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, target: float = TARGET) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of df."""
    ship(df.sparkSession)
    base = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("x"), F.col(f"`{label}`").alias("label"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0)
    base = base.withColumn("sound", F.coalesce(sound, F.lit(False)))
    names = F.when(F.col("sound"), F.xxhash64("label", "x")), F.when(F.col("sound"), F.xxhash64(F.lit(1), "x", "label"))
    base = base.select("vec_id", "x", F.col("label").cast("string").alias("label"), "sound", names[0].alias("k1"), names[1].alias("k2"))
    classes = base.where("sound").groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("x").alias("x"))
    classes = cut(classes.select("k1", "k2", "id", "n", "label", F.size("x").alias("dim"), packed("x").alias("v"), F.monotonically_increasing_id().alias("uid")), "index-classes")
    result = lambda found: base.join(found, ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept"))
    sizes = cut(classes.groupBy("label", "dim").agg(F.count("*").alias("size")), "index-labels")
    largest = sizes.groupBy("dim").agg(F.max("size").alias("size")).orderBy(F.desc("size")).limit(MOST_LENGTHS).collect()
    if not largest:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    sample = classes.orderBy(F.xxhash64("id", "k1"), "id").limit(SAMPLE).select("dim", "v").collect()
    known = {d: np.stack([np.frombuffer(r["v"], np.float64) for r in sample if r["dim"] == d]) for d in sorted({r["dim"] for r in sample})}
    shared = df.sparkSession.sparkContext.broadcast({r["dim"]: Grids(known[r["dim"]], r["size"], cosine, target) for r in largest if r["dim"] in known})

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            dims, size = np.array(b.column("dim")), np.array(b.column("size"))
            row, cells, home = [], [], []
            for d in np.unique(dims).tolist():
                grids = shared.value.get(d)
                levels = grids.levels(size) if grids else np.zeros(len(size), np.int64)
                for level in np.unique(levels[dims == d]).tolist():
                    mine = np.flatnonzero((dims == d) & (levels == level))
                    if grids is None:  # a length that the sample lacks has one cell
                        row, cells, home = row + mine.tolist(), cells + [0] * len(mine), home + [True] * len(mine)
                        continue
                    grid = grids.grids[level]
                    x = unit(matrix(b.column("v").take(pa.array(mine))))
                    own, (one, two) = grid.cells(x), grid.bounds(x)
                    for r, o, p, q in zip(mine.tolist(), own.tolist(), one, two, strict=True):
                        for i, j in {(o[0], o[1]), *visits(p, q, grid.reach)}:
                            row.append(r)
                            cells.append(i * MOST_WORDS + j)
                            home.append([i, j] == o)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("uid").take(at), b.column("label").take(at), b.column("dim").take(at), pa.array(cells, pa.int64()), pa.array(home, pa.bool_())], names=["uid", "label", "dim", "cell", "home"])

    sized = classes.join(sizes, ["label", "dim"]).select("uid", "label", "dim", "size", "v")
    placed = cut(sized.mapInArrow(lean(place), "uid long, label string, dim int, cell long, home boolean"), "index-places")
    # neighbouring cells of a label, of at most MOST_WORDS^2, make a group of about a block; a vector is sent once to each group that holds a cell it visits
    homes = placed.where("home").groupBy("label", "dim", "cell").agg((F.count("*") * F.col("dim") * 8).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("label", "dim").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cut(homes.select("label", "dim", "cell", "bytes", F.floor(before / BLOCK_BYTES).alias("group")), "index-cells")
    visited = placed.join(cells, ["label", "dim", "cell"]).groupBy("uid", "label", "dim", "group").agg(F.max("home").alias("home"))
    visited = cut(visited, "index-visits")
    blocks = cells.groupBy("label", "dim", "group").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
    groups = blocks.join(visited.groupBy("label", "dim", "group").agg(F.ceil(F.count("*") / MOST_QUERIES).cast("int").alias("parts")), ["label", "dim", "group"])
    dealt = visited.join(groups, ["label", "dim", "group"]).join(classes.select("uid", "id", "n", "v"), "uid")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = F.pmod(F.xxhash64("uid"), F.lit(2**31)).cast("long")
    index = dealt.where("home").select("label", "dim", "group", F.pmod(own, "blocks").alias("block"), every("parts").alias("part"), F.lit(0).alias("kind"), "id", "n", "v")
    query = dealt.select("label", "dim", "group", F.pmod(own, "parts").alias("part"), every("blocks").alias("block"), F.lit(1).alias("kind"), "id", "n", "v")
    rows = index.unionByName(query).select(F.concat_ws(" ", "label", "dim", "group", "block", "part").alias("at"), "kind", "id", "n", "v")
    found = cut(matched(rows.repartition("at").sortWithinPartitions("at", "kind"), cosine), "index-links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg((F.sum("n") - 1).alias("n_links"))
    comps = components(found.where("b IS NOT NULL").select("a", "b"), "index-components")
    answers = classes.select("k1", "k2", "id").join(counts, "id").join(comps, F.col("id") == comps.node, "left")
    return result(answers.select("k1", "k2", "n_links", F.coalesce("component", "id").alias("component")))
