"""MinHash near-duplicates with min-max hashing, banding and links confirmed on full sets.

1. Every document's set (distinct word shingles, as 64-bit hashes) gives its size, a digest and, for each of
   HASHES hash functions, both the minimum and the maximum: 2 * HASHES signature values from HASHES evaluations.
2. Documents with equal sets are one class; only its smallest doc_id goes on.
3. ROWS signature values make a band. Of each bucket, the member that shares most bucket places with others is
   the pivot; the others are confirmed against it on full sets. Linked members then form components, so that a
   group of near copies collapses without its pairs being listed. This is done PIVOT_ROUNDS times.
4. Members of buckets that still hold different components are dealt in blocks. A block first compares signatures:
   a pair across components that agrees in half of it (a pair at the limit agrees in three quarters; fewer than half
   has a chance of about 1e-10) is a candidate in the first bucket the two share. The texts of members with a
   candidate then come to their blocks, where candidates are confirmed on full sets and only a spanning forest of
   the links leaves. So every pair that shares a bucket is confirmed, in one component already, or too far apart;
   and no step lists the pairs of a bucket.

Cases: null and empty texts, and texts without words, have the empty set and link with nothing; fewer than
five words are one shingle; repeated rows of a doc_id give one row each with that id's component, also where their
texts differ (the id then links with whatever any of them links with); rows with a null doc_id link with nothing and
keep a null component; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import cut, drop_cut, keyed_bytes, lean, semi, ship, small_ids
from stratum.llm.components import components

WORDS, NEED, OF = 5, 75, 100
HASHES, ROWS = 64, 4
BANDS = 2 * HASHES // ROWS
#: Words remembered by a worker, between two emptyings.
REMEMBERED = 200_000
PIVOT_ROUNDS = 2
#: Members of a bucket compared with each other in one matrix, shingles of all of them together (a block's sets, of 8 bytes each, are held at once), and the share of the signature two must agree in.
BLOCK, BLOCK_SHINGLES, AGREE = 512, 1 << 20, 0.5
#: Members confirmed against one pivot in a group of rows; a pivot with more of them is repeated.
GROUP = 512

ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingles:
    """Sets of word shingles as sorted distinct 64-bit hashes; words' hashes are remembered between documents."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}
        self.powers = np.array([pow(int(ODD), k, 2**64) for k in range(words)], dtype=np.uint64)

    def __call__(self, data: bytes) -> np.ndarray:
        words = data.lower().split()  # on bytes: A-Z only, and the six ASCII spaces only
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = set(words).difference(known)
        for w in new:
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(words))
        with np.errstate(over="ignore"):
            total = np.zeros(len(h) - n + 1, np.uint64)
            for k in range(n):
                total += h[k : k + len(total)] * self.powers[k]
            total = mixed(total + np.uint64(n))
        return np.unique(total)


def multipliers(n: int = HASHES) -> np.ndarray:
    """Odd multipliers and added constants of the hash functions, by a fixed rule."""
    raw = [int.from_bytes(hashlib.blake2b(f"min-max {i}".encode(), digest_size=16).digest(), "little") for i in range(n)]
    return np.array([[(r & (2**64 - 1)) | 1, r >> 64] for r in raw], dtype=np.uint64)


def signature(hashes: np.ndarray, functions: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each function: [min 0, max 0, min 1, max 1, ...]."""
    low, high = np.full(len(functions), 2**64 - 1, np.uint64), np.zeros(len(functions), np.uint64)
    for at in range(0, len(hashes), 1024):  # blocks that stay in cache
        values = functions[:, :1] * hashes[None, at : at + 1024] + functions[:, 1:]
        np.minimum(low, values.min(1), out=low)
        np.maximum(high, values.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band. A band takes values of different functions only, minima as well as maxima."""
    parts = np.concatenate([sig[0::2], np.roll(sig[1::2], len(sig) // 8)]).reshape(rows, -1)
    with np.errstate(over="ignore"):
        key = np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * ODD
        for p in parts:
            key = mixed(key ^ p) * ODD
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, need: int = NEED, of: int = OF) -> bool:
    """Whether of * |a and b| >= need * |a or b|, for sorted distinct values."""
    if not len(a) or not len(b) or of * min(len(a), len(b)) < need * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return of * inter >= need * (len(a) + len(b) - inter)


SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>, low binary"


def signed(docs: DataFrame) -> DataFrame:
    """Set size, digest of the whole set, band keys and each signature value's low byte, of each (doc_id, data)."""

    def run(batches):
        sets, functions = Shingles(), multipliers()
        for b in batches:
            n, keys, own, low = [], [], [], []
            for x in b.column(1):
                s = sets(x.as_py())
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig = signature(s, functions) if len(s) else None
                own.append(bands(sig) if len(s) else None)
                low.append(sig.astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(own, pa.list_(pa.int64())), pa.array(low, pa.binary())], names=["doc_id", "n_shingles", "set_key", "bands", "low"])

    ship(docs.sparkSession)
    return docs.mapInArrow(lean(run), SIGNED)


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The links among pairs (a, b): both texts are read, and full sets compared. A pivot a with many partners is repeated for each GROUP of them."""
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    dealt = pairs.join(load, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    ids = cut(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct(), "minhash-ids")
    texts = semi(docs, ids, ["doc_id"]).dropDuplicates(["doc_id"])
    pivots = load.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("a", "part", F.col("a").alias("b"), F.lit(0).alias("kind"))
    rows = pivots.unionAll(dealt.select("a", "part", "b", F.lit(1).alias("kind")))
    rows = rows.join(texts, rows.b == texts.doc_id).select("a", "part", "kind", "b", "data")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "kind")

    def run(batches) -> Iterator[pa.RecordBatch]:
        sets, pivot, of = Shingles(), np.empty(0, np.uint64), None
        for batch in batches:
            found_a, found_b = [], []
            for a, part, kind, b, data in zip(*(batch.column(i) for i in range(5)), strict=True):
                at = a.as_py(), part.as_py()
                if kind.as_py() == 0:
                    pivot, of = sets(data.as_py()), at
                elif at == of and similar(pivot, sets(data.as_py())):
                    found_a.append(at[0])
                    found_b.append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(lean(run), "a long, b long")


BLOCKS = "key long, i int, j int, own int, doc_id long, component long"


def candidates(key: int, members: list[tuple]) -> Iterator[tuple[int, int]]:
    """Places (k, x) of a block's members (own block, id, component, low, bands, ...) across components, and across blocks if there are two, whose signatures agree and who share no earlier bucket."""
    own, comps = (np.array([m[k] for m in members]) for k in (0, 2))
    low = np.frombuffer(b"".join(m[3] for m in members), np.uint8).reshape(len(members), -1)
    places = np.array([m[4] for m in members], np.int64)
    across = own.min() != own.max()
    for k in range(len(members) - 1):
        open_ = comps[k + 1 :] != comps[k]
        if across:
            open_ &= own[k + 1 :] != own[k]
        rest = open_.nonzero()[0] + k + 1
        if len(rest):
            near = rest[(low[rest] == low[k]).sum(1) >= AGREE * low.shape[1]]
            if len(near):
                first = (places[near] == places[k]).argmax(1)
                for x in near[places[k][first] == key].tolist():
                    yield k, x


def by_block(rows: DataFrame, answer, schema: str) -> DataFrame:
    """answer(key, i, j, members) for each (key, i, j) of rows; it gives columns."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    kinds = [{"long": pa.int64(), "int": pa.int32()}[part.strip().split(" ")[1]] for part in schema.split(",")]

    def run(batches) -> Iterator[pa.RecordBatch]:
        at, members = None, []

        def answered():
            found = list(answer(*at, members)) if len(members) > 1 else []
            cols = list(zip(*found, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            for key, i, j, *member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != at:
                    if len(members) > 1:
                        yield answered()
                    at, members = (key, i, j), []
                members.append(member)
        if len(members) > 1:
            yield answered()

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lean(run), schema)


def with_candidates(key, i, j, members):
    some = {m for pair in candidates(key, members) for m in pair}
    return [(key, i, j, members[m][0], members[m][1], members[m][2]) for m in sorted(some)]


def links_of(key, i, j, members):
    """Links (a, b) that join a block's members, as few as do; members' last column is the text."""
    sets, made, root, held = Shingles(), {}, {}, 0

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def own(m):
        nonlocal held
        if m not in made:
            if held > 4 * BLOCK_SHINGLES:  # more than a block is meant to hold: sets are made again when asked for
                made.clear()
                held = 0
            made[m] = sets(members[m][5])
            held += len(made[m])
        return made[m]

    out = []
    for a, b in candidates(key, members):
        p, q = top(members[a][2]), top(members[b][2])
        if p != q and similar(own(a), own(b)):
            root[max(p, q)] = min(p, q)
            out.append((min(members[a][1], members[b][1]), max(members[a][1], members[b][1])))
    return out


def block_links(state: DataFrame, signatures: DataFrame, docs: DataFrame) -> DataFrame:
    """state: (key, doc_id, component) of buckets with different components; signatures: (doc_id, low, bands, n_shingles). (a, b): links that join what the buckets' links join."""
    load = F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)
    parts = state.join(signatures.select("doc_id", "n_shingles"), "doc_id").groupBy("key").agg(F.ceil(load).cast("int").alias("parts"))
    rows = state.join(parts, "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # a block meets each other block once, and itself
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "component")
    order = ["key", "i", "j", "own", "doc_id", "component", "low", "bands"]
    members = cut(by_block(rows.join(signatures, "doc_id").select(order), with_candidates, BLOCKS), "minhash-blocks")
    ids = cut(members.select("doc_id").distinct(), "minhash-ids")
    texts = semi(docs, ids, ["doc_id"]).dropDuplicates(["doc_id"])
    return by_block(members.join(signatures, "doc_id").join(texts, "doc_id").select(*order, "data"), links_of, "a long, b long")


def linked(members: DataFrame, docs: DataFrame, signatures: DataFrame) -> DataFrame | None:
    """Components of the documents in members (key, doc_id: places in buckets of two or more): (node, component) of those that aren't their component's smallest, or None without any bucket. signatures: (doc_id, low, bands, n_shingles)."""
    if members.isEmpty():
        return None
    sizes = members.groupBy("key").agg((F.count("*") - 1).alias("others"))
    weight = members.join(sizes, "key").groupBy("doc_id").agg(F.sum("others").alias("weight"))
    # order in which members of a bucket serve as pivots: those with most company first
    ranked = cut(members.join(weight, "doc_id").select("key", "doc_id", F.struct(-F.col("weight"), F.col("doc_id")).alias("order")), "minhash-members")
    state, links, comps, tried = ranked.withColumn("component", F.col("doc_id")), None, None, None
    for turn in range(PIVOT_ROUNDS + 1):
        # members that no pivot so far has settled, of buckets with different components
        open_ = state if tried is None else state.join(tried, ["key", "doc_id"], "left_anti")
        mixed_ = open_.join(open_.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("key"), "key", "left_semi")
        if turn < PIVOT_ROUNDS:
            pivot = cut(mixed_.groupBy("key").agg(F.min_by(F.struct("doc_id", "component"), "order").alias("p")).select("key", F.col("p.doc_id").alias("a"), F.col("p.component").alias("of")), "minhash-pivots")
            pairs = mixed_.join(pivot, "key").where("component <> of").select("a", F.col("doc_id").alias("b")).distinct()
            used = pivot.select("key", F.col("a").alias("doc_id"))
            tried = used if tried is None else tried.unionAll(used)
            pairs = cut(pairs, "minhash-pairs")
            new = cut(confirmed(pairs, docs), "minhash-links")
            drop_cut(pairs)
        else:
            new = cut(block_links(mixed_.select("key", "doc_id", "component"), signatures, docs), "minhash-links")
        links = new if links is None else links.unionAll(new)
        comps = components(links, "minhash-components", roots=False)
        state = ranked.join(comps, ranked.doc_id == comps.node, "left").select("key", "doc_id", "order", F.coalesce("component", "doc_id").alias("component"))
    return comps


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of df. Rows of one doc_id with different texts link with whatever any of them links with."""
    docs = keyed_bytes(df, key, text)
    sig = cut(signed(docs), "minhash-signed")
    sets = sig.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(f(F.coalesce("set_key", F.lit(b""))).alias(n) for f, n in ((F.min, "p"), (F.max, "q"))))
    twice = sets.where("p <> q")  # the empty set counts, lest its text stand for the id's other one
    if twice.isEmpty():
        return grouped(docs, sig)
    # an id that stands for several texts can't name a set: rows are numbered, and their groups taken back to ids
    drop_cut(sig)
    rows = cut(docs.withColumn("row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "minhash-rows")
    numbered = rows.select(F.col("row").alias("doc_id"), "data")
    found = grouped(numbered, cut(signed(numbered), "minhash-signed")).select(F.col("doc_id").alias("row"), "n_shingles", "component_id")
    ids = rows.select("row", "doc_id")
    named = cut(ids.where("row IS NOT NULL").join(found, "row").select("doc_id", "n_shingles", "component_id"), "minhash-named")
    least = named.groupBy("component_id").agg(F.min("doc_id").alias("a"))
    comps = components(cut(named.join(least, "component_id").select("a", F.col("doc_id").alias("b")), "minhash-ids"), "minhash-components")
    out = named.join(comps, named.doc_id == comps.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.unionAll(found.where("row IS NULL").select(F.col("row").alias("doc_id"), "n_shingles", F.col("row").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def grouped(docs: DataFrame, sig: DataFrame) -> DataFrame:
    """near_duplicates() of (doc_id, data), whose signatures are sig: an id has one text, if perhaps several rows."""
    whole = sig.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = cut(whole.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("low").alias("low"), F.first("n_shingles").alias("n_shingles")), "minhash-classes")
    placed = classes.select(F.col("rep").alias("doc_id"), F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = cut(placed.join(shared, "key").select("key", "doc_id").distinct(), "minhash-buckets")
    comps = linked(members, docs, classes.select(F.col("rep").alias("doc_id"), "low", "bands", "n_shingles"))
    reps = classes.select("set_key", "rep")
    if comps is not None:
        reps = reps.join(comps, reps.rep == comps.node, "left").select("set_key", F.coalesce("component", "rep").alias("rep"))
    own = whole.select("doc_id", "set_key").join(reps, "set_key").groupBy("doc_id").agg(F.min("rep").alias("component_id"))
    return sig.join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), (F.col("doc_id") == F.coalesce("component_id", "doc_id")).alias("kept"))


def distinct(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the rows of documents whose component has a smaller doc_id; of a kept doc_id's rows that with the least text hash stays. Rows with a null id stay; other columns may have any name."""
    found = near_duplicates(df, key, text)
    gone = cut(found.where("NOT kept").select(F.col("doc_id").alias("id")).distinct(), "minhash-gone")
    again = cut(found.where("kept").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"), "minhash-again")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    kept = rows.join(F.broadcast(gone) if small_ids(gone) else gone, "id", "left_anti")
    if not again.isEmpty():
        side = F.broadcast(again) if small_ids(again) else again
        one = kept.join(side, "id", "left_semi").groupBy("id").agg(F.min_by("row", F.xxhash64(F.col(f"row.`{text}`").cast("string"))).alias("row"))
        kept = kept.join(side, "id", "left_anti").unionByName(one)
    return kept.select(*(F.col(f"row.`{c}`") for c in df.columns))
