"""Best-fit packing by a grouping genetic algorithm, on islands with elite migration.

Tokens: a tokenizer file that drops white space and case, and whose pre-tokens never cross the place between an ASCII
letter or digit and ASCII punctuation other than the apostrophe, is known by its parts (see by_words). A text is cut at such places to words, and ASCII
letters are put in lower case but for those before another kind of character (see folded); a worker keeps each
word's ids (as the library gives them) in a sorted table of hashes and encodes only new words. Texts that may hold
a special token, and all texts by other files, are encoded whole.

Packing: pieces are dealt by hash to problems of about PROBLEM pieces, so the work of a task does not grow with
the input. ISLANDS populations of each problem, begun from plans in random order, evolve apart for GENERATIONS, then send their best plan to the
next island (a ring) and go on. A crossover injects whole well-filled bins of one parent into the other, removes
the bins that hold a piece twice, and best-fits the displaced pieces. The best plan of a problem stands (but for best-fit decreasing, if
that should take fewer bins); pieces
of its badly filled bins are dealt to fewer new problems and packed again, and the better of the two packings
of all of them is kept.

Cases: a null or empty text is the end id alone; a text over SIZE tokens is cut to full pieces and a rest; rows
that repeat are packed each for itself; a null doc_id is kept; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import json
import os
import random
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import cut, keyed_bytes, lean, ship
from stratum.llm.word_table import WordTable

SIZE, END = 2048, 0
PROBLEM, ISLANDS, POPULATION, GENERATIONS, EPOCHS = 4096, 2, 4, 12, 2
#: A bin this full is well filled; emptier ones are packed again at the end.
WELL = 0.97
#: Words a worker's table holds (about 60 bytes each, kept from task to task), and bytes of text whose words are looked up together.
REMEMBERED, TOGETHER = 1_000_000, 1 << 21
#: 0 ASCII spaces, 1 ASCII letters and digits, 2 ASCII punctuation, 3 the apostrophe and all other bytes.
KINDS = np.array([0 if i in (32, 9, 10, 11, 12, 13) else 1 if chr(i).isalnum() and i < 128 else 2 if 32 < i < 127 and i != 39 else 3 for i in range(256)], np.int8)
SPECIAL = b"<|"
#: Normaliser and pre-tokenizer of the files for which texts may be cut to words as above.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def by_words(library) -> bool:
    """Whether a text's ids are those of its words: the normaliser drops white space and case, no pre-token crosses a place where texts are cut, and every added token holds SPECIAL."""
    made = json.loads(library.to_str())
    cut_ = made["pre_tokenizer"] or {}
    steps = cut_.get("pretokenizers") or [{}, {}]
    return (
        made["normalizer"] == NORMALISER
        and made["model"]["type"] == "BPE"
        and not made["model"].get("dropout")
        and len(steps) == 2
        and steps[0] == {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
        and steps[1].get("type") == "ByteLevel"
        and not steps[1]["add_prefix_space"]
        and not steps[1]["use_regex"]
        and all(SPECIAL in t["content"].encode() and not t["lstrip"] and not t["rstrip"] and not t["normalized"] for t in made["added_tokens"])
    )


def folded(joined: bytes) -> bytes:
    """ASCII capitals in lower case, but for those that a character beyond ASCII follows: the library composes (NFC) before it lowers, and some capitals have no composed form where the small letter has one."""
    low = joined.lower()
    if joined.isascii():
        return low
    raw = np.frombuffer(joined, np.uint8)
    kept = np.flatnonzero((raw[:-1] - np.uint8(65) < 26) & (raw[1:] > 127))
    if not len(kept):
        return low
    out = np.frombuffer(low, np.uint8).copy()
    out[kept] = raw[kept]
    return out.tobytes()


class WordIds:
    """Ids of texts by the tokenizer file at path."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.plain = by_words(self.library)
        self.words = WordTable(self.learn, REMEMBERED)

    def learn(self, words: list[bytes]) -> tuple[list, list[bool]]:
        found = self.library.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [e.ids for e in found], [True] * len(words)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each."""
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        whole = [not self.plain or SPECIAL in t for t in texts]
        if any(whole):
            whole = [np.array(self.library.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32) if w else self([t])[0] for t, w in zip(texts, whole, strict=True)]
            return np.concatenate(whole), np.fromiter(map(len, whole), np.int64, len(whole))
        joined = folded(b" ".join([*texts, b""]))
        kind = KINDS[np.frombuffer(joined, np.uint8)]
        before = np.concatenate([np.zeros(1, np.int8), kind[:-1]])
        change = (before + kind == 3) & (before != 0) & (kind != 0)
        start = np.flatnonzero((kind != 0) & ((before == 0) | change))
        end = np.flatnonzero((kind != 0) & np.concatenate([(kind[1:] == 0) | change[1:], [True]])) + 1
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]))
        ids, count, _ = self.words(joined, start, end)
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(total[bounds])


@cache
def word_ids(path: str) -> WordIds:
    """The worker's own table, which outlives a task: words learned by one task serve those after it."""
    return WordIds(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """The pieces of each (doc_id, data): tokens by the file at path, the end id, cut at size."""

    def run(batches):
        words = word_ids(path)
        for b in batches:
            data = [x.as_py() for x in b.column(1)]
            ids_of, rows, at = b.column(0).to_pylist(), [], 0
            while at < len(data):
                end, n = at, 0
                while end < len(data) and (end == at or n + len(data[end]) < TOGETHER):
                    n, end = n + len(data[end]) + 1, end + 1
                ids, counts = words(data[at:end])
                ids = np.insert(ids, np.cumsum(counts), END).astype("<u4")
                place = 0
                for doc, n in zip(ids_of[at:end], (counts + 1).tolist(), strict=True):
                    for k, start in enumerate(range(0, n, size)):
                        length = min(size, n - start)
                        rows.append((doc, k, start, length, zlib.crc32(ids[place + start : place + start + length])))
                    place += n
                at = end
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    ship(docs.sparkSession)
    return docs.mapInArrow(lean(run), PIECES)


class Bins:
    """Bins by free space: the least space that holds a piece is found from the set bits of one integer."""

    def __init__(self, size: int):
        self.size, self.mask, self.by_free, self.bins, self.fill = size, 0, {}, [], []

    def add(self, members: list[int], fill: int) -> None:
        self.bins.append(members)
        self.fill.append(fill)
        self.file(len(self.bins) - 1)

    def file(self, k: int) -> None:
        free = self.size - self.fill[k]
        if free:
            self.by_free.setdefault(free, []).append(k)
            self.mask |= 1 << free

    def best_fit(self, item: int, length: int) -> None:
        fits = self.mask >> length
        if not fits:
            self.add([item], length)
            return
        free = length + (fits & -fits).bit_length() - 1
        k = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask ^= 1 << free
        self.bins[k].append(item)
        self.fill[k] += length
        self.file(k)


Plan = list[list[int]]


def packed(lengths: list[int], order: list[int], size: int, kept: Plan = ()) -> Plan:
    bins = Bins(size)
    for members in kept:
        bins.add(list(members), sum(lengths[i] for i in members))
    for i in order:
        bins.best_fit(i, lengths[i])
    return bins.bins


def fitness(plan: Plan, lengths: list[int], size: int) -> float:
    """Mean squared fill: fewer bins and better filled ones count more."""
    return sum((sum(lengths[i] for i in b) / size) ** 2 for b in plan) / max(1, len(plan))


def fills(plan: Plan, lengths: list[int]) -> list[int]:
    return [sum(lengths[i] for i in b) for b in plan]


def dismantled(kept: Plan, lengths: list[int], share: float) -> tuple[Plan, list[int]]:
    """kept without that share of its bins, the worst filled ones, and the pieces those held."""
    order = sorted(range(len(kept)), key=lambda k, f=fills(kept, lengths): -f[k])
    n = len(kept) - int(share * len(kept))
    return [kept[k] for k in order[:n]], [i for k in order[n:] for i in kept[k]]


def crossover(to: Plan, of: Plan, lengths: list[int], size: int, rng: random.Random, share: float = 0.0) -> Plan:
    """Inject a random half of of's well-filled bins into to, remove the bins of to that hold one of their pieces, and best-fit the displaced pieces, longest first. share: of the bins left, that many of the worst are emptied as well (mutation)."""
    good = [b for b, f in zip(of, fills(of, lengths), strict=True) if f >= WELL * size]
    chosen = [b for b in (good or of) if rng.random() < 0.5]
    injected = {i for b in chosen for i in b}
    kept, displaced = list(chosen), []
    for b in to:
        if injected.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in injected]
    kept, more = dismantled(kept, lengths, share)
    return packed(lengths, sorted(displaced + more, key=lambda i: -lengths[i]), size, kept)


def mutated(plan: Plan, lengths: list[int], size: int, rng: random.Random) -> Plan:
    """Empty some of the bins, the worst filled ones, and best-fit their pieces, longest first."""
    kept, displaced = dismantled(plan, lengths, rng.random())
    return packed(lengths, sorted(displaced, key=lambda i: -lengths[i]), size, kept)


def evolve(lengths: list[int], population: list[Plan], generations: int, rng: random.Random, size: int = SIZE, history: list[int] | None = None) -> list[Plan]:
    """POPULATION plans, best first. New plans take pieces in random order, so that what is gained comes from crossovers. history: takes the least number of bins before and after each generation."""
    least = -(-sum(lengths) // size)
    while len(population) < POPULATION:
        population.append(packed(lengths, rng.sample(range(len(lengths)), len(lengths)), size))
    rank = lambda p: (len(p), -fitness(p, lengths, size))
    rated = sorted(((rank(p), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
    for k in range(generations + 1):
        if history is not None:
            history.append(rated[0][0][0])
        if rated[0][0][0] == least or k == generations:
            break  # no plan has fewer bins
        a, b = rng.sample(rated, 2)
        child = crossover(a[2], b[2], lengths, size, rng, rng.random())
        rated.append((rank(child), len(population) + k, child))
        rated = sorted(rated, key=lambda x: x[:2])[:POPULATION]
    return [p for _, _, p in rated[:POPULATION]]


def coded(plan: Plan, n: int) -> bytes:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(plan):
        out[b] = k
    return out.tobytes()


def decoded(data: bytes) -> Plan:
    out: Plan = []
    for i, k in enumerate(np.frombuffer(data, np.int32).tolist()):
        while len(out) <= k:
            out.append([])
        out[k].append(i)
    return out


ISLES = "problem long, island int, items array<long>, lengths array<int>, plans array<binary>"


def epoch(isles: DataFrame, number: int, size: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                problem, island, items, lengths, plans = (b.column(k)[i].as_py() for k in range(5))
                rng = random.Random(f"{problem} {island} {number}")
                best = evolve(lengths, [decoded(p) for p in plans], GENERATIONS, rng, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([problem], pa.int64()), pa.array([island], pa.int32()), pa.array([items], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([[coded(p, len(items)) for p in best]], pa.list_(pa.binary()))],
                    names=["problem", "island", "items", "lengths", "plans"],
                )

    return isles.mapInArrow(lean(run), ISLES)


def solved(items: DataFrame, problems: int, name: str, size: int) -> DataFrame:
    """items: (item long, length int). (item, length, problem, bin, fill): the best plan of each of so many problems."""
    none = F.array().cast("array<binary>")
    dealt = items.groupBy(F.pmod(F.xxhash64("item"), F.lit(problems)).alias("problem")).agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("i"))
    isles = dealt.select("problem", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), F.col("i.item").alias("items"), F.col("i.length").alias("lengths"), none.alias("plans"))
    isles = isles.repartition(min(problems * ISLANDS, 20_000), "problem", "island")
    for k in range(EPOCHS):
        isles = cut(epoch(isles, k, size), name)
        if k + 1 < EPOCHS:  # each island's best plan goes to the next one
            elite = isles.select("problem", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.slice("plans", 1, 1).alias("elite"))
            isles = isles.join(elite, ["problem", "island"]).select("problem", "island", "items", "lengths", F.concat("elite", "plans").alias("plans"))

    def best(batches):
        for b in batches:
            for i in range(b.num_rows):
                problem, items, lengths, plan = (b.column(k)[i].as_py() for k in range(4))
                bins = np.frombuffer(plan, np.int32)
                bound = packed(lengths, sorted(range(len(lengths)), key=lambda i: -lengths[i]), size)
                if len(bound) <= bins.max():  # best-fit decreasing is the most bins that a plan may take
                    bins = np.frombuffer(coded(bound, len(lengths)), np.int32)
                fill = np.bincount(bins, weights=lengths).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(lengths, pa.int32()), pa.array([problem] * len(items), pa.int64()), pa.array(bins, pa.int32()), pa.array(fill[bins], pa.int64())], names=["item", "length", "problem", "bin", "fill"])

    chosen = isles.select("problem", "items", "lengths", F.col("plans")[0].alias("plan"), "island")
    marked = chosen.mapInArrow(lean(counted), "problem long, items array<long>, lengths array<int>, plan binary, island int, bins int")
    one = marked.groupBy("problem").agg(F.min_by(F.struct("items", "lengths", "plan"), F.struct("bins", "island")).alias("x")).select("problem", "x.*")
    return one.mapInArrow(lean(best), "item long, length int, problem long, bin int, fill long")


def counted(batches):
    for b in batches:
        bins = [int(np.frombuffer(p.as_py(), np.int32).max()) + 1 for p in b.column("plan")]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bins, pa.int32())], names=[*b.schema.names, "bins"])


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of df."""
    # a written table's rows keep their numbers, however often a lost task runs again
    made = cut(pieces(keyed_bytes(df, key, text), path, size), "packing-pieces")
    made = cut(made.withColumn("item", F.monotonically_increasing_id()), "packing-items")
    full = made.where(F.col("length") == size).withColumn("sequence_id", 3 * F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    items = made.where(F.col("length") < size).select("item", F.col("length").cast("int").alias("length"))
    total = items.count()
    if not total:
        return full.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    problems = -(-total // PROBLEM)
    plan = cut(solved(items, problems, "packing-isles", size), "packing-plan")
    if problems > 1:
        rest = plan.where(F.col("fill") < WELL * size)
        n, was = rest.agg(F.count("*"), F.countDistinct("problem", "bin")).first()
        if n:
            again = cut(solved(rest.select("item", "length"), -(-n // PROBLEM), "packing-again", size), "packing-rest")
            if again.agg(F.countDistinct("problem", "bin")).first()[0] < was:
                plan = plan.where(F.col("fill") >= WELL * size).unionByName(again.withColumn("problem", -1 - F.col("problem")))
    # bins are numbered by their smallest item, so numbers of full pieces (multiples of 3) are left free
    bins = plan.groupBy("problem", "bin").agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("m"))
    placed = bins.select((3 * F.col("m")[0]["item"] + 1).alias("sequence_id"), F.posexplode("m").alias("k", "x"), "m")
    placed = placed.select("sequence_id", F.col("x.item").alias("item"), F.expr("aggregate(slice(m, 1, k), 0L, (s, y) -> s + y.length)").alias("offset"))
    out = made.join(placed, "item").unionByName(full)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
