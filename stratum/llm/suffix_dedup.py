"""Removal of repeated byte strings: every byte covered by a string of span bytes that starts at two or more places.

1. Winnowing deals the work. Of the byte grams inside a string the one with the least hash is its anchor, which
   depends on the string alone: equal strings have equal anchors. The starts that share an anchor are a run, cut in
   two halves; the bytes their strings cover are a segment. A segment's key is the hash of the bytes that all its
   strings share (212 of 400), so strings can be equal only within a key, and keys of one segment are done.
2. Equal segments of a key are one class; two real segments of it go on at most, as more add nothing.
3. The segments of a key form a text whose suffix array is built by linear grouping; starts of full strings that
   are neighbours in it and agree byte for byte repeat. Where keys have one class each and follow one another in
   the same two documents, their segments overlap: each such chain is one text, so no byte is sorted twice.
4. Repeated starts go back to every segment of their class, and are merged to spans for each document.

A key with more than CLASSES classes is dealt anew: two members of each of its classes, enough to stand for all, are
cut into bins of a few starts, with the bytes that all strings of a bin share as the key; and a bin with more than
CLASSES classes into single starts, where a key is the string itself and so has one class. What is found goes back to
the classes that the parts are from. No class, segment or document is dropped.

Cases: null and empty texts, and texts shorter than a string, keep all bytes; strings never cross documents; repeated
rows count as further places; rows with a null id are documents like others, as are those with the least and the
greatest; other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import cut, drop_cut, lean, semi, ship, small_ids
from stratum.llm.suffix_order import lengths, ranges, runs, suffix_array

SPAN = 400
CLASSES = 32
#: Starts handled at once in a long document, and symbols of suffix-array texts at once (in about 120 bytes each).
BLOCK, TOGETHER = 1 << 18, 500_000
PLACE_BITS = np.uint64(20)


@dataclass(frozen=True)
class Rule:
    """Lengths in bytes: of the strings, of an anchor's gram, and how many starts a half run and a bin have at most."""

    span: int = SPAN
    gram: int = 24
    bin: int = 16

    def __post_init__(self):
        if self.span < 4 * self.gram:
            raise ValueError(f"strings have {4 * self.gram} bytes at least")

    @property
    def half(self) -> int:
        return (self.span - self.gram + 2) // 2


BASE = 0x9E3779B97F4A7C15


def random_table() -> np.ndarray:
    """A 64-bit value for each byte, by a fixed rule."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") for i in range(256)], np.uint64)


class Hashes:
    """Polynomial hashes of all parts of a string from prefix sums."""

    def __init__(self):
        self.table = random_table()
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, BASE, np.uint64))])
                self.down = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, pow(BASE, -1, 2**64), np.uint64))])

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (prefix[end] - prefix[start]) * self.down[start]
        return mix(h ^ (end - start).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchored(prefix: np.ndarray, n: int, hashes: Hashes, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor) of each run in a block of n >= span bytes."""
    grams = n - rule.gram + 1
    at = np.arange(grams)
    value = mix((prefix[rule.gram :] - prefix[:grams]) * hashes.down[:grams])
    value = value >> PLACE_BITS << PLACE_BITS | at.astype(np.uint64)
    width, need = 1, rule.span - rule.gram + 1
    while 2 * width <= need:
        value = np.minimum(value[:-width], value[width:])
        width *= 2
    starts = n - rule.span + 1
    value = np.minimum(value[:starts], value[need - width : need - width + starts])
    anchor = (value & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
    first = runs(anchor)
    return first, np.append(first[1:], starts) - 1, anchor[first]


def split(first, last, anchor, step: int):
    """Runs cut where the distance from start to anchor passes a multiple of step; with the bin of each part and the run it is from."""
    low, high = (anchor - last) // step, (anchor - first) // step
    count = high - low + 1
    of = np.repeat(np.arange(len(first)), count)
    bin_ = ranges(low, count)
    a = np.maximum(first[of], anchor[of] - bin_ * step - step + 1)
    b = np.minimum(last[of], anchor[of] - bin_ * step)
    return a, b, bin_, of


def cores(prefix: np.ndarray, hashes: Hashes, anchor: np.ndarray, bin_: np.ndarray, step: int, span: int) -> np.ndarray:
    """Hashes of the bytes that all strings of a bin of step starts share."""
    low = anchor - bin_ * step
    return mix(hashes.of(prefix, low, low - step + 1 + span) + bin_.astype(np.uint64) + np.uint64(step))


Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def segments(data: bytes, hashes: Hashes, rule: Rule) -> Iterator[Found]:
    """(key, class, first start, number of starts) of every half run."""
    with np.errstate(over="ignore"):
        for offset in range(0, len(data) - rule.span + 1, BLOCK):
            block = np.frombuffer(data, np.uint8)[offset : offset + BLOCK + rule.span - 1]
            prefix = hashes.prefix(block)
            first, last, anchor = anchored(prefix, len(block), hashes, rule)
            first, last, bin_, of = split(first, last, anchor, rule.half)
            key = cores(prefix, hashes, anchor[of], bin_, rule.half, rule.span)
            yield key.view(np.int64), hashes.of(prefix, first, last + rule.span).view(np.int64), first + offset, last - first + 1


def parts_of(data: bytes, hashes: Hashes, level: int, rule: Rule) -> Found:
    """The same of a segment's bins (level 1), or of a bin's single starts (level 2)."""
    with np.errstate(over="ignore"):
        block = np.frombuffer(data, np.uint8)
        prefix = hashes.prefix(block)
        if level == 1:
            first, last, anchor = anchored(prefix, len(block), hashes, rule)
            first, last, bin_, of = split(first, last, anchor, rule.bin)
            key = cores(prefix, hashes, anchor[of], bin_, rule.bin, rule.span)
        else:
            first = last = np.arange(len(block) - rule.span + 1)
            key = mix(hashes.of(prefix, first, first + rule.span) + np.uint64(1))
        return key.view(np.int64), hashes.of(prefix, first, last + rule.span).view(np.int64), first, last - first + 1


def with_row(df: DataFrame, key: str, text: str, *more) -> DataFrame:
    """(id, hash, data, more): a row is known by its id and its text's hash (of another kind where the id is null), so equal rows share their result."""
    id_, data = F.col(f"`{key}`").cast("long"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    return df.select(F.coalesce(id_, F.lit(0)).cast("long").alias("id"), F.xxhash64(data, id_.isNull()).alias("hash"), data.alias("data"), *more)


SEGMENT = "key long, class long, id long, hash long, first long, n int"


def cut_up(docs: DataFrame, rule: Rule) -> DataFrame:
    """The segments (columns of SEGMENT) of all documents."""

    def run(batches):
        hashes = Hashes()
        for b in batches:
            out: list[list] = [[], [], [], []]
            which, counts = [], []
            for i in range(b.num_rows):
                data = b.column(2)[i].as_py()
                if len(data) >= rule.span:
                    for got in segments(data, hashes, rule):
                        for o, g in zip(out, got, strict=True):
                            o.append(g)
                        which.append(i)
                        counts.append(len(got[0]))
            if which:
                row = pa.array(np.repeat(which, counts))
                key, kind, first, n = (np.concatenate(x) for x in out)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind), b.column(0).take(row), b.column(1).take(row), pa.array(first, pa.int64()), pa.array(n.astype(np.int32), pa.int32())], names=["key", "class", "id", "hash", "first", "n"])

    return docs.mapInArrow(lean(run), SEGMENT)


def cut_again(docs: DataFrame, members: DataFrame, level: int, rule: Rule) -> DataFrame:
    """The parts of members (columns of SEGMENT), with the class they are from and their first start's distance from its first: parent, parent_class, shift."""
    wanted = cut(members.groupBy("id", "hash").agg(F.collect_list(F.struct("key", "class", "first", "n")).alias("want")), "suffix-again")
    some = semi(docs, wanted.select("id", "hash"), ["id", "hash"]).dropDuplicates(["id", "hash"])

    def run(batches):
        hashes = Hashes()
        for b in batches:
            for id_, hash_, data, want in zip(*(b.column(c) for c in ("id", "hash", "data", "want")), strict=True):
                data, rows, counts, out = data.as_py(), want.as_py(), [], [[], [], [], []]
                for w in rows:
                    got = parts_of(data[w["first"] : w["first"] + w["n"] + rule.span - 1], hashes, level, rule)
                    counts.append(len(got[0]))
                    for o, g in zip(out, got, strict=True):
                        o.append(g)
                key, kind, shift, n = (np.concatenate(x) for x in out)
                parent, parent_class, first = (np.repeat(np.array([w[c] for w in rows], np.int64), counts) for c in ("key", "class", "first"))
                total = len(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(kind), pa.array([id_.as_py()] * total, pa.int64()), pa.array([hash_.as_py()] * total, pa.int64()), pa.array(first + shift), pa.array(n.astype(np.int32)), pa.array(parent), pa.array(parent_class), pa.array(shift.astype(np.int64))],
                    names=["key", "class", "id", "hash", "first", "n", "parent", "parent_class", "shift"],
                )

    return some.join(wanted, ["id", "hash"]).select("id", "hash", "data", "want").mapInArrow(lean(run), f"{SEGMENT}, parent long, parent_class long, shift long")


def shared(rows: DataFrame) -> DataFrame:
    """The segments whose key another segment has too."""
    rows = cut(rows, "suffix-segments")
    # counted apart from the join, so that Spark can split a hot key's rows in it
    keys = cut(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "suffix-keys")
    out = cut(rows.join(keys, "key", "left_semi"), "suffix-shared")
    drop_cut(rows)
    drop_cut(keys)
    return out


def dealt(docs: DataFrame, rule: Rule) -> tuple[list[DataFrame], DataFrame]:
    """The segments of each level that share their key, and (key, class, m, one, two, solo) of the classes that aren't dealt anew: two members, and whether the key has no other class."""
    levels, classes, own = [], [], shared(cut_up(docs, rule))
    for level in range(3):
        kinds = cut(own.groupBy("key", "class").agg(F.count("*").alias("m"), F.min(F.struct("id", "hash", "first", "n")).alias("one"), F.max(F.struct("id", "hash", "first", "n")).alias("two")), "suffix-classes")
        counts = cut(kinds.groupBy("key").agg(F.count("*").alias("c")), "suffix-counts")
        kinds = kinds.join(counts, "key")
        levels.append(own)
        crowded = kinds.where(F.col("c") > CLASSES)
        if level == 2 or crowded.isEmpty():
            classes.append(kinds)
            break
        classes.append(kinds.where(F.col("c") <= CLASSES))
        members = crowded.select("key", "class", "one.*").unionByName(crowded.where("m > 1").select("key", "class", "two.*"))
        own = shared(cut_again(docs, members, level + 1, rule))
    all_ = reduce(DataFrame.unionByName, classes)
    return levels, cut(all_.select("key", "class", "m", "one", "two", (F.col("c") == 1).alias("solo")), "suffix-dealt")


#: A segment's place in a text: its class and where its starts lie.
PARTS = "array<struct<key: long, class: long, at: long, n: int>>"
MOST_CHAINED = 128


def chains(solo: DataFrame, span: int) -> DataFrame:
    """Texts of keys with one class: (text, parts, id, hash, first, bytes). Runs that follow one another in both documents become one text of two strings."""
    pairs = solo.groupBy("one.id", "one.hash", F.col("two.id").alias("id2"), F.col("two.hash").alias("hash2")).agg(F.array_sort(F.collect_list(F.struct(F.col("one.first").alias("first"), F.col("two.first").alias("first2"), F.col("one.n").alias("n"), "key", "class"))).alias("runs"))

    def run(batches):
        for b in batches:
            out = []
            for id_, hash_, id2, hash2, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = 0
                while at < len(found):
                    end = at + 1
                    while end < len(found) and end - at < MOST_CHAINED and all(found[end][k] == found[end - 1][k] + found[end - 1]["n"] for k in ("first", "first2")):
                        end += 1
                    head, tail = found[at], found[end - 1]
                    size = tail["first"] + tail["n"] - head["first"] + span - 1
                    parts = [{"key": r["key"], "class": r["class"], "at": r["first"] - head["first"], "n": r["n"]} for r in found[at:end]]
                    out += [(head["key"], parts, id_, hash_, head["first"], size), (head["key"], [], id2, hash2, head["first2"], size)]
                    at = end
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.list_(pa.struct([("key", pa.int64()), ("class", pa.int64()), ("at", pa.int64()), ("n", pa.int32())])), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["text", "parts", "id", "hash", "first", "bytes"])

    return pairs.mapInArrow(lean(run), f"text long, parts {PARTS}, id long, hash long, first long, bytes long")


def agree(raw: np.ndarray, a: np.ndarray, b: np.ndarray, span: int) -> np.ndarray:
    """Whether raw[a[i]:a[i] + span] and raw[b[i]:b[i] + span] are the same bytes. Pairs at one distance whose strings overlap are compared in one go."""
    if not len(a):
        return np.empty(0, bool)
    low, gap = np.minimum(a, b), np.abs(a - b)
    order = np.lexsort((low, gap))
    low, gap = low[order], gap[order]
    apart = np.concatenate([[True], (gap[1:] != gap[:-1]) | (low[1:] - low[:-1] > span)])
    first = apart.nonzero()[0]
    start = low[first]
    size = low[np.append(first[1:], len(low)) - 1] + span - start
    at = ranges(start, size)
    wrong = np.concatenate([[0], np.cumsum(raw[at] != raw[at + gap[first].repeat(size)])])
    place = low - start.repeat(lengths(first, len(low))) + (np.cumsum(size) - size).repeat(lengths(first, len(low)))
    out = np.empty(len(a), bool)
    out[order] = wrong[place + span] == wrong[place]
    return out


def repeated(texts: list[list[tuple[list[dict], bytes]]], hashes: Hashes, span: int) -> list[tuple[int, int, list[dict]]]:
    """For texts of (parts, bytes): (key, class, spans of its segment that repeated strings cover) of every part that has any."""
    entries = [e for t in texts for e in t]
    sizes = np.array([len(data) for _, data in entries])
    starts = np.cumsum(sizes + 1) - sizes - 1
    bounds = np.concatenate([[0], np.cumsum([sum(len(data) + 1 for _, data in t) for t in texts])])
    raw = np.frombuffer(b"".join(x for _, data in entries for x in (data, b"\0")), np.uint8)
    symbols = raw.astype(np.uint16) + 2
    symbols[starts + sizes] = 1
    symbols[bounds[1:] - 1] = 0
    order = suffix_array(symbols, bounds)
    full = np.zeros(len(raw), bool)
    full[ranges(starts, sizes - span + 1)] = True
    order = order[full[order]]
    text = np.searchsorted(bounds, order, side="right")
    with np.errstate(over="ignore"):
        value = hashes.of(hashes.prefix(raw), order, order + span)
    same = np.flatnonzero((value[1:] == value[:-1]) & (text[1:] == text[:-1]))
    same = same[agree(raw, order[same], order[same + 1], span)]
    hit = np.zeros(len(raw) + 1, np.int8)
    hit[order[same + 1]] = hit[order[same]] = 1
    out = []
    for (parts, _), start in zip(entries, starts.tolist(), strict=True):
        for p in parts:
            at = start + p["at"]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[at : at + p["n"]], [0]])))
            if len(edge):
                out.append((p["key"], p["class"], [{"a": a, "b": b + span - 1} for a, b in edge.reshape(-1, 2).tolist()]))
    return out


def repeats(docs: DataFrame, classes: DataFrame, span: int) -> DataFrame:
    """(key, class, spans array<struct<a, b>>): byte spans of a class, from its segment's start, that repeated strings cover."""
    many = classes.where("NOT solo")
    part = F.array(F.struct("key", "class", F.lit(0).cast("long").alias("at"), F.col("one.n").alias("n"))).cast(PARTS)
    size = lambda member: (F.col(f"{member}.n") + span - 1).cast("long").alias("bytes")
    one = many.select(F.col("key").alias("text"), part.alias("parts"), "one.id", "one.hash", "one.first", size("one"))
    two = many.where("m > 1").select(F.col("key").alias("text"), F.array().cast(PARTS).alias("parts"), "two.id", "two.hash", "two.first", size("two"))
    wanted = one.unionByName(two).unionByName(chains(classes.where("solo"), span))
    wanted = cut(wanted.groupBy("id", "hash").agg(F.collect_list(F.struct("text", "parts", "first", "bytes")).alias("want")), "suffix-wanted")

    def fetch(batches):
        for b in batches:
            wants = b.column("want")
            for data, want in zip(b.column("data"), wants, strict=True):
                data, rows = data.as_py(), want.values
                spots = zip(rows.field("first").to_pylist(), rows.field("bytes").to_pylist(), strict=True)
                yield pa.RecordBatch.from_arrays([rows.field("text"), rows.field("parts"), pa.array([data[a : a + n] for a, n in spots], pa.binary())], names=["text", "parts", "data"])

    def find(batches):
        hashes, at, text = Hashes(), None, []
        waiting, sizes = defaultdict(list), defaultdict(int)

        def found(texts):
            cols = list(zip(*repeated(texts, hashes, span), strict=True)) or [[]] * 3
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "class", "spans"])

        def done():
            """Texts of like size wait for each other, as they take about as many steps."""
            size = sum(len(data) for _, data in text)
            like = round(2 * math.log2(size))
            waiting[like].append(text)
            sizes[like] += size
            if sizes[like] < TOGETHER:
                return None
            sizes[like] = 0
            return waiting.pop(like)

        for batch in batches:
            for name, parts, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                name = name.as_py()
                if name != at:
                    if text and (texts := done()):
                        yield found(texts)
                    at, text = name, []
                text.append((parts.as_py(), data.as_py()))
        if text and (texts := done()):
            yield found(texts)
        rest = [t for like in sorted(waiting) for t in waiting[like]]
        while rest:
            size = end = 0
            while end < len(rest) and size < TOGETHER:
                size, end = size + sum(len(data) for _, data in rest[end]), end + 1
            yield found(rest[:end])
            rest = rest[end:]

    some = semi(docs, wanted.select("id", "hash"), ["id", "hash"])
    bytes_ = some.join(wanted, ["id", "hash"]).select("data", "want").mapInArrow(lean(fetch), f"text long, parts {PARTS}, data binary")
    return bytes_.repartition("text").sortWithinPartitions("text").mapInArrow(lean(find), "key long, class long, spans array<struct<a: long, b: long>>")


def spans(docs: DataFrame, rule: Rule) -> DataFrame:
    """(id, hash, spans array<struct<a, b>>): disjoint ascending byte spans that repeated strings cover, for the rows that have any."""
    ship(docs.sparkSession)
    levels, classes = dealt(docs, rule)
    found = cut(repeats(docs, classes, rule.span).groupBy("key", "class").agg(F.first("spans").alias("spans")), "suffix-repeats")
    moved = lambda by: F.transform("spans", lambda s: F.struct((s["a"] + F.col(by)).alias("a"), (s["b"] + F.col(by)).alias("b"))).alias("s")
    gathered = F.flatten(F.collect_set("s")).alias("s")
    for rows in levels[:0:-1]:  # what parts repeat goes to the classes they are from
        up = rows.join(found, ["key", "class"]).select("parent", "parent_class", moved("shift"))
        up = up.groupBy(F.col("parent").alias("key"), F.col("parent_class").alias("class")).agg(gathered)
        found = found.unionByName(cut(up.select("key", "class", united("s").alias("spans")), "suffix-up"))
    placed = levels[0].join(found, ["key", "class"]).select("id", "hash", moved("first"))
    return cut(placed.groupBy("id", "hash").agg(gathered).select("id", "hash", united("s").alias("spans")), "suffix-spans")


def union(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ascending spans that cover the same bytes; touching spans become one."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def united(column: str):
    @F.udf("array<struct<a: long, b: long>>", useArrow=True)
    def one(s):
        return union([(x["a"], x["b"]) for x in s])

    return one(column)


def attached(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (with id and hash) with the column spans, null where nothing is removed. Texts that keep all bytes aren't shuffled while the others' ids are few enough to be broadcast."""
    ids = found.select("id", "hash")
    if not small_ids(ids):
        return docs.join(found, ["id", "hash"], "left")
    ids = F.broadcast(ids)
    return docs.join(ids, ["id", "hash"], "left_semi").join(found, ["id", "hash"]).unionByName(docs.join(ids, ["id", "hash"], "left_anti").withColumn("spans", F.lit(None).cast("array<struct<a: long, b: long>>")))


def kept_bytes(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in removed:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def whole_characters(data: bytes, removed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk so that no UTF-8 character is cut."""
    inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
    out = []
    for a, b in removed:
        while inside(a):
            a += 1
        while inside(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def report(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) of each row of df; text: what is left, with characters cut by a span's edge."""
    docs = with_row(df, key, text, F.col(f"`{key}`").cast("long").alias("doc_id"))
    rows = attached(docs, spans(docs.select("id", "hash", "data"), Rule(span))).select("doc_id", "data", "spans")

    def run(batches):
        for b in batches:
            out = []
            for data, s in zip(b.column("data"), b.column("spans"), strict=True):
                data, removed = data.as_py(), [(x["a"], x["b"]) for x in s.as_py() or ()]
                text_ = kept_bytes(data, whole_characters(data, removed)) if removed else data
                out.append((len(data), sum(y - x for x, y in removed), len(removed), hashlib.sha256(kept_bytes(data, removed)).hexdigest(), text_))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            cols = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols[:4], cols[4].cast(pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return rows.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def passages(data: bytes, found: list[tuple[int, int]], words: int, size: int) -> list[tuple[int, int]]:
    """The spans that hold over words words, or size bytes."""
    return [(a, b) for a, b in found if b - a >= size or len(data[a:b].split()) > words]


def remove(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, words: int = 0, size: int = 0) -> DataFrame:
    """df without the repeated strings of span bytes in its text; characters cut by a span's edge stay. words, size: only runs of over words words, or of size bytes, go. Other columns stay as they are, whatever their names; null texts stay null."""
    rows = with_row(df, key, text, F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    found = attached(rows.select("id", "hash", "row"), spans(rows.select("id", "hash", "data"), Rule(span)))

    @F.udf("string", useArrow=True)
    def cleaned(t, s):
        if s is None or t is None:
            return t
        raw = t.encode()
        return kept_bytes(raw, whole_characters(raw, passages(raw, [(x["a"], x["b"]) for x in s], words, size))).decode()

    # texts that stay aren't sent to Python
    own = F.col(f"row.`{text}`").cast("string")
    now = F.when(F.col("spans").isNull(), own).otherwise(cleaned(F.when(F.col("spans").isNotNull(), own), "spans"))
    return found.withColumn("text", now).select(*(F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in df.columns))
