"""Spelling variant grouping by a symmetric-delete join: every word emits the hashes of itself and of its distinct single
deletions, words that share one are joined, and an exact distance of one is verified on the words.

A word's form is its near word of largest count (of equals the smallest in code-point order) if that count is at least
`ratio` times its own; a root is where following forms ends. Forms grow by `ratio` with each step, so there is no circle, and
roots are joined in rounds that double the steps taken.

Cases: a null or empty text has no words, an empty table gives an empty result; repeated rows count each time; a null doc_id
counts as an empty one where an id enters (noise); runs of any length are words: a word emits a row of two longs for each of
its code points, and a task that emits holds some 60 bytes for each code point of one word; other columns, of whatever
name, are ignored. How many words share a deletion is bounded by the alphabet and the word's length, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import cut, drop_cut, lean, ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"
#: Code points of words that are hashed at once.
AT_ONCE = 1 << 18
#: Base of the polynomial (modulo 2^64) that hashes a word, and a multiplier that spreads code points.
BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def lowered(word: Column) -> Column:
    """A-Z become a-z; nothing else changes."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def noised(word: Column, key: Column, noise: int) -> Column:
    """The word without the code point crc32 % length, where noise divides the crc32 of "<key>:<word>"."""
    h = F.crc32(F.encode(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), word), "utf-8"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % noise == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def counts(df: DataFrame, least_length: int = 7, least_count: int = 2, noise: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of at least least_length code points and least_count occurrences. With noise, of some occurrences a code point goes first, as told by the row's key."""
    # a run that is too short stays too short, as a deletion only shortens it
    runs = F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(f"[{LETTERS}]{{{least_length},}}+"), F.lit(0))
    one = df.select(F.col(f"`{key}`").alias("_key"), F.explode(runs).alias("_run")).select("_key", lowered(F.col("_run")).alias("word"))
    if noise:
        one = one.select(noised(F.col("word"), F.col("_key"), noise).alias("word")).where(F.length("word") >= least_length)
    return one.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def keys_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length (rows of code points): hashes of the words, and of each word without one code point."""
    n = codes.shape[1]
    power = np.ones(n + 1, np.uint64)
    power[1:] = BASE
    power = np.multiply.accumulate(power)
    c = (codes.astype(np.uint64) + np.uint64(1)) * SPREAD
    whole = c * power[n - 1 :: -1][:n]  # as they stand in the word
    after = whole.sum(1, keepdims=True) - np.cumsum(whole, 1)  # of those behind each place
    before = np.zeros_like(c)
    if n > 1:  # those before it move down by one
        before[:, 1:] = np.cumsum(c[:, :-1] * power[n - 2 :: -1][: n - 1], 1)
    return whole.sum(1), before + after


def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, word) to (key, id): the word itself and its distinct single deletions."""

    def rows(keys, ids):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids)], names=["key", "id"])

    for b in batches:
        ids, words = b.column(0).to_numpy(), b.column(1).to_pylist()
        lengths = np.array([len(w) for w in words], np.int64)
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            step = max(1, AT_ONCE // int(n))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                codes = np.frombuffer("".join([words[i] for i in some]).encode("utf-32-le"), np.uint32).reshape(len(some), n)
                whole, less = keys_of(codes)
                yield rows(whole, ids[some])
                less.sort(axis=1)
                new = np.ones(less.shape, bool)
                new[:, 1:] = less[:, 1:] != less[:, :-1]
                yield rows(less[new], np.repeat(ids[some], new.sum(1)))


def near(words: DataFrame) -> DataFrame:
    """Ordered pairs (a, b) of ids of words at a distance of exactly one, each way round, with (word, n) of b as (near, near_n). words: (id, word, n), a written table of distinct words."""
    ship(words.sparkSession)
    keys = cut(words.select("id", "word").mapInArrow(lean(emit), "key long, id long"), "spelling-keys")
    pairs = keys.select("key", F.col("id").alias("a")).join(keys.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b").distinct()
    one = words.select(F.col("id").alias("a"), F.col("word").alias("wa"), F.col("n").alias("na"))
    two = words.select(F.col("id").alias("b"), F.col("word").alias("wb"), F.col("n").alias("nb"))
    sure = cut(pairs.join(one, "a").join(two, "b").where(F.levenshtein("wa", "wb", 1) == 1), "spelling-pairs")
    drop_cut(keys)
    return sure.select("a", "b", F.col("wb").alias("near"), F.col("nb").alias("near_n")).unionAll(sure.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("wa").alias("near"), F.col("na").alias("near_n")))


def followed(forms: DataFrame) -> DataFrame:
    """(id, root, root_word) of every id in forms (id, form id, form): a round joins each root with that root's own."""
    now = cut(forms.select("id", F.col("form_id").alias("root"), F.col("form").alias("root_word")), "spelling-roots")
    while True:
        then = now.select(F.col("id").alias("root"), F.col("root").alias("further"), F.col("root_word").alias("further_word"))
        later = cut(
            now.join(then, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.coalesce("further_word", "root_word").alias("root_word"), F.col("further").isNotNull().alias("_moved")),
            "spelling-roots",
        )
        drop_cut(now)
        now = later
        if not now.agg(F.max("_moved")).first()[0]:
            return now.drop("_moved")


def variants(df: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10, noise: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root string, n, n_near, form_n long): one row a word."""
    words = cut(counts(df, least_length, least_count, noise, key, text).select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"), F.col("b").alias("form_id")))
    by_word = near(words).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), best.alias("best"))
    known = cut(words.join(by_word, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best")), "spelling-near")
    roots = followed(known.where("best is not null").select("id", F.col("best.form_id").alias("form_id"), F.col("best.form").alias("form")))
    return known.join(roots, "id", "left").select(
        "word", F.col("best.form").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), (-F.col("best.less")).alias("form_n")
    )
