"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage becomes shares of its bytes by kind and a few
word statistics, then a hidden vector; gated attention, learned from document labels alone, weights the hidden
vectors, and the weighted sum is scored. Training takes at most TRAIN_DOCS labelled documents (a documented
bound: those whose ids hash lowest), of each TRAIN_PASSAGES passages at most (evenly spaced over the whole text;
576 bytes each, so 147 MB in all), and runs on the driver; scoring covers every passage of every whole text.

Cases: a null or empty text is one empty passage; without labels of both kinds every score is the mean label,
or 0.5 without any; labels of a repeated doc_id are averaged; a null doc_id is never labelled nor held out;
labels, lang, source and doc_id are no inputs; repeated rows are scored alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import give_back, lean, ship
from stratum.llm.suffix_order import runs

PASSAGE, HIDDEN, ATTENTION = 64, 32, 16
TRAIN_DOCS, TRAIN_PASSAGES, EPOCHS, RATE, DECAY, SEED = 4000, 64, 12, 0.01, 1e-4, 7
THRESHOLD = 0.3
TOGETHER = 1 << 19
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Kinds of bytes: each ASCII byte its own, letters' cases apart, others by their top bits.
BYTE_KIND = np.where(np.arange(256) < 128, np.arange(256), 128 + (np.arange(256) >> 4 & 7))
N_KINDS = 136
N_FEATURES = N_KINDS + 8


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of texts, and the index of each text's first passage (each has one at least)."""
    joined = b" ".join([*texts, b""])
    raw = np.frombuffer(joined, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], SPACES[raw], [True]])))
    start, end = edge[0::2], edge[1::2]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text_at = np.concatenate([[0], np.cumsum(lengths)])
    words = np.diff(np.searchsorted(start, text_at))
    bags = np.maximum(1, -(-words // PASSAGE))
    first = np.cumsum(bags) - bags
    n = int(bags.sum())
    word_text = np.repeat(np.arange(len(texts)), words)
    word_no = np.arange(len(start)) - np.repeat(np.cumsum(words) - words, words)
    passage = first[word_text] + word_no // PASSAGE
    out = np.zeros((n, N_FEATURES), np.float32)
    # bytes belong to the passage of the last word begun before them
    begin = np.zeros(len(raw) + 1, np.int64)
    begin[text_at[:-1]] = first
    begin[start] = passage
    byte_passage = np.maximum.accumulate(begin[:-1])
    counts = np.bincount(byte_passage * N_KINDS + BYTE_KIND[raw], minlength=n * N_KINDS).reshape(n, N_KINDS)
    size = np.maximum(1, counts.sum(1))
    out[:, :N_KINDS] = np.sqrt(counts / size[:, None])
    if len(start):
        with np.errstate(over="ignore"):
            up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(raw), 0x9E3779B97F4A7C15, np.uint64)]))
            down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(raw), pow(0x9E3779B97F4A7C15, -1, 2**64), np.uint64)]))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1])])
            word = (sums[end] - sums[start]) * down[start]
        # 40 bits of each word's hash tell the few words of a passage apart
        both = np.sort(passage.astype(np.uint64) << np.uint64(40) | word * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(24))
        begins = runs(both)
        p = (both[begins] >> np.uint64(40)).astype(np.int64)
        n_words = np.bincount(passage, minlength=n)
        some = np.maximum(1, n_words)
        distinct = np.bincount(p, minlength=n)
        most = np.zeros(n)
        own = runs(p)
        most[p[own]] = np.maximum.reduceat(np.diff(np.append(begins, len(both))), own)
        again = np.concatenate([[False], (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])])
        width = end - start
        mean = np.bincount(passage, width, minlength=n) / some
        spread = np.sqrt(np.maximum(0, np.bincount(passage, width.astype(float) ** 2, minlength=n) / some - mean**2))
        out[:, N_KINDS:] = np.stack([distinct / some, most / some, np.bincount(passage, again, minlength=n) / some, mean / 10, spread / 10, np.bincount(passage, width > 20, minlength=n) / some, np.bincount(passage, width <= 1, minlength=n) / some, np.log1p(n_words) / 5], 1)
    return out, first


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(m: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> tuple:
    """Scores of bags (rows first[i]:first[i + 1] of x), and what the gradients need."""
    z = (x - m["mean"]) / m["spread"]
    h = np.tanh(z @ m["w"] + m["b"])
    t, g = np.tanh(h @ m["v"]), sigmoid(h @ m["u"])
    e = (t * g) @ m["a"]
    bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    e = np.exp(e - np.maximum.reduceat(e, first)[bag])
    weight = e / np.add.reduceat(e, first)[bag]
    bags = np.add.reduceat(weight[:, None] * h, first)
    return sigmoid(bags @ m["c"] + m["d"]), z, h, t, g, bag, weight, bags


def gradients(m: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss."""
    score, z, h, t, g, bag, weight, bags = forward(m, x, first)
    ds = (score - y) / len(y)
    dbags = ds[:, None] * m["c"]
    dh = weight[:, None] * dbags[bag]
    dweight = (h * dbags[bag]).sum(1)
    de = weight * (dweight - np.add.reduceat(weight * dweight, first)[bag])
    dt, dg = de[:, None] * m["a"] * g * (1 - t**2), de[:, None] * m["a"] * t * g * (1 - g)
    dh = dh + dt @ m["v"].T + dg @ m["u"].T
    dz = dh * (1 - h**2)
    return {"w": z.T @ dz, "b": dz.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": bags.T @ ds, "d": ds.sum()}


def trained(x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters by Adam over shuffled batches of bags; the same data give the same parameters."""
    rng = np.random.default_rng(SEED)
    m = {"mean": x.mean(0), "spread": x.std(0) + 0.02, "w": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "a": np.zeros(ATTENTION), "c": rng.normal(0, 0.1, HIDDEN), "d": np.array(np.log(y.mean() / (1 - y.mean())))}
    ends = np.append(first[1:], len(x))
    moments = {k: [np.zeros_like(m[k]), np.zeros_like(m[k])] for k in ("w", "b", "v", "u", "a", "c", "d")}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 128):
            chosen = order[at : at + 128]
            sizes = ends[chosen] - first[chosen]
            rows = np.concatenate([np.arange(first[i], ends[i]) for i in chosen])
            step += 1
            for k, g in gradients(m, x[rows], np.cumsum(sizes) - sizes, y[chosen]).items():
                g = g + DECAY * m[k] * (k not in "bd")
                one, two = moments[k]
                one += 0.1 * (g - one)
                two += 0.001 * (g * g - two)
                m[k] = m[k] - RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    return {k: np.asarray(v, np.float32) for k, v in m.items()}


def scores(model: dict[str, np.ndarray] | float, texts: list[bytes]) -> np.ndarray:
    out, at = np.empty(len(texts)), 0
    if isinstance(model, float):
        out[:] = model
        return out
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) < TOGETHER):
            size, end = size + len(texts[end]) + 1, end + 1
        out[at:end] = forward(model, *passages(texts[at:end]))[0]
        at = end
    return out


def held_out(key: str):
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> dict[str, np.ndarray] | float:
    """The model of docs' labels outside the held-out fold; a number where labels of both kinds are lacking."""
    ship(docs.sparkSession)
    known = labels.where(~held_out(key) & F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{key}`").cast("long").alias("id")).agg((F.avg(f"`{label}`") >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS)
    own = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("data"))

    @F.arrow_udf("binary")
    def features(data: pa.Array) -> pa.Array:
        return pa.array([sampled(passages([d])[0], TRAIN_PASSAGES).tobytes() for d in data.to_pylist()], pa.binary())

    # of an id's several texts the one whose hash is least is the labelled one
    own = own.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("y").alias("y"), F.min_by("data", F.xxhash64("data")).alias("data"))
    rows = own.select("id", "y", features("data").alias("x")).toPandas().sort_values(["id"], kind="stable")
    if rows["y"].nunique() < 2:
        return float(rows["y"].mean()) if len(rows) else 0.5
    bags = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for x in rows["x"]]
    sizes, y = np.array([len(b) for b in bags]), rows["y"].to_numpy(float)
    x = np.concatenate(bags)
    del rows, bags
    model = trained(x, np.cumsum(sizes) - sizes, y)
    del x
    give_back()  # the driver goes on with the stages behind
    return model


def sampled(x: np.ndarray, most: int) -> np.ndarray:
    """At most so many rows of x, evenly spaced from first to last."""
    return x if len(x) <= most else x[np.linspace(0, len(x) - 1, most).round().astype(np.int64)]


def score_column(model, text: str):
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lean(lambda some: (pa.array(scores(model, b.to_pylist()), pa.float64()) for b in some))(batches)

    return score(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs."""
    model = fit(docs, labels, key, text)
    out = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(held_out(key), F.lit(False)).alias("held_out"), score_column(model, text).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are predicted 1, with their own columns."""
    return docs.where(score_column(fit(docs, labels, key, text), text) >= THRESHOLD)
