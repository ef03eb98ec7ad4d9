import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import quality

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_gradients():
    rng = np.random.default_rng(0)
    x, first, y = rng.normal(size=(12, 5)), np.array([0, 1, 5, 9]), np.array([1.0, 0, 1, 0])
    m = {"mean": np.zeros(5), "spread": np.ones(5), "w": rng.normal(size=(5, 3)), "b": rng.normal(size=3), "v": rng.normal(size=(3, 2)), "u": rng.normal(size=(3, 2)), "a": rng.normal(size=2), "c": rng.normal(size=3), "d": np.array(0.1)}

    def loss():
        p = quality.forward(m, x, first)[0]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = quality.gradients(m, x, first, y)
    for k in g:
        flat, out = m[k].reshape(-1), np.asarray(g[k]).reshape(-1)
        for i in range(flat.size):
            kept = flat[i]
            flat[i] = kept + 1e-6
            up = loss()
            flat[i] = kept - 1e-6
            down = loss()
            flat[i] = kept
            assert (up - down) / 2e-6 == pytest.approx(out[i], abs=1e-5), k


def test_passages_do_not_depend_on_their_batch():
    texts = [b"", b" ", b"one two", b"word " * 200, "é".encode() * 50, b"###" * 300, b"a b " * 500]
    x, first = quality.passages(texts)
    for i, t in enumerate(texts):
        own, _ = quality.passages([t])
        end = first[i + 1] if i + 1 < len(first) else len(x)
        assert len(own) == end - first[i] == max(1, -(-len(t.split()) // quality.PASSAGE))
        assert np.allclose(own, x[first[i] : end], atol=0.05)


def test_small_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, "x", 1), (2, None, 0), (3, "", 1), (None, "y", 0)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(docs, none).collect()
    assert len(got) == 4 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)
    one = spark.createDataFrame([(i, 0) for i in (1, 2, 3)], "doc_id long, quality int")
    assert all(r["score"] == 0.0 and r["predicted"] == 0 for r in quality.classify(docs, one).collect())
    assert quality.classify(docs.limit(0), one).count() == 0 and quality.keep(docs, none).count() == 4


def test_repeated_and_long_rows(spark):
    good, bad = ("the cat sat on the mat and looked around " * 3000, "###!!!$$$ " * 40)
    rows = [(i, good[: 900 + i] if i % 2 else bad + str(i)) for i in range(60)] + [(1, bad), (1, bad), (100, good), (100, good)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, y double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2, "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 64 and got == quality.classify(docs, labels).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert by[100][0] == by[100][1] > 0.5 > max(by[2]) and quality.keep(docs, labels).columns == docs.columns


def test_training_rows_are_bounded():
    x = np.arange(1000)[:, None]
    assert quality.sampled(x, 1000) is x and quality.sampled(x, 64)[[0, -1]].ravel().tolist() == [0, 999] and len(np.unique(quality.sampled(x, 64))) == 64


@tables
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(docs, labels)
    rows = out.join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    right = np.mean([r["predicted"] == r["quality"] for r in rows])
    kept = np.mean([r["predicted"] for r in rows if r["quality"] == 1])
    assert len(rows) > 40 and right >= 0.95 and kept >= 0.97
    assert out.count() == docs.count() and 0 <= out.agg(F.min("score")).first()[0] and out.agg(F.max("score")).first()[0] <= 1


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Repeated rows, nulls and empty texts, a column of a name that the operators use, and an empty table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = str(tmp_path / "sf")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    passage = " ".join(f"{random.choice('abcdef') * 3}{random.randrange(9)}" for _ in range(55))
    rows = [(1, f"one {passage} end"), (1, f"one {passage} end"), (2, f"{passage} quite other words follow it here and then some more of them in a long line until it ends " + "z " * 40), (3, None), (3, None), (4, ""), (None, "no id"), (None, "no id"), (5, "word " * 9000)]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 7, "x", 1) for r in rows], "doc_id long, text string, n_chars int, hash int, spans string, _stratum_id int")
    for table, n in ((docs, [9, 7, 7, 7]), (docs.limit(0), [0] * 4)):
        now, counts = table, []
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, sf)
            path = str(tmp_path / f"{n[0]} {name}")
            now.write.parquet(path)
            now = spark.read.parquet(path)
            if k < 4:
                assert now.columns == docs.columns
                counts.append(now.count())
            if name == "suffix" and n[0]:
                assert not any(passage in (r["text"] or "") for r in now.collect()) and now.where("hash = 7 AND spans = 'x' AND _stratum_id = 1").count() == 7
        assert counts == n and (now.count() > 0) == (n[0] > 0)


@tables
def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400")
    shared = " ".join(f"{random.randrange(10**6)}" for _ in range(80))
    odd = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "", "en", "s", 0), (10_003, f"The first text has it. {shared}", "en", "s", 0), (10_004, f"Another text, other words, same passage: {shared}", "en", "s", 0), (10_005, 'token = "abcdefgh12345678" in the text of this document', "en", "s", 0)], docs.schema)
    now = docs.unionByName(odd)
    columns = now.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        path = str(tmp_path / name)
        now.write.parquet(path)
        now = spark.read.parquet(path)
        counts.append(now.count())
        if name != "packing":
            assert now.columns == columns
        if name == "suffix":
            texts = {r["doc_id"]: r["text"] for r in now.where("doc_id > 10000").collect()}
        if name == "secrets":
            clean = {r["doc_id"]: r["text"] for r in now.where("doc_id > 10000").collect()}
    assert counts[0] >= counts[1] == counts[2] == counts[3] > 200
    assert now.select("doc_id").distinct().count() == counts[3]
    if 10_003 in texts and 10_004 in texts:
        assert shared[200:300] not in texts[10_003] + texts[10_004]
    if 10_005 in clean:
        assert "abcdefgh12345678" not in clean[10_005]


def plain_passages(text):
    """Features of each passage of one text, word by word and byte by byte."""
    words = text.split()
    n = max(1, -(-len(words) // quality.PASSAGE))
    out = np.zeros((n, quality.N_FEATURES))
    counts = [[0] * quality.N_KINDS for _ in range(n)]
    begun, inside = 0, False
    for byte in text + b" ":
        space = byte in b" \t\n\x0b\x0c\r"
        begun += not space and not inside
        inside = not space
        counts[max(0, begun - 1) // quality.PASSAGE][byte if byte < 128 else 128 + (byte >> 4 & 7)] += 1
    for k in range(n):
        own = words[k * quality.PASSAGE : (k + 1) * quality.PASSAGE]
        out[k, : quality.N_KINDS] = [(c / max(1, sum(counts[k]))) ** 0.5 for c in counts[k]]
        some, widths = max(1, len(own)), [len(w) for w in own]
        mean = sum(widths) / some
        again = sum(a == b for a, b in zip(own, own[1:]))
        spread = max(0, sum(w * w for w in widths) / some - mean**2) ** 0.5
        out[k, quality.N_KINDS :] = [len(set(own)) / some, max([own.count(w) for w in own], default=0) / some, again / some, mean / 10, spread / 10, sum(w > 20 for w in widths) / some, sum(w <= 1 for w in widths) / some, np.log1p(len(own)) / 5]
    return out


def plain_bag(m, x):
    """Score of one bag and the gradient of its log loss by the score's logit, passage by passage."""
    squash = lambda v: 1 / (1 + np.exp(-v))
    rows = [(row - m["mean"]) / m["spread"] for row in x]
    hidden = [np.tanh(z @ m["w"] + m["b"]) for z in rows]
    gates = [(np.tanh(h @ m["v"]), squash(h @ m["u"])) for h in hidden]
    e = [float((t * g) @ m["a"]) for t, g in gates]
    total = sum(np.exp(v - max(e)) for v in e)
    weight = [np.exp(v - max(e)) / total for v in e]
    bag = sum(w * h for w, h in zip(weight, hidden))
    grad = {k: np.zeros_like(m[k]) for k in "wbvuac"}
    grad["c"] = bag.copy()
    for z, h, (t, g), w in zip(rows, hidden, gates, weight):
        de = w * float((h - bag) @ m["c"])
        dt, dg = de * m["a"] * g * (1 - t**2), de * m["a"] * t * g * (1 - g)
        dz = (w * m["c"] + m["v"] @ dt + m["u"] @ dg) * (1 - h**2)
        for k, part in (("w", np.outer(z, dz)), ("b", dz), ("v", np.outer(h, dt)), ("u", np.outer(h, dg)), ("a", de * t * g)):
            grad[k] = grad[k] + part
    grad["d"] = 1.0
    return float(squash(bag @ m["c"] + m["d"])), grad


TEXTS = [b"", b" \n ", b"one two two three", b"Word word " * 70, "é ü 日本 a".encode() * 40, b"### $$$ " * 100, b"aaaaaaaaaaaaaaaaaaaaaaaaaa b " * 90]


def test_passages_equal_a_plain_version():
    for t in TEXTS:
        x, first = quality.passages([t])
        assert first.tolist() == [0] and np.allclose(x, plain_passages(t), atol=1e-5), t


def test_training_and_scores_equal_a_plain_version(monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 3)
    rng = random.Random(3)
    bags = [plain_passages(b" ".join(rng.choice(TEXTS).split()[: rng.randrange(200)]) or b"x") for _ in range(150)]
    y = np.array([float(i % 3 > 0) for i in range(150)])
    sizes = np.array([len(b) for b in bags])
    x, first = np.concatenate(bags), np.cumsum(sizes) - sizes
    got = quality.trained(x, first, y)
    start = np.random.default_rng(quality.SEED)
    m = {"mean": x.mean(0), "spread": x.std(0) + 0.02, "w": start.normal(0, x.shape[1] ** -0.5, (x.shape[1], quality.HIDDEN)), "b": np.zeros(quality.HIDDEN), "v": start.normal(0, quality.HIDDEN**-0.5, (quality.HIDDEN, quality.ATTENTION)), "u": start.normal(0, quality.HIDDEN**-0.5, (quality.HIDDEN, quality.ATTENTION)), "a": np.zeros(quality.ATTENTION), "c": start.normal(0, 0.1, quality.HIDDEN), "d": np.log(y.mean() / (1 - y.mean()))}
    one, two, step = {k: 0.0 for k in "wbvuacd"}, {k: 0.0 for k in "wbvuacd"}, 0
    for _ in range(3):
        order = start.permutation(len(y))
        for at in range(0, len(order), 128):
            chosen, step = order[at : at + 128], step + 1
            total = {k: 0.0 for k in one}
            for i in chosen:
                score, grad = plain_bag(m, bags[i])
                for k in total:
                    total[k] = total[k] + (score - y[i]) / len(chosen) * grad[k]
            for k in one:
                g = total[k] + quality.DECAY * m[k] * (k not in "bd")
                one[k], two[k] = 0.9 * one[k] + 0.1 * g, 0.999 * two[k] + 0.001 * g * g
                m[k] = m[k] - quality.RATE * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    for k in m:
        assert np.allclose(got[k], m[k], atol=2e-4), k
    scores = quality.scores(got, TEXTS)
    assert np.allclose(scores, [plain_bag({k: np.asarray(v, float) for k, v in got.items()}, plain_passages(t))[0] for t in TEXTS], atol=1e-4)
