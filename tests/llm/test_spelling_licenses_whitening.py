import math
import random
import re
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest

from stratum.llm import licenses, spelling, whitening

UPPER, LOWER = spelling.UPPER, spelling.LOWER


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, noise=None, ratio=10, length=7, least=2):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if noise and h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= length
    n = {w: c for w, c in n.items() if c >= least}
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f is not None and n[f] >= ratio * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), c, len(near[w]), n[form[w]] if form[w] else None) for w, c in n.items()}


def noisy_rows():
    rng = random.Random(3)
    words = ["colours", "honours", "ÉCLAIRÉE", "Éclairée", "naïveté", "hellooo", "straßenbahn", "abababa", "zzzzzzzz"]
    rows = []
    for i in range(150):
        out = []
        for _ in range(rng.randrange(12)):
            w = rng.choice(words)
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aéz") + w[at + 1 :], w[:at] + rng.choice("aéz") + w[at:], w.upper()])
            out.append(w)
        rows.append((i if i % 7 else None, rng.choice([" ", "-", "1"]).join(out)))
    return [*rows, (1, None), (2, ""), (3, "colours colours"), (3, "colours colours"), (4, "× ÷ ×××××××× ÷÷÷÷÷÷÷ ××××××××")]


@pytest.mark.parametrize("noise", [None, 3, 31])
def test_variants_equal_brute_force(spark, noise):
    rows = noisy_rows()
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, word string, n int")
    got = [tuple(r) for r in spelling.variants(df, noise=noise, ratio=3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants(rows, noise, 3)


def test_variants_of_chains_long_words_and_nothing(spark):
    rows = [(1, " ".join(["aaaaaaaa"] * 400 + ["aaaaaaab"] * 40 + ["aaaaaabb"] * 4 + ["aaaaabbb"] * 2)), (2, "x" * 20_000 + " " + "xy" * 9_000), (3, "x" * 20_000 + " " + "xy" * 9_000 + " " + "x" * 19_999 + " " + "x" * 19_999)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["word"]: r for r in spelling.variants(df).collect()}
    assert got["aaaaaabb"]["root"] == "aaaaaaaa" and got["aaaaaabb"]["form"] == "aaaaaaab" and got["aaaaabbb"]["form"] is None
    assert got["x" * 20_000]["n_near"] == 1 and got["xy" * 9_000]["n_near"] == 0
    assert spelling.variants(df.limit(0)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "short w"), (2, None)], "doc_id long, text string")).count() == 0


def test_deletion_hashes():
    words = ["abcdefg", "aabbccd", "zzzzzzz"]
    whole, less = spelling.keys_of(np.array([list(map(ord, w)) for w in words], np.uint32))
    for i, w in enumerate(words):
        for j in range(len(w)):
            short = w[:j] + w[j + 1 :]
            assert spelling.keys_of(np.array([list(map(ord, short))], np.uint32))[0][0] == less[i, j]
    assert len(set(less[2])) == 1 and len(set(whole)) == 3


def brute_scan(text, threshold=licenses.THRESHOLD, block=licenses.BLOCK, templates=licenses.TEMPLATES):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    found, share = set(), 0.0
    for at in range(0, max(1, len(words) - block + block // 2), block // 2):
        own = set(words[at : at + block])
        for label, t in templates:
            s = set(licenses.words_of(t))
            if len(own & s) >= math.ceil(threshold * len(s) - 1e-9):
                found.add(label)
                share = max(share, len(own & s) / len(s))
    base = {label for _, label in places}
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if places else share)


def license_texts():
    rng = random.Random(9)
    filler = ["Wörter", "the", "of", "software", "license", "copy", "lorem", "ipsum", "GNU", "mit", "cc", "by", "apache", "general", "public"]
    noise = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    out = [None, "", " .,; ", "CC BY-NC 4.0, cc BY", "The MIT License. mit\nlicense; the GNU General-Public   License", "cc", "apache licenseé", "ﬁ Kelvin K by cc", noise(3000)]
    for _, t in licenses.TEMPLATES:
        words = t.split()
        kept = [w for w in words if rng.random() < 0.95]
        out += [t, t.upper().replace(" ", "\n * "), noise(rng.randrange(300)) + " " + " ".join(kept) + " " + noise(rng.randrange(300)), " ".join(words[: len(words) // 2])]
    return out


def test_licenses_equal_brute_force(spark):
    texts = license_texts()
    df = spark.createDataFrame([(i, t, i, "l") for i, t in enumerate(texts)] + [(None, "MIT License", 0, "l"), (3, texts[3], 0, "l")], "doc_id long, text string, row long, labels string")
    rows = licenses.scan(df).collect()
    assert len(rows) == len(texts) + 2
    got = {r["doc_id"]: tuple(r)[1:] for r in rows}
    for i, t in enumerate(texts):
        assert got[i] == brute_scan(t), t
    assert got[None][1:5] == (1, 0, 0, "mit")
    assert sum(bool(r["labels"]) for r in rows) > 2 * len(licenses.TEMPLATES)
    assert licenses.scan(df.limit(0)).count() == 0


def test_licenses_own_templates(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta"), (3, "epsilon " * 50 + "delta gamma beta alpha")], "doc_id long, text string")
    t = [("own", "Alpha beta, gamma; delta!"), ("none", " .. ")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(df, templates=t, threshold=0.75, block=8).collect()}
    assert got == {1: ("own", 1.0), 2: ("", 0.0), 3: ("own", 1.0)}
    assert {r["labels"] for r in licenses.scan(df, templates=[]).collect()} == {""}
    with pytest.raises(ValueError):
        licenses.scan(df, templates=[("big", " ".join(f"w{i}" for i in range(licenses.MOST_WORDS + 1)))])


def test_license_plan_is_native(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "MIT License")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_whitening(vectors):
    kept = [(k, v) for k, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    deviation = [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x]
    c = np.array([[float((n * r[i] - s[i]) / n) for i in range(d)] for r in x])
    e, w = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:8]
    return kept, n, deviation, c, e[order], w[:, order], np.trace(c.T @ c / n)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    base = (rng.normal(size=(120, 12)) * np.arange(1, 13) / 8).astype(np.float32)
    vectors = [(i, list(map(float, v))) for i, v in enumerate(base)] + [(500, None), (501, [None] * 12), (502, [float("nan")] * 12), (503, [float("inf")] + [0.0] * 11), (None, list(map(float, base[0]))), (3, list(map(float, base[3])))]
    df = spark.createDataFrame([(k, v, 7, 1.0) for k, v in vectors], "vec_id long, embedding array<float>, n int, whitened double")
    kept, n, deviation, c, e, w, trace = brute_whitening(vectors)
    rows = whitening.whiten(df).collect()
    assert len(rows) == 8 * n == 8 * len(kept) and {r["n"] for r in rows} == {n}
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["deviation"]) for r in rows if r["component"] == 1) == sorted((-1 if k is None else k, d) for (k, _), d in zip(kept, deviation))
    assert all(r["deviation_exact"] == Decimal(r["deviation"]) for r in rows)
    for k in range(8):
        want = c @ w[:, k] / math.sqrt(e[k])
        by_id = {key: v for (key, _), v in zip(kept, want)}
        own = [r for r in rows if r["component"] == k + 1]
        sign = np.sign(own[0]["whitened"] * by_id[own[0]["vec_id"]])
        assert all(abs(sign * r["whitened"] - by_id[r["vec_id"]]) < 1e-9 for r in own)
        assert abs(own[0]["explained"] - e[k] / trace) < 1e-12
    assert {r["identity_error"] for r in rows} and rows[0]["identity_error"] < 1e-9


def test_whitening_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], kind)).collect()
    assert len(one) == 2 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in one)
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, [1.0, 2.0, 3.0])], kind)).collect()
    assert len(flat) == 10 and {r["whitened"] is None for r in flat if r["component"] == 2} == {True}
    assert abs(sum(r["whitened"] ** 2 for r in flat if r["component"] == 1) / 5 - 1) < 1e-12 and flat[0]["identity_error"] < 1e-12


def test_whitening_beyond_longs(spark):
    big = [(i, [float(2.0**45) * (i % 3), float(i)]) for i in range(7)]
    rows = whitening.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in big]
    s = [sum(r[i] for r in x) for i in range(2)]
    want = [sum((7 * r[i] - s[i]) ** 2 for i in range(2)) for r in x]
    assert {r["vec_id"]: r["deviation_exact"] for r in rows} == {i: Decimal(w) for i, w in enumerate(want)}
    assert {r["deviation"] for r in rows if want[r["vec_id"]] >= 2**63} == {None}
