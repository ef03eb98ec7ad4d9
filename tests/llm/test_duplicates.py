import collections
import hashlib
import random

import numpy as np
import pytest

from stratum.llm import components, minhash, multi_index, suffix_dedup
from stratum.llm.suffix_order import suffix_array

random.seed(7)


def union(n, pairs):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = top(a), top(b)
        root[max(p, q)] = min(p, q)
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("shape", ["chain", "star", "random", "cycle", "none"])
def test_components(spark, shape):
    n = 60
    pairs = {"chain": [(i, i + 1) for i in range(n - 1)], "star": [(n - 1, i) for i in range(n - 1)], "cycle": [(i, (i + 1) % n) for i in range(n)], "none": [(3, 3)]}.get(shape) or [(random.randrange(n), random.randrange(n)) for _ in range(40)]
    want = union(n, pairs)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs + pairs, "a long, b long")).collect()}
    touched = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {i: want[i] for i in touched}


# --- suffix arrays


def naive(texts):
    symbols, bounds, want = [], [0], []
    for t in texts:
        symbols += [c + 2 for c in t] + [0]
        lo, hi = bounds[-1], len(symbols)
        bounds.append(hi)
        want += sorted(range(lo, hi), key=lambda p: symbols[p:hi])
    return np.array(symbols, np.uint16), np.array(bounds), want


@pytest.mark.parametrize("letters", [1, 2, 3, 20])
def test_linear_grouping_sorts_suffixes(letters):
    for _ in range(60):
        texts = [[random.randrange(letters) for _ in range(random.randrange(70))] for _ in range(random.randrange(1, 9))]
        symbols, bounds, want = naive(texts)
        assert suffix_array(symbols, bounds).tolist() == want


def test_linear_grouping_of_periodic_texts():
    for unit in ("ab", "aab", "banana", "abaab"):
        symbols, bounds, want = naive([[ord(c) for c in unit] * 15, [ord(c) for c in unit[::-1]] * 9])
        assert suffix_array(symbols, bounds).tolist() == want


# --- repeated strings


def cut_by_brute_force(rows, span=400):
    seen = collections.Counter(b[p : p + span] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - span + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if seen[b[p : p + span]] > 1:
                gone[p : p + span] = b"\1" * span
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def report_rows(df, **more):
    """The columns that cut_by_brute_force gives, after a look at text: what is left, but for characters cut by an edge."""
    rows = suffix_dedup.report(df, **more).collect()
    for r in rows:
        whole = hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]
        assert whole or len(r["text"].encode()) >= r["n_bytes"] - r["n_removed"]
    return sorted((tuple(r)[:5] for r in rows), key=repr)


def repeats_table():
    passage = "".join(random.choice("abcdeé ") for _ in range(3000))
    noise = lambda n: "".join(random.choice("xyz ") for _ in range(random.randrange(n)))
    rows = []
    for i in range(60):
        a = random.randrange(2000)
        rows.append((i, noise(500) + passage[a : a + random.randrange(380, 900)] + noise(300)))
    rows += [(900, None), (901, ""), (902, "a" * 1500), (902, "a" * 1500), (903, "ab" * 700), (None, passage[:500]), (0, passage[:500]), (-(2**63), passage[100:700]), (905, "q" * 399), (906, "b" * 400), (907, "c" * 401), (908, passage[1000:1399]), (909, passage * 2)]
    return rows


@pytest.mark.parametrize("classes", [1024, 3, 1])
def test_repeated_strings(spark, monkeypatch, classes):
    monkeypatch.setattr(suffix_dedup, "CLASSES", classes)
    rows = repeats_table()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, hash int")
    assert report_rows(df) == cut_by_brute_force(rows)


def test_repeats_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    rows = repeats_table()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert report_rows(df) == cut_by_brute_force(rows)


@pytest.mark.parametrize("span", [120, 200])
def test_repeated_strings_of_other_lengths(spark, span):
    rows = repeats_table()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert report_rows(df, span=span) == cut_by_brute_force(rows, span)


def test_pairs_that_agree():
    raw = np.frombuffer(bytes(random.choice(b"ab") for _ in range(3000)) * 2 + b"a" * 900, np.uint8)
    a, b = np.array([random.randrange(6000) for _ in range(500)]), np.array([random.randrange(6000) for _ in range(500)])
    b[::2] = (a[::2] + 3000) % 6000
    for span in (5, 40):
        assert suffix_dedup.agree(raw, a, b, span).tolist() == [bytes(raw[x : x + span]) == bytes(raw[y : y + span]) for x, y in zip(a, b, strict=True)]


def test_only_passages_of_many_words_leave(spark):
    words = lambda n: " ".join(random.choice("abcdefgh") * random.randrange(3, 6) for _ in range(n))
    long, short, solid = words(60), words(45), "x" * 390
    rows = [(1, f"{words(9)} {long} {words(7)}"), (2, f"{long}. {words(30)}"), (3, f"{short}! {words(20)}"), (4, f"{words(12)} {short}"), (5, f"{solid}-{words(4)}"), (6, f"{words(5)}+{solid}"), (7, None), (8, "")]
    df = spark.createDataFrame([(*r, "other", 5, 6) for r in rows], "doc_id long, text string, _stratum_id string, row int, spans int")
    got = {r["doc_id"]: r for r in suffix_dedup.remove(df, span=200, words=50, size=400).collect()}
    assert len(got) == 8 and all((r["_stratum_id"], r["row"], r["spans"]) == ("other", 5, 6) for r in got.values())
    assert long not in got[1]["text"] + got[2]["text"] and len(got[2]["text"]) <= len(rows[1][1]) - len(long)
    assert all(got[i]["text"] == t for i, t in rows[2:])


def test_removal_keeps_rows_columns_and_characters(spark):
    shared = "é" * 300
    df = spark.createDataFrame([(1, "x" + shared + "y", "en"), (2, "zz" + shared + "w", "de"), (3, None, "fr"), (4, "clean", "fr")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in suffix_dedup.remove(df).collect()}
    assert len(got) == 4 and got[1]["text"] == "xy" and got[2]["text"] == "zzw" and got[3]["text"] is None and got[4]["text"] == "clean" and got[2]["lang"] == "de"
    assert suffix_dedup.report(df.limit(0)).count() == 0 and suffix_dedup.remove(df.limit(0)).count() == 0


# --- near-duplicate documents


def shingles(text):
    words = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_by_brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    ids = sorted(range(len(rows)), key=lambda i: rows[i][0])
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    order = {i: n for n, i in enumerate(ids)}
    top = union(len(rows), [(order[a], order[b]) for a, b in pairs])
    return sorted((rows[i][0], len(sets[i]), rows[ids[top[order[i]]]][0], rows[i][0] == rows[ids[top[order[i]]]][0]) for i in range(len(rows)))


def near_table():
    word = lambda: random.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(random.randrange(40))
    rows, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(random.randrange(30, 120))]
        for _ in range(random.randrange(1, 14)):
            w = list(base)
            for _ in range(random.randrange(0, 4)):
                w[random.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \t\n"), (i + 3, "One two"), (i + 4, "one\x0btwo"), (i + 5, "one two three"), (i + 6, "É A"), (i + 7, "é a"), (i + 8, "long " * 4000)]
    return rows


@pytest.mark.parametrize("rounds,block", [(2, 1024), (0, 3), (1, 2)])
def test_near_duplicates(spark, monkeypatch, rounds, block):
    monkeypatch.setattr(minhash, "PIVOT_ROUNDS", rounds)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_table()
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, key string")
    assert sorted(tuple(r) for r in minhash.near_duplicates(df).collect()) == near_by_brute_force(rows)


def test_near_duplicates_repeated_and_null_rows(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (8, "other words")], "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (8, 1, 8, True), (None, 2, None, None)], key=repr)
    kept = sorted((r["doc_id"] for r in minhash.distinct(df).collect()), key=str)
    assert kept == [5, 8, None]
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.distinct(df.limit(0)).count() == 0


def near_by_ids(rows):
    """near_by_brute_force() where an id may have several texts: it links with whatever any of them links with."""
    sets = [shingles(t) for _, t in rows]
    ids = sorted({i for i, _ in rows if i is not None})
    place = {d: n for n, d in enumerate(ids)}
    pairs = [(place[rows[a][0]], place[rows[b][0]]) for a in range(len(rows)) for b in range(a) if None not in (rows[a][0], rows[b][0]) and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    top = union(len(ids), pairs)
    own = lambda d: None if d is None else ids[top[place[d]]]
    return sorted(((d, len(s), own(d), None if d is None else own(d) == d) for (d, _), s in zip(rows, sets, strict=True)), key=repr)


def test_ids_of_several_texts(spark):
    a, b = (" ".join(f"{x}{random.randrange(99)}" for _ in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "other"), (4, a), (4, None), (7, "alone"), (7, ""), (None, a), (9, b), (9, b), (10, ""), (10, b), (10, None)]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, _stratum_id string")
    assert sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=repr) == near_by_ids(rows)
    kept = minhash.distinct(df).collect()
    assert sorted(((r["doc_id"]) for r in kept), key=str) == [1, 7, None] and {r["_stratum_id"] for r in kept} == {"mine"}
    rows = [(1, ""), (1, a), (1, None), (2, None), (2, a + " more")]  # an empty text beside a whole one
    for order in rows, rows[::-1]:
        df = spark.createDataFrame(order, "doc_id long, text string")
        assert sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=repr) == near_by_ids(rows)
    rows = near_table()
    rows = [(i // 2 * (i % 3 > 0), t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=repr) == near_by_ids(rows)


def test_min_max_signature():
    f, sets = minhash.multipliers(), minhash.Shingles()
    a, b = sets(b" ".join(b"w%d" % i for i in range(400))), sets(b" ".join(b"w%d" % i for i in range(40, 440)))
    x, y = minhash.signature(a, f), minhash.signature(b, f)
    with np.errstate(over="ignore"):
        assert all(x[2 * i] == (a * p + q).min() and x[2 * i + 1] == (a * p + q).max() for i, (p, q) in enumerate(f))
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((x == y).mean() - truth) < 0.15
    assert minhash.similar(a, a) and not minhash.similar(a, a[:0])


# --- near-duplicate vectors


def vectors_by_brute_force(rows, cosine):
    sound = [k is not None and l is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for k, v, l in rows]
    ids = sorted((i for i in range(len(rows)) if sound[i]), key=lambda i: rows[i][0])
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in ids}
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if rows[ids[a]][2] == rows[ids[b]][2] and len(unit[ids[a]]) == len(unit[ids[b]]) and unit[ids[a]] @ unit[ids[b]] >= cosine]
    top, links = union(len(ids), pairs), collections.Counter(x for p in pairs for x in p)
    own = {i: (links[n], rows[ids[top[n]]][0]) for n, i in enumerate(ids)}
    out = []
    for i, (k, _, _) in enumerate(rows):
        n, c = own.get(i, (0, k))
        out.append((k, n, c, k == c if k is not None else None))
    return sorted(out, key=repr)


def vector_table(spark):
    rng = np.random.default_rng(0)
    base, rows = rng.normal(size=(20, 8)), []
    for i in range(400):
        v = base[rng.integers(20)] * rng.uniform(0.5, 2) + rng.normal(size=8) * rng.choice([0, 0.05, 0.12, 1])
        rows.append((i, [float(x) for x in v], int(rng.integers(3))))
    rows += [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [None] + [1.0] * 7, 1), (2003, [float("nan")] * 8, 1), (2004, rows[0][1], None), (5, rows[5][1], rows[5][2]), (2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1), (2007, [], 1), (2008, [3.0], 0), (None, rows[1][1], 1), (2009, [float("inf")] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df, [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("block,queries,most,cell", [(1 << 23, 256, 1 << 16, 512), (448, 7, 5, 4)])
def test_near_vectors(spark, monkeypatch, block, queries, most, cell):
    monkeypatch.setattr(multi_index, "BLOCK_BYTES", block)
    monkeypatch.setattr(multi_index, "QUERIES", queries)
    monkeypatch.setattr(multi_index, "MOST_QUERIES", most)
    monkeypatch.setattr(multi_index, "PER_CELL", cell)
    df, rows = vector_table(spark)
    assert sorted((tuple(r) for r in multi_index.near_duplicates(df).collect()), key=repr) == vectors_by_brute_force(rows, 0.98)
    assert multi_index.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_a_lower_target(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "PER_CELL", 4)
    df, rows = vector_table(spark)
    got = sum(r["n_links"] for r in multi_index.near_duplicates(df, target=0.95).collect())
    want = sum(r[1] for r in vectors_by_brute_force(rows, 0.98))
    assert 0.9 * want <= got <= want


def test_one_label_with_nearly_all_rows(spark, monkeypatch):
    """95 percent of the rows have one label, the rest a label each: cells, groups and blocks stay bounded, and no link is missed."""
    monkeypatch.setattr(multi_index, "PER_CELL", 4)
    monkeypatch.setattr(multi_index, "BLOCK_BYTES", 40 * 64)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 8))
    rows = [(i, [float(x) for x in base[rng.integers(60)] + rng.normal(size=8) * rng.choice([0, 0.03, 0.08])], 0 if i % 20 else i) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    tables, kept = {}, multi_index.cut
    monkeypatch.setattr(multi_index, "cut", lambda t, name: tables.setdefault(name, kept(t, name)))
    assert sorted((tuple(r) for r in multi_index.near_duplicates(df).collect()), key=repr) == vectors_by_brute_force(rows, 0.98)
    cells = tables["index-cells"].where("label = '0'")
    assert cells.count() > 8 and cells.groupBy("group").agg({"bytes": "sum"}).count() > 4
    most = cells.agg({"bytes": "max"}).first()[0]
    assert cells.groupBy("group").agg({"bytes": "sum"}).agg({"sum(bytes)": "max"}).first()[0] <= multi_index.BLOCK_BYTES + most
    assert tables["index-visits"].where("label <> '0'").count() == 44


def test_grids_by_size():
    rng = np.random.default_rng(2)
    tight = rng.normal(size=(40, 16))[rng.integers(40, size=2000)] + rng.normal(size=(2000, 16)) * 0.01
    grids = multi_index.Grids(tight, 4_000_000, 0.98, 1.0)
    words = [len(g.words[0]) for g in grids.grids]
    small, large = grids.levels(np.array([10, 4_000_000])).tolist()
    assert words == sorted(words) and words[small] <= words[large] and words[large] >= 8  # clusters: more cells for more vectors
    loose = multi_index.Grids(rng.normal(size=(2000, 64)), 4_000_000, 0.98, 1.0)
    assert (loose.visited[:, 1] > 0).all()


def test_multi_sequence_order():
    rng = np.random.default_rng(1)
    one, two = rng.random(6), rng.random(5)
    got = multi_index.visits(one, two, 0.9)
    want = sorted((one[i] + two[j], i, j) for i in range(6) for j in range(5) if one[i] + two[j] <= 0.9)
    assert got == [(i, j) for _, i, j in want]
