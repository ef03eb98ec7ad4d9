import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from stratum.llm import packing, sentence_pieces, token_counts, word_table  # noqa: E402

random.seed(6)
BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
LETTERS = "abZ'’.,<|>09 \n\té ßΣİK ́東.'s'T-_#"


def texts(n, most=80):
    return ["".join(random.choice(LETTERS) for _ in range(random.randrange(most))) + random.choice(["", "don't", "<|endoftext|>", "it'll.'re", "X'S"]) for _ in range(n)]


def test_spliced_counts_equal_whole_ones():
    t = token_counts.tokenizer(BYTE)
    encode = lambda s: t.encode(s, add_special_tokens=False).offsets
    for _ in range(60):
        text = " ".join(texts(20))
        for chunk, overlap in ((50, 5), (300, 20), (1000, 7)):
            assert token_counts.spliced_count(text, encode, chunk, overlap) == len(encode(text))
    for odd in ("a" * 3000, " " * 3000, "東" * 2000, "a \n " * 800):
        assert token_counts.spliced_count(odd, encode, 100, 5) == len(encode(odd))


def test_count_table(spark):
    big = " ".join(["The quick brown fox,"] * 12_000)
    df = spark.createDataFrame([(1, "hello <|endoftext|> world", 0), (2, None, 0), (3, "", 0), (4, big, 0), (4, big, 0)], "doc_id long, text string, n_tokens int")
    rows = token_counts.count(df, BYTE).collect()
    t = token_counts.tokenizer(BYTE)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows}
    n = len(t.encode(big, add_special_tokens=False))
    assert len(rows) == 5 and got[4] == (len(big), n, True) and got[2] == got[3] == (0, 0, False)
    assert got[1][1] == len(t.encode("hello <|endoftext|> world", add_special_tokens=False))
    assert token_counts.count(df.limit(0), BYTE).count() == 0
    by_piece = token_counts.count(df, PIECE).where("doc_id = 1").first()["n_tokens"]
    import sentencepiece

    assert by_piece == len(sentencepiece.SentencePieceProcessor(model_file=PIECE).encode("hello <|endoftext|> world"))


def test_word_ids_equal_the_library():
    w = packing.WordIds(WORD)
    for _ in range(100):
        some = texts(20)
        ids, count = w([t.encode() for t in some])
        at = 0
        for t, n in zip(some, count.tolist()):
            assert ids[at : at + n].tolist() == w.library.encode(t, add_special_tokens=False).ids, t
            at += n


def test_decomposed_capitals_equal_the_library():
    """Capitals with a mark that compose only in lower case; case folded before NFC gives other ids."""
    w = packing.WordIds(WORD)
    pairs = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a"]
    fixed = [f"x {p}ab" for p in pairs] + [f"{p}{q}.{p}" for p in pairs for q in pairs] + ["J\u0323\u030c", "AJ\u030cB Plain", "I\u0307 \u0130", "=\u0338A<\u0338", "\u212a.K\u030c"]
    letters = LETTERS + "JHTWYjhtwyAI=\u030c\u0331\u0308\u030a\u0323\u0338\u0307"
    mixed = ["".join(random.choice(letters) for _ in range(random.randrange(60))) for _ in range(1000)]
    for some in ([t] for t in fixed + mixed):
        ids, count = w([t.encode() for t in some])
        assert ids.tolist() == w.library.encode(some[0], add_special_tokens=False).ids, some[0]
        assert count.tolist() == [len(ids)]
    ids, _ = w([t.encode() for t in fixed])
    assert ids.tolist() == [i for t in fixed for i in w.library.encode(t, add_special_tokens=False).ids]


@pytest.mark.parametrize("limit, held", [(5, 1 << 26), (1 << 20, 60)])
def test_word_table_empties_itself(monkeypatch, limit, held):
    monkeypatch.setattr(word_table, "HELD", held)
    w = packing.WordIds(WORD)
    w.words.limit = limit
    for _ in range(20):
        some = texts(5)
        ids, count = w([t.encode() for t in some])
        assert ids.tolist() == [i for t in some for i in w.library.encode(t, add_special_tokens=False).ids]


def colliding_words():
    """A Thue-Morse string of 1,024 letters and its complement: every polynomial hash modulo 2 ** 64 takes them for equal."""
    s = "a"
    for _ in range(11):
        s += s.translate(str.maketrans("ab", "ba"))
    return s[:1024], s[1024:]


def test_words_of_one_hash(spark, monkeypatch):
    from stratum.llm.word_table import WordTable

    rows = [(i, f"say abcdefgh{w} twice") for i, w in enumerate(colliding_words())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    library, original = packing.WordIds(WORD).library, sentence_pieces.Codec(PIECE).original
    import zlib

    import numpy as np

    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = [(i, crc(library.encode(t, add_special_tokens=False).ids + [0])) for i, t in rows]
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in packing.pack(df, WORD).collect()) == want
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in sentence_pieces.encode(df, PIECE).collect()) == [(i, crc(original.encode(t))) for i, t in rows]
    # a table whose hash says nothing still tells words apart
    monkeypatch.setattr(WordTable, "hashes", lambda self, head, tail, width: np.minimum(width, np.uint64(2)))
    w = packing.WordIds(WORD)
    for _ in range(20):
        some = texts(20)
        ids, _ = w([t.encode() for t in some])
        assert ids.tolist() == [i for t in some for i in w.library.encode(t, add_special_tokens=False).ids]


def test_other_files_are_encoded_whole(tmp_path):
    """Files whose parts don't prove that texts can be cut."""
    other = packing.WordIds(BYTE)
    assert not other.plain and packing.WordIds(WORD).plain
    some = texts(30)
    ids, count = other([t.encode() for t in some])
    assert ids.tolist() == [i for t in some for i in other.library.encode(t, add_special_tokens=False).ids] and len(count) == 30
    assert token_counts.cuttable(BYTE) and not token_counts.cuttable(WORD)
    long = [" ".join(texts(3000))]
    assert token_counts.count_texts(long, token_counts.tokenizer(WORD), False) == [len(token_counts.tokenizer(WORD).encode(long[0], add_special_tokens=False))]


def test_sentence_pieces_parity():
    import sentencepiece

    original = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    c = sentence_pieces.Codec(PIECE)
    odd = ["", " ", "  a  b ", "a\tb\n\nc", "日本語 テスト 😀", "▁x ▁", "<s> </s> <unk>", "<0x41>", " lead", "trail  ", "x" * 300, "\x00\x01", "   ", "lead  two"]
    for some in [odd, odd[:5] + odd[7:9], *(texts(8) for _ in range(60))]:
        ids, count, back = c.encode([t.encode() for t in some])
        at = 0
        for t, n, ok in zip(some, count.tolist(), back.tolist()):
            assert ids[at : at + n].tolist() == original.encode(t), t
            assert ok
            at += n


def test_parity_is_verified():
    c = sentence_pieces.Codec(PIECE)
    c.original = type("Other", (), {"encode": staticmethod(lambda t, num_threads: [[0]] * len(t))})
    with pytest.raises(sentence_pieces.ParityError):
        c.encode([b"hello"])


def test_unigram_model_from_protobuf(tmp_path):
    """A small unigram model written by hand: score order decides, unknown characters fall back to bytes."""
    import struct

    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    def piece(text, score, kind=1):
        body = field(1, text.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + (bytes([3 << 3, kind]) if kind != 1 else b"")
        return field(1, body)

    pieces = [piece("<unk>", 0, 2), piece("<s>", 0, 3), piece("</s>", 0, 3)] + [piece(f"<0x{i:02X}>", 0, 6) for i in range(256)]
    pieces += [piece(p, s) for p, s in (("▁", -2.0), ("a", -3.0), ("b", -3.1), ("ab", -2.5), ("▁ab", -1.5), ("ba", -4.0))]
    trainer = bytes([3 << 3, 1]) + bytes([35 << 3 & 0x7F | 0x80, 35 << 3 >> 7, 1])
    spec = bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1])
    path = tmp_path / "small.model"
    path.write_bytes(b"".join(pieces) + field(2, trainer) + field(3, spec))
    import sentencepiece

    original = sentencepiece.SentencePieceProcessor(model_file=str(path))
    c = sentence_pieces.Codec(str(path))
    assert c.model["kind"] == sentence_pieces.UNIGRAM and c.model["byte_fallback"]
    for t in ("ab ab", "abba b", "aé", "b  a"):
        assert c.encode([t.encode()])[0].tolist() == original.encode(t), t


def test_sentence_piece_table(spark):
    long = " ".join(["Hello there,  wörld."] * 9000)
    texts_ = [(1, "Hello wörld 𓂀"), (2, None), (3, ""), (4, long), (4, long)]
    df = spark.createDataFrame([(*t, 0) for t in texts_], "doc_id long, text string, ids int")
    made = sentence_pieces.encode(df, PIECE)
    rows = {r["doc_id"]: r for r in made.collect()}
    assert made.count() == 5 and rows[4]["n_tokens"] == len(rows[4]["ids"]) and sentence_pieces.encode(df.limit(0), PIECE).count() == 0
    assert sorted(r["text"] for r in sentence_pieces.decode(made, PIECE).collect()) == sorted(t or "" for _, t in texts_)
    assert rows[1]["n_byte_pieces"] == 4 and rows[1]["round_trip"] and rows[2]["n_tokens"] == rows[3]["n_tokens"] == 0
    import sentencepiece

    some = sentencepiece.SentencePieceProcessor(model_file=PIECE).encode("Hello world")
    ids = spark.createDataFrame([(some,), (None,), ([],)], "ids array<int>")
    assert [r["text"] for r in sentence_pieces.decode(ids, PIECE).collect()] == ["Hello world", None, ""]


def test_packing(spark):
    docs = [(i, " ".join(random.choice(["alpha", "beta", "x,y", "42"]) for _ in range(random.randrange(0, 900)))) for i in range(300)]
    docs += [(1000, "word " * 5000), (1001, None), (1002, ""), (1000, "word " * 5000), (None, "word " * 3)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, length int")
    packing.PROBLEM, kept = 64, packing.PROBLEM
    try:
        rows = packing.pack(df, WORD).collect()
    finally:
        packing.PROBLEM = kept
    w = packing.WordIds(WORD)
    lengths = [len(w.library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs]
    assert sum(r["length"] for r in rows) == sum(lengths) and len(rows) == sum(-(-n // 2048) for n in lengths)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(lengths) // 2048) + 4
    import zlib

    import numpy as np

    want = []
    for i, t in docs:
        ids = np.array([*w.library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, a, min(2048, len(ids) - a), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(repr, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows))) == sorted(map(repr, want))
    pieces = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 1000)
    assert pieces[:2] == [(0, 0, 2048)] * 2 and pieces[-1] == (2, 4096, 5001 - 4096)
    assert packing.pack(df.limit(0), WORD).count() == 0


def test_genetic_operators_keep_every_piece():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 2048) for _ in range(400)]
    a = packing.packed(lengths, list(range(400)), 2048)
    b = packing.packed(lengths, sorted(range(400), key=lambda i: -lengths[i]), 2048)
    for child in (packing.crossover(a, b, lengths, 2048, rng), packing.mutated(a, lengths, 2048, rng), *packing.evolve(lengths, [a], 5, rng)):
        assert sorted(i for x in child for i in x) == list(range(400)) and all(sum(lengths[i] for i in x) <= 2048 for x in child)
    assert packing.decoded(packing.coded(a, 400)) and len(packing.evolve(lengths, [a], 8, rng)[0]) <= len(b)


def test_crossovers_lower_the_count_of_random_plans():
    """No plan begins sorted; the least number of bins falls by crossovers, and an island gains by the elite of another."""
    rng = random.Random(4)
    lengths = [rng.randrange(1, 1200) for _ in range(2000)]
    history = []
    best = packing.evolve(lengths, [], 30, rng, history=history)
    bound = len(packing.packed(lengths, sorted(range(2000), key=lambda i: -lengths[i]), 2048))
    assert history[0] > history[-1] == len(best[0]) and history == sorted(history, reverse=True)
    assert history[0] - history[-1] >= 3 and len(best[0]) <= bound
    assert sorted(i for b in best[0] for i in b) == list(range(2000)) and max(packing.fills(best[0], lengths)) <= 2048
    other = []
    packing.evolve(lengths, [best[0]], 0, random.Random(5), history=other)  # an island that has only taken in the elite
    alone = []
    packing.evolve(lengths, [], 0, random.Random(5), history=alone)
    assert other[0] == len(best[0]) < alone[0]


def test_no_more_bins_than_best_fit_decreasing(spark, monkeypatch):
    monkeypatch.setattr(packing, "GENERATIONS", 0)
    rng = random.Random(6)
    lengths = [rng.randrange(1, 900) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(lengths)), "item long, length int")
    plan = packing.solved(rows, 1, "test-plan", 2048).collect()
    assert len({r["bin"] for r in plan}) == len(packing.packed(lengths, sorted(range(300), key=lambda i: -lengths[i]), 2048))
