"""SentencePiece models on the tokenizers library.

The model file is a protobuf; parse() reads its wire format without a schema. build() makes a tokenizers pipeline
from it: the normaliser (its compiled character map, white-space rules), the metaspace marker, unigram scores or
BPE merges implied by piece scores, and byte fallback.

Where no piece of the model has a marker after another character and the normaliser has no character map, a text
is its units (a run of spaces and the word after it): a worker encodes each distinct unit once, in batches on the
library's own threads, and puts texts together from them. Other models' texts are encoded whole. Parity is
verified for every unit (or text): the original library encodes it too, and a difference raises ParityError. So is
the way back: a unit decoded from its ids is the unit, else round_trip is false.

Cases: a null or empty text has no ids; user-defined and control pieces inside a text are ordinary text, as in the
original; repeated rows and rows with a null id each give a row; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratum.llm.common import keyed_bytes, lean, ship
from stratum.llm.word_table import WordTable

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces
UNIGRAM, BPE = 1, 2  # kinds of models
#: Units that a worker remembers (from task to task), bytes of text taken together, and the library's threads in each worker.
REMEMBERED, TOGETHER, THREADS = 1_000_000, 1 << 19, 2


class ParityError(ValueError):
    pass


def fields(data: bytes) -> list[tuple[int, object]]:
    """(number, value) of a protobuf message: varints as int, fixed ones as bytes, the rest as bytes."""
    out, at = [], 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            out.append((number, varint()))
        else:
            n = {1: 8, 5: 4}.get(wire) or varint()
            out.append((number, data[at : at + n]))
            at += n
    return out


def parse(data: bytes) -> dict:
    """pieces: (text, score, kind); model kind, unknown id, byte fallback; normaliser: character map, dummy prefix, extra spaces, escaping."""
    out = {"pieces": [], "kind": UNIGRAM, "byte_fallback": False, "unknown": 0, "charsmap": b"", "dummy_prefix": True, "remove_extra": True, "escape": True, "suffix": False}
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            out["pieces"].append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(fields(value))
            out |= {"kind": spec.get(3, UNIGRAM), "byte_fallback": bool(spec.get(35, 0)), "unknown": spec.get(40, 0), "suffix": bool(spec.get(24, 0))}
        elif number == 3:
            spec = dict(fields(value))
            out |= {"charsmap": spec.get(2, b""), "dummy_prefix": bool(spec.get(3, 1)), "remove_extra": bool(spec.get(4, 1)), "escape": bool(spec.get(5, 1))}
    return out


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs of pieces that form a piece, best scores first: the order in which the original merges."""
    score = {p: s for p, s, kind in pieces if kind in (NORMAL, USER, UNUSED)}
    rank = {p: i for i, (p, _, _) in enumerate(pieces)}
    found = []
    for whole, s in score.items():
        parts = [(whole[:i], whole[i:]) for i in range(1, len(whole)) if whole[:i] in score and whole[i:] in score]
        found += [(-s, rank[whole], rank[a], rank[b], a, b) for a, b in parts]
    return [(a, b) for *_, a, b in sorted(found)]


@cache
def build(path: str):
    """The tokenizers pipeline for the model file at path."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    with open(path, "rb") as f:
        m = parse(f.read())
    pieces = m["pieces"]
    if m["kind"] == UNIGRAM:
        low = min((s for _, s, k in pieces if k == NORMAL), default=0.0)
        model = models.Unigram([(p, s if k != UNUSED else low - 100) for p, s, k in pieces], unk_id=m["unknown"], byte_fallback=m["byte_fallback"])
    elif m["kind"] == BPE:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(pieces)}, merges(pieces), unk_token=pieces[m["unknown"]][0], fuse_unk=True, byte_fallback=m["byte_fallback"])
    else:
        raise ValueError("only unigram and BPE models")
    t = Tokenizer(model)
    steps = []
    if m["charsmap"]:
        steps.append(normalizers.Precompiled(m["charsmap"]))
    if m["remove_extra"]:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m["dummy_prefix"]:
        steps.append(normalizers.Prepend(" "))
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    # where no piece has a marker after another character, markers part a text into units that no piece crosses
    if not any(MARK in p.lstrip(MARK) for p, _, _ in pieces):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m["dummy_prefix"] else [])])
    return t, m


def described(path: str) -> str:
    """What build() made, without vocabulary and merges."""
    made = json.loads(build(path)[0].to_str())
    made["model"] = {k: v for k, v in made["model"].items() if k not in ("vocab", "merges")}
    return json.dumps(made)


class Codec:
    """Encodes and decodes by build(path), and verifies parity with the original library."""

    def __init__(self, path: str, verify: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        self.tokenizer, self.model = build(path)
        self.by_unit = not self.model["charsmap"] and not self.model["remove_extra"] and self.tokenizer.pre_tokenizer is not None
        self.original = None
        if verify:
            import sentencepiece

            self.original = sentencepiece.SentencePieceProcessor(model_file=path)
        self.units = WordTable(self.learn, REMEMBERED)

    def learn(self, units: list[bytes]) -> tuple[list[list[int]], list[bool]]:
        skip = int(self.model["dummy_prefix"])  # the unit's first space is the one that the normaliser adds
        texts = [u[skip:].decode("utf-8", "replace") for u in units]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.original:
            for text, ours, theirs in zip(texts, found, self.original.encode(texts, num_threads=1), strict=True):
                if ours != theirs:
                    raise ParityError(f"{text!r}: {ours}, but the original library gives {theirs}")
        return found, [a == normal(b, self.model) for a, b in zip(self.decode(found), texts, strict=True)]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after another, the number of ids of each, and whether its ids lead back to it."""
        # a marker in a text acts as a space; spaces at the end have no word after them
        plain = self.by_unit and not any(t.endswith(b" ") or MARK.encode() in t for t in texts)
        if not plain:
            if len(texts) > 1:
                parts = [self.encode([t]) for t in texts]
                return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            found, flags = self.learn([b" " * self.model["dummy_prefix"] + texts[0]]) if texts[0] else ([[]], [True])
            return np.array(found[0], np.uint32), np.array([len(found[0])]), np.array(flags)
        prefix = b" " * self.model["dummy_prefix"]
        marked = [prefix + t if t else t for t in texts]
        joined = b"".join(marked)
        raw = np.frombuffer(joined, np.uint8)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))])
        begins = (raw == 32) & np.concatenate([[True], raw[:-1] != 32]) if len(raw) else np.empty(0, bool)
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        start = np.flatnonzero(begins)
        ids, count, flag = self.units(joined, start, np.append(start[1:], len(raw)))
        of = np.searchsorted(start, bounds)
        total = np.concatenate([[0], np.cumsum(count)])
        wrong = np.concatenate([[0], np.cumsum(~flag)])
        return ids, np.diff(total[of]), np.diff(wrong[of]) == 0

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


@cache
def codec_of(path: str, verify: bool) -> Codec:
    """The worker's own codec, which outlives a task: units that one task verified serve those after it."""
    return Codec(path, verify=verify)


def normal(text: str, model: dict) -> str:
    """text as decoding should give it back: a marker is a space, and extra spaces go if the model says so. (Texts changed by a character map don't count as led back to.)"""
    text = text.replace(MARK, " ")
    return " ".join(x for x in text.split(" ") if x) if model["remove_extra"] else text


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", verify: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, n_byte_pieces, round_trip, ids array<int>) of each row: ids as the model's own library gives them; decode() takes them back to text."""

    def run(batches):
        codec = codec_of(path, verify)
        is_byte = np.array([k == BYTE for _, _, k in codec.model["pieces"]])
        for b in batches:
            data, rows, at, parts = [x.as_py() for x in b.column(1)], [], 0, [np.empty(0, np.int32)]
            while at < len(data):
                size, end = 0, at
                while end < len(data) and (end == at or size + len(data[end]) < TOGETHER):
                    size, end = size + len(data[end]) + 1, end + 1
                ids, count, back = codec.encode(data[at:end])
                ids = ids.astype("<u4")
                place = 0
                for n, ok in zip(count.tolist(), back.tolist(), strict=True):
                    own = ids[place : place + n]
                    rows.append((n, zlib.crc32(own.tobytes()), int(is_byte[own].sum()), ok))
                    place += n
                parts.append(ids.astype(np.int32))
                at = end
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            ends = np.concatenate([[0], np.cumsum(cols[0])]).astype(np.int32)
            every = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)), every], names=["doc_id", "n_tokens", "ids_crc32", "n_byte_pieces", "round_trip", "ids"])

    ship(df.sparkSession)
    return keyed_bytes(df, key, text).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_crc32 long, n_byte_pieces long, round_trip boolean, ids array<int>")


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """df with the text of a column of ids (null for null ids)."""
    from pyspark.sql import functions as F

    ship(df.sparkSession)

    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        codec, rows = Codec(path, verify=False), column.to_pylist()
        known = codec.decode([[int(i) for i in x] for x in rows if x is not None])
        texts = iter(known)
        return pa.array([None if x is None else next(texts) for x in rows], pa.string())

    return df.withColumn(out, decoded(F.col(f"`{ids}`")))
