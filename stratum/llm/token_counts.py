"""Token counts: overlap resynchronisation for huge documents.

A text of up to CHUNK characters is encoded whole, as is any text by a file that isn't known to allow cuts. A longer one is encoded in chunks that overlap by OVERLAP
characters, with offsets; two neighbours are spliced at a boundary that both encodings have and that is
proven stable: a single space between two visible characters, which no pre-token of the byte-level pattern
crosses, so nothing before it changes the tokens after it. If the overlap holds none, it is doubled, up to
the rest of the text.

Cases: a null or empty text has 0 tokens; text without any space is encoded whole after widening; special
strings inside a text are handled as the library does by default; repeated rows and rows with a null id each give a row;
an empty table gives none; extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from stratum.llm.common import keyed_bytes, lean, ship

CHUNK, OVERLAP = 32_768, 512
#: Characters of text given to the library at once: its encodings hold about 100 bytes a token.
TOGETHER = 1 << 18
LIMIT = 1024


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use every core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def cuttable(path: str) -> bool:
    """Whether a stable place in a text is one for the file at path too: the byte-level pattern alone makes pre-tokens, nothing normalises, and no added token holds a space or takes those beside it."""
    made = json.loads(tokenizer(path).to_str())
    before = made["pre_tokenizer"] or {}
    return (
        made["normalizer"] is None
        and (before.get("type"), before.get("use_regex"), before.get("add_prefix_space")) == ("ByteLevel", True, False)
        and made["model"]["type"] == "BPE"
        and not made["model"].get("dropout")
        and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in made["added_tokens"])
    )


def visible(c: str) -> bool:
    return c.isalnum() or "!" <= c <= "~"


def stable(text: str, at: int) -> bool:
    """Whether no pre-token can cross the place before text[at]."""
    return 0 < at < len(text) - 1 and text[at] == " " and visible(text[at - 1]) and visible(text[at + 1])


def spliced_count(text: str, encode: Callable[[str], list[tuple[int, int]]], chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of text from overlapping chunks; encode gives the (start, end) of each token of a string."""
    total, start = 0, 0
    while True:  # start is a stable boundary, or 0
        width = overlap
        while True:
            end = min(len(text), start + chunk + width)
            own = encode(text[start:end])
            if end == len(text):
                return total + len(own)
            ahead = start + chunk
            other = {a + ahead for a, _ in encode(text[ahead:end])}
            cuts = [i for i, (a, _) in enumerate(own) if a + start > ahead and a + start in other and stable(text, a + start) and a + start < end - 1]
            if cuts:
                break
            width *= 2
        total += cuts[-1]
        start += own[cuts[-1]][0]


def count_texts(texts: list[str], t, cut: bool = True) -> list[int]:
    counts, short = [0] * len(texts), []
    for i, text in enumerate(texts):
        if len(text) > CHUNK and cut:
            counts[i] = spliced_count(text, lambda s: t.encode(s, add_special_tokens=False).offsets)
        elif text:
            short.append(i)
    at = 0
    while at < len(short):
        size, end = 0, at
        while end < len(short) and (end == at or size + len(texts[short[end]]) <= TOGETHER):
            size, end = size + len(texts[short[end]]), end + 1
        for i, e in zip(short[at:end], t.encode_batch_fast([texts[i] for i in short[at:end]], add_special_tokens=False), strict=True):
            counts[i] = len(e)
        at = end
    return counts


def count(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) by the tokenizer file at path (.json: tokenizers; .model: sentencepiece, whole texts)."""

    def run(batches):
        if path.endswith(".model"):
            import sentencepiece

            m = sentencepiece.SentencePieceProcessor(model_file=path)
            counted = lambda texts: [len(m.encode(x)) for x in texts]
        else:
            counted = lambda texts: count_texts(texts, tokenizer(path), cuttable(path))
        for b in batches:
            data = [x.as_py() for x in b.column(1)]
            n = counted([x.decode("utf-8", "replace") for x in data])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, data), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    ship(df.sparkSession)
    return keyed_bytes(df, key, text).mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
