"""Secret scans: Aho-Corasick keywords first, anchored expressions only at their hits, then embedded checksums.

Cases: a null or empty text has no span and the hash of the empty string; repeated rows and rows with a null id each
give a row; long texts are scanned whole; an empty table gives no rows; extra columns are ignored. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import keyed_bytes, lean, per_document, ship

KINDS = ("assign", "access", "hex", "github", "npm", "bip32", "age")
BASE_KINDS = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
#: Expressions whose text carries its own checksum, tried only where their keyword was found.
CHECKED = {
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "bip32": re.compile(r"[xt]prv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"),
    "age": re.compile(r"AGE-SECRET-KEY-1[QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58}(?![A-Z0-9])"),
}
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "xprv": "bip32", "tprv": "bip32", "age-secret-key-1": "age",
}
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
#: Hexadecimal digits to h, any other byte to a dot: a run of MIN_HEX digits is then one substring search.
HEX_MAP = bytes(104 if chr(i) in "0123456789abcdef" else 46 for i in range(256))
HEX_RUN = b"h" * MIN_HEX


@cache
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        out.add_word(word, (len(word), kind))
    out.make_automaton()
    return out


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out.rjust(6, "0")


def base58_ok(text: str) -> bool:
    n = 0
    for c in text:
        n = n * 58 + BASE58.index(c)
    raw = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return len(raw) == 82 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_ok(text: str) -> bool:
    low = text.lower()
    split = low.rfind("1")
    prefix, values = low[:split], [BECH32.index(c) for c in low[split + 1 :]]
    check = 1
    for v in [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + values:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    return check == 1


def checksum_ok(kind: str, m: re.Match) -> bool:
    if kind in ("github", "npm"):
        return base62_crc(m[1]) == m[2]
    return base58_ok(m[0]) if kind == "bip32" else bech32_ok(m[0])


def find(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, in order of start, then of KINDS."""
    text = data.decode("utf-8", "replace")
    out, last = [], dict.fromkeys(KINDS, 0)
    low = data.lower().decode("utf-8", "replace")  # bytes.lower() changes A-Z only, so places stay
    for start, kind in sorted((end - n + 1, kind) for end, (n, kind) in automaton().iter(low)):
        if start < last[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(text, start)
            ok = m and len(m[2]) >= MIN_VALUE
        elif kind == "access":
            m = ACCESS.match(text, start)
            ok = m and len(m[0]) >= MIN_ACCESS
        else:
            m = CHECKED[kind].match(text, start)
            ok = m and checksum_ok(kind, m)
        if m:
            last[kind] = m.end()
            if ok:
                out.append((start, m.end(), kind))
    at, byte, place = (digits := data.translate(HEX_MAP)).find(HEX_RUN), 0, 0
    while at >= 0:
        m = HEX.match(data, at)
        # code points are counted from one span to the next; both begin at a digit, so no character is cut
        byte, place = at, place + (at - byte if text.isascii() else len(data[byte:at].decode("utf-8", "replace")))
        start = place
        out.append((start, start + m.end() - at, "hex"))
        at = digits.find(HEX_RUN, m.end())
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shown(spans: list[tuple[int, int, str]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans if k in kinds)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans string, n_assign, n_access, n_hex, n_checked, base_sha256) of each row of df."""

    def make():
        def one(data: bytes) -> tuple:
            spans = find(data)
            n = [sum(k == kind for _, _, k in spans) for kind in BASE_KINDS]
            return shown(spans), *n, len(spans) - sum(n), hashlib.sha256(shown(spans, BASE_KINDS).encode()).hexdigest()

        return one

    return per_document(keyed_bytes(df, key, text), make, "spans string, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string")


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every found span of its text replaced by mark (overlapping spans by one). Null texts stay null; other columns stay as they are."""
    ship(df.sparkSession)

    def one(t: str | None) -> str | None:
        spans = find(t.encode("utf-8", "replace")) if t else None
        if not spans:
            return t
        out, at = [], 0
        for a, b, _ in spans:
            if a >= at:
                out += [t[at:a], mark]
            at = max(at, b)
        return "".join([*out, t[at:]])

    @F.arrow_udf("string")
    def cleaned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lean(lambda some: (pa.array([one(t) for t in b.to_pylist()], pa.string()) for b in some))(batches)

    return df.withColumn(text, cleaned(F.col(f"`{text}`")))
