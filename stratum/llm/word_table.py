"""Ids of words, remembered by a worker: each distinct word is encoded once, and texts are put together from them.

A word of up to 16 bytes is its width, first and last 8 bytes, so no word is made a Python object unless it is new;
a hash of the three only finds it in sorted arrays (of about 40 bytes a word), and the three confirm it. Longer
words, and those whose hash another word has, are looked up by their bytes. All is emptied beyond a number of words,
and beyond a number of bytes of ids and of such longer words.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from stratum.llm.suffix_order import lengths, ranges, runs

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Most bytes of a word that its first and last 8 bytes give whole.
SHORT = 16
#: Bytes of ids and longer words that a table keeps from one call to the next.
HELD = 1 << 26


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


class WordTable:
    """learn maps new words (bytes) to their ids and a flag each."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[list[Sequence[int]], Sequence[bool]]], limit: int = 4_000_000):
        self.learn, self.limit = learn, limit
        self.clear()

    def clear(self) -> None:
        self.key, self.head, self.tail, self.width = *(np.empty(0, np.uint64) for _ in range(3)), np.empty(0, np.uint8)
        self.at, self.count, self.flag = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool)
        self.by_bytes: dict[bytes, tuple[int, int, bool]] = {}
        self.ids, self.used, self.held = np.empty(1 << 16, np.uint32), 0, 0

    def hashes(self, head: np.ndarray, tail: np.ndarray, width: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(mixed(head + width * ODD) + tail)

    def learned(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of new words lie, how many there are, and the flags."""
        found, flags = self.learn(words)
        count = np.fromiter(map(len, found), np.int32, len(found))
        new = np.fromiter((i for ids in found for i in ids), np.uint32, int(count.sum()))
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(new)] = new
        at = self.used + np.cumsum(count) - count
        self.used += len(new)
        return at, count, np.asarray(flags, bool)

    def rest(self, words: list[bytes]) -> tuple[list, list, list]:
        """The same of words that are looked up by their bytes."""
        known = self.by_bytes
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            self.held += sum(map(len, new))
            known.update(zip(new, zip(*(x.tolist() for x in self.learned(new)), strict=True), strict=True))
        return tuple(zip(*map(known.__getitem__, words), strict=True))

    def __call__(self, joined: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words joined[start[i]:end[i]] one after another, the number of ids of each word, and its flag."""
        if not len(start):
            return np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, bool)
        if len(self.key) + len(self.by_bytes) > self.limit or self.held + 4 * self.used > HELD:
            self.clear()
        padded = np.frombuffer(b"".join([bytes(8), joined, bytes(8)]), np.uint8)
        windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
        eight = lambda at: np.ascontiguousarray(windows[at]).view(np.uint64).ravel()
        width = (end - start).astype(np.uint64)
        short = width <= SHORT
        head, tail = eight(start + 8), np.where(width > 8, eight(end), np.uint64(0))
        cut = width < 8
        head[cut] &= (np.uint64(1) << width[cut] * np.uint64(8)) - np.uint64(1)
        key = self.hashes(head, tail, width)
        at, count, flag = np.empty(len(start), np.int64), np.empty(len(start), np.int64), np.empty(len(start), bool)
        own = short.nonzero()[0]
        while len(own):
            order = own[np.argsort(key[own])]
            first = runs(key[order])
            words = order[first]
            of = np.repeat(words, lengths(first, len(order)))
            differ = (head[order] != head[of]) | (tail[order] != tail[of]) | (width[order] != width[of])
            inside = np.minimum(np.searchsorted(self.key, key[words]), max(0, len(self.key) - 1))
            same = self.key[inside] == key[words] if len(self.key) else np.zeros(len(words), bool)
            there = inside[same]
            other = (self.head[there] != head[words[same]]) | (self.tail[there] != tail[words[same]]) | (self.width[there] != width[words[same]])
            if differ.any() or other.any():  # two words share a hash: the later one is looked up by its bytes
                short[order[differ]] = False
                short[own[np.isin(key[own], key[words[same][other]])]] = False
                own = short.nonzero()[0]
                continue
            some = words[~same]
            if len(some):
                new = self.learned([joined[a:b] for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)])
                where = np.searchsorted(self.key, key[some])
                for name, x in zip(("key", "head", "tail", "width", "at", "count", "flag"), (key[some], head[some], tail[some], width[some], *new), strict=True):
                    setattr(self, name, np.insert(getattr(self, name), where, x))
            slot = np.repeat(np.searchsorted(self.key, key[words]), lengths(first, len(order)))
            at[order], count[order], flag[order] = self.at[slot], self.count[slot], self.flag[slot]
            break
        if len(own) < len(start):
            long = (~short).nonzero()[0]
            at[long], count[long], flag[long] = self.rest([joined[a:b] for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)])
        return self.ids[ranges(at, count)], count, flag
