"""Texts of an Arrow batch as flat numpy arrays: words, hashes, groups.

The word classes in use are byte classes: every byte of a character beyond ASCII
belongs to a word. So words are found and hashed on the UTF-8 bytes of many texts at
once, without a Python object per word. Nothing here knows Spark.
"""

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
# Texts are worked on in groups of about so many bytes, which bounds the memory of a task.
CHUNK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit hash of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x + _U((seed + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA0761D6478BD642F))


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int, least: int = CHUNK_BYTES + 65536) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; `least` of them are kept for later."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, least)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


@cache
def _table(lower: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    return table


@cache
def _is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SPACES)] = True
    return table


class Texts:
    """Some texts, end to end, each followed by a line feed. Null counts as empty."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        _, offsets, data = texts.buffers()
        edge = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if n and data else np.empty(0, np.uint8)
        edge = edge - edge[0] if n else np.zeros(1, np.int64)
        self.n = n
        self.begin = edge[:-1] + np.arange(n)
        self.end = edge[1:] + np.arange(n)
        raw = np.full(len(data) + n, 10, np.uint8)
        body = np.ones(len(raw), bool)
        body[self.end] = False
        raw[body] = data
        self.raw = _table(lower)[raw] if lower else raw

    def words(self) -> "Words":
        return Words(self)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text have the flag; flags is one per byte of raw."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.end] - total[self.begin]

    def span_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span."""
        up, down = _power_tables(len(self.raw) + 1)
        terms = _byte_values()[self.raw] * up[:-1]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        sums = (total[end] - total[start]) * down[start]
        return mix(sums + (end - start).astype(np.uint64) * _U(0x2545F4914F6CDD1D))


class Words:
    """The words of `texts`: byte spans, and the range of words of each text."""

    def __init__(self, texts: Texts):
        self.texts = texts
        inside = np.concatenate(([False], ~_is_space()[texts.raw], [False]))
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = turns[::2], turns[1::2]
        self.first = np.searchsorted(self.start, np.append(texts.begin, len(texts.raw)))
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(texts.n), self.count)

    def hashes(self) -> np.ndarray:
        return self.texts.span_hashes(self.start, self.end)


def row_chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK_BYTES; a longer text makes a range of its own."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64)
    at, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > CHUNK_BYTES:
            yield at, i
            at, held = i, 0
        held += size
    if at < len(sizes):
        yield at, len(sizes)


def order_by_text(text: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Puts equal (text, value) pairs side by side, texts in order.

    One key of 64 bits is sorted: the text number and as much of the hash as fits.
    """
    bits = int(text[-1]).bit_length() if len(text) else 0
    return np.argsort(text.astype(np.uint64) << _U(64 - bits) | values >> _U(bits)) if bits else np.argsort(values)


def distinct_by_text(text: np.ndarray, values: np.ndarray):
    """Distinct (text, value) pairs, by text and hash, with how often each occurs.

    `text` has to be in order."""
    if not len(values):
        return text, values, np.zeros(0, np.int64)
    order = order_by_text(text, values)
    t, v = text[order], values[order]
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (v[1:] != v[:-1])))
    at = np.flatnonzero(new)
    return t[at], v[at], np.diff(np.append(at, len(t)))


def sums_by(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Wrapping sums of unsigned values by a sorted group number below n."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    edge = np.searchsorted(group, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]
