"""Vectorised word hashing: polynomial prefix sums give the hash of any byte span at once."""

from __future__ import annotations

import numpy as np

BASES = (0xD6E8FEB86659FD93, 0x9FB21C651E98DF25)
_U = np.uint64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def _tables(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        _powers[base] = tuple(np.concatenate([np.ones(1, _U), np.cumprod(np.full(size - 1, x, _U))]) for x in (base, pow(base, -1, 1 << 64)))
    return _powers[base]


class Spans:
    """Hashes of spans of a buffer; those of two bases are independent."""

    def __init__(self, buf: np.ndarray, base: int = BASES[0]):
        p, self.inv = _tables(len(buf) + 1, base)
        self.sums = np.zeros(len(buf) + 1, _U)
        values = _VALUE if base == BASES[0] else _VALUE[::-1]
        np.cumsum(values[buf] * p[: len(buf)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inv[start]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end))


def raw_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 20, base: int = BASES[0]) -> np.ndarray:
    """Spans.raw of spans in order, about step bytes of the buffer at a time, so that long texts need little memory."""
    out, k = np.empty(len(start), _U), 0
    while k < len(start):
        first = int(start[k])
        j = max(k + 1, int(np.searchsorted(start, first + step)))
        out[k:j] = Spans(buf[first : int(end[j - 1])], base).raw(start[k:j] - first, end[k:j] - first)
        k = j
    return out


def run_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of runs h[start:end] of hashes, in their order."""
    p, inv = _tables(len(h) + 1, base)
    sums = np.zeros(len(h) + 1, _U)
    np.cumsum(h * p[: len(h)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(_U))


def word_table(is_word) -> np.ndarray:
    return np.array([bool(is_word(c)) for c in range(256)])


#: Words of letters, digits and everything beyond ASCII: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of lower-cased text.
LETTERS = word_table(lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128)
#: Words between white space: [^\\x20\\x09-\\x0D]+.
SOLID = word_table(lambda c: not (c == 32 or 9 <= c <= 13))


def words(texts: list[str | None], table: np.ndarray, sep: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts, one after another, and where each text's words begin and the last end.

    sep is a byte that no word holds."""
    parts = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    buf = np.frombuffer(sep + sep.join(parts) + sep, np.uint8)
    inside = table[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    at = np.cumsum([1] + [len(p) + 1 for p in parts])
    bounds = np.searchsorted(start, at)
    return mix(raw_spans(buf, start, end)), bounds
