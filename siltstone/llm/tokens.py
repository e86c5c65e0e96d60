"""Byte-pair encoding of whole texts with a cache of space-delimited pieces."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

STEP = 8 << 20  # bytes of text whose pieces are looked up at once

_LOADED: dict[tuple[str, bool], PieceEncoder] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str, spaces_matter: bool) -> PieceEncoder:
    """One encoder for each worker process; name is a file of the tokenizers folder or a path."""
    key = (name, spaces_matter)
    if key not in _LOADED:
        _LOADED[key] = PieceEncoder(name if os.path.sep in name else vocabulary_path(name), spaces_matter)
    return _LOADED[key]


def encoded(batches: Iterable[pa.RecordBatch], vocabulary: str, spaces_matter: bool) -> Iterator[tuple[int | None, bytes]]:
    """doc_id and ids of each row of batches(doc_id, text), about ``STEP`` bytes of text at a time; a null text is empty."""
    enc = encoder(vocabulary, spaces_matter)
    for b in batches:
        doc_id, text = (b.column(b.schema.get_field_index(n)) for n in ("doc_id", "text"))
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            done = int(ends[at - 1]) if at else 0
            n = max(1, int(np.searchsorted(ends, done + STEP, "right")) - at)
            yield from zip(doc_id.slice(at, n).to_pylist(), enc.batch(text.slice(at, n)), strict=True)
            at += n


_LETTER, _MARK, _SPACE, _BREAK, _WHITE = 1, 2, 4, 8, 16
_WORD, _MARKS = "[A-Za-zÀ-ÖØ-öø-į]+", ".,!?;:%&*$#|()"
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[list(_MARKS.encode())] = _MARK
_KIND[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = _WHITE
_KIND[10] |= _BREAK
_KIND[32] |= _SPACE


def _cuts(data: np.ndarray) -> np.ndarray:
    """Where UTF-8 may be cut: a flag for each byte that can begin a piece.

    Before a space behind what is no white space, between a letter and a mark, and on both
    sides of a line break that stands alone between letters or marks."""
    kind, cut = _KIND[data], np.zeros(len(data), bool)
    if len(data) < 2:
        return cut
    high = np.flatnonzero((data[:-1] == 0xC3) | (data[:-1] == 0xC4))  # the letters of _WORD beyond ASCII
    second = data[high + 1]
    high = high[np.where(data[high] == 0xC3, (second != 0x97) & (second != 0xB7), second <= 0xAF)]
    kind[high] = kind[high + 1] = _LETTER
    before, after = kind[:-1], kind[1:]
    cut[1:] = ((before | after) & (_LETTER | _MARK)) == (_LETTER | _MARK)
    spaces = np.flatnonzero((after & _SPACE > 0) & (before & _WHITE == 0)) + 1
    other = data[spaces - 1] >= 0x80
    if other.any():
        z, y, x = (data[np.maximum(spaces - k, 0)] for k in (1, 2, 3))
        white = (y == 0xC2) & ((z == 0x85) | (z == 0xA0)) | (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
        white |= (x == 0xE2) & ((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)) | (y == 0x81) & (z == 0x9F))
        spaces = spaces[~(other & white)]
    cut[spaces] = True
    breaks = np.flatnonzero(kind[1:-1] & _BREAK) + 1
    breaks = breaks[(kind[breaks - 1] & (_LETTER | _MARK) > 0) & (kind[breaks + 1] & (_LETTER | _MARK) > 0)]
    cut[breaks] = cut[breaks + 1] = True
    return cut


class PieceEncoder:
    """ids of a text = ids of its pieces, one after another; pieces are cached.

    The pre-tokenizers of both vocabularies never join what ``_cuts`` parts (a space goes with
    the piece that follows; the word level drops it). The pieces of a batch of texts are
    numbered by Arrow, and each different one is looked up or encoded once. Texts that hold
    the mark of an added token (``<|endoftext|>`` and the like), which the tokenizer takes out
    before anything else and gives its own id, are encoded whole.
    ids are little-endian unsigned integers of itemsize bytes.
    """

    CACHE = 400_000  # pieces, of about 200 bytes each; bounds the memory of a worker
    LONG = 64  # signs; longer pieces aren't kept

    def __init__(self, path: str, spaces_matter: bool):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.spaces_matter = spaces_matter
        self.itemsize = 2 if self.tok.get_vocab_size() <= 65536 else 4
        self.cache: dict[str, bytes] = {}
        marks = [re.escape(t.content.encode()) for t in self.tok.get_added_tokens_decoder().values()]
        self.apart = re.compile(b"|".join(marks) or rb"(?!)", re.I)
        self.plain = re.compile(rf" ?(?:{_WORD}|[{_MARKS}]+)\Z")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}  # byte-level alphabet

    def whole(self, text: str) -> bytes:
        return self._bytes(self.tok.encode(text, add_special_tokens=False).ids)

    def _bytes(self, ids: list[int]) -> bytes:
        return array("H" if self.itemsize == 2 else "I", ids).tobytes()

    def _one(self, word: str) -> list[int]:
        if word.isascii():  # letters and marks stand for themselves
            word = word.replace(" ", self.letters[32])
        else:
            word = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(word)]

    def _learn(self, missing: list[str]) -> list[bytes]:
        got: list[bytes] = [b""] * len(missing)
        rest = []
        for k, p in enumerate(missing):
            q = p if self.spaces_matter else p.lower()
            if self.plain.match(q):
                got[k] = self._bytes(self._one(q if self.spaces_matter else q.lstrip(" ")))
            else:
                rest.append(k)
        for at in range(0, len(rest), 2000):
            part = rest[at : at + 2000]
            ids: list[list[int]] = [[] for _ in part]
            enc = self.tok.encode([missing[k] for k in part], is_pretokenized=True, add_special_tokens=False)
            for w, i in zip(enc.word_ids, enc.ids, strict=True):
                ids[w].append(i)
            for k, x in zip(part, ids, strict=True):
                got[k] = self._bytes(x)
        return got

    def batch(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()), "")
        if not len(texts):
            return []
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        cut = _cuts(data)
        cut[ends[:-1][ends[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        names = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.cache.get, names))
        missing = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(missing, self._learn([names[k] for k in missing]), strict=True):
            ids[k] = x
            if len(self.cache) < self.CACHE and len(names[k]) <= self.LONG:
                self.cache[names[k]] = x
        laid = pa.array(ids, pa.large_binary()).take(found.indices)
        if len(laid):
            places = np.frombuffer(laid.buffers()[1], np.int64)[laid.offset : laid.offset + len(laid) + 1]
            places = places[np.searchsorted(starts, ends)].tolist()
        else:
            places = [0] * len(ends)
        held = memoryview(laid.buffers()[2] or b"")
        out = [bytes(held[a:b]) for a, b in zip(places, places[1:])]
        for m in self.apart.finditer(data):
            for k in range(int(np.searchsorted(ends, m.start(), "right")) - 1, int(np.searchsorted(ends, m.end() - 1, "right"))):
                out[k] = self.whole(texts[k].as_py())
        return out
