"""Token groups, links and their counts against plain loops over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from siltstone.llm import tokenalign
from siltstone.llm.tokens import vocabulary_path

from ..conftest import DATA
from .test_llm import SIGNS

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [
    "", None, "a", " ", "  ", " lead", "trail ", "two  spaces", "a \n b", "\n", "x\n\ny z", "<|endoftext|> hi", "<s> a </s> <unk> <0x0A>", "▁x", "w ▁", "日本語 テスト です", "½ ﬁ ² Ⅷ", "\x00 a\x00b", "été",
    "\U0001f468‍\U0001f469 family", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa " * 30, "nospace" * 700, "don't I'm  x", "tab\there", "a　b", "﻿bom", "the the the", "the cat and the dog",
]


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(vocabulary_path(A))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=vocabulary_path(B))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.back = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}

    def groups(self, text):
        """[(ids of A, ids of B), ...] or None."""
        if not text:
            return None
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        bytes_a = [bytes(self.back[c] for c in self.a.id_to_token(i)) for i in a]
        names = [self.b.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b, names, strict=True)]
        want = (" " + text).encode()
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            return None
        out, x, y, at, to = [], [], [], 0, 0
        a, b = list(zip(a, bytes_a, strict=True)), list(zip(b, bytes_b, strict=True))
        while a or b or x or y:
            if at == to and x and y:
                out.append((x, y))
                x, y = [], []
                if not a and not b:
                    break
            if at <= to:
                i, s = a.pop(0)
                x.append(i)
                at += len(s)
            else:
                i, s = b.pop(0)
                y.append(i)
                to += len(s)
        return out


def by_loops(rows):
    plain, held, links = Plain(), Counter(), []
    all_groups = [plain.groups(t) for _, t in rows]
    for groups in all_groups:
        links.append(Counter((x, y) for p, q in groups or () for x in p for y in q))
        held.update(links[-1].keys())
    top: dict = {}
    for (x, _), n in held.items():
        top[x] = max(n, top.get(x, 0))
    out = []
    for (i, _), groups, own in zip(rows, all_groups, links, strict=True):
        groups = groups or []
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append((
            -1 if i is None else i, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), sum(own.values()),
            sum(n for k, n in own.items() if held[k] == top[k[0]]), sum(n * held[k] for k, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out)


def answered(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.mark.parametrize("batch", [4 << 20, 1000])
def test_alignment(spark, monkeypatch, batch):
    monkeypatch.setattr(tokenalign, "BATCH", batch)
    rows = list(enumerate(ODD)) + [(None, "the cat and"), (1, "the dog"), (1, "the dog")] + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, batch int, pair string, held int")
    got = answered(tokenalign.alignment(df.repartition(3)))
    assert got == by_loops(rows)
    assert sum(g[1] == 0 for g in got) >= 4 and tokenalign.alignment(df.limit(0)).isEmpty()
    none = answered(tokenalign.alignment(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")))
    assert none == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_pieces_equal_whole_texts():
    rng, know, plain = random.Random(4), tokenalign.Aligner(vocabulary_path(A), vocabulary_path(B)), Plain()
    signs = [*SIGNS, "▁", "<0x0A>", "</s>", " the", " of", " été"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    got = know.texts(texts)
    for t, g in zip(texts, got, strict=True):
        want = plain.groups(t)
        if g is None or want is None:
            assert g is None and want is None, repr(t)
        else:
            assert ";".join(g[0].forms[n] for n in g[1]) == ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in want), repr(t)
    assert sum(1 for g in got if g is not None and g[0] is know.known) > 1000


def test_marks_of_added_tokens_are_plain_text():
    """The encoder of A gives the pieces of a text the ids of the whole text, also those that look like added tokens."""
    know, plain = tokenalign.Aligner(vocabulary_path(A), vocabulary_path(B)), Plain()
    texts = ["<|endoftext|>", "a <|endoftext|>b, c.d\ne", "(été),x! <|startoftext|>", "the the,the\nthe"]
    for t, g in zip(texts, know.texts(texts), strict=True):
        assert g is not None and g[0] is know.known
        assert know.known.counts[g[1]].sum(axis=0)[0] == len(plain.a.encode(" " + t, add_special_tokens=False).ids)
        assert ";".join(know.known.forms[n] for n in g[1]) == ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in plain.groups(t))


def test_long_groups(monkeypatch):
    """Groups are paired by their different ids where they are long."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 500), rng.integers(0, 7, 400)
    ends_a, ends_b = np.cumsum(np.r_[np.full(499, 2), 3]), np.cumsum(np.r_[1, np.full(398, 2), 204])
    ga, gb = tokenalign.components(ends_a, ends_b)
    assert ends_a[-1] == ends_b[-1] and ga.max() == gb.max() == len(set(ends_a.tolist()) & set(ends_b.tolist())) - 1
    sums = []
    for block in (1 << 30, 10):
        monkeypatch.setattr(tokenalign, "BLOCK", block)
        group, pair, times = tokenalign.grouped_links(a, b, ga, gb)
        c = Counter()
        for k in zip(group.tolist(), pair.tolist(), times.tolist(), strict=True):
            c[k[:2]] += k[2]
        sums.append(c)
    assert sums[0] == sums[1] and sum(sums[0].values()) == sum(int((ga == g).sum() * (gb == g).sum()) for g in range(ga.max() + 1))
