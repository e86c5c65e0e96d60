"""Main text of web pages by a recurrent block labeller.

A page is read as a sequence of leaf blocks: text between block-level tags, without scripts,
styles and comments of the markup. Each block becomes a vector: hashed tags, classes and
identifiers of its whole path (each distinct name once, however far up), hashed words, its share of
link text, its length, its punctuation, and what share of the page's text stands in its element and the three around
it. A bidirectional LSTM in numpy reads the sequence, so a block
is labelled in the light of what stands before and behind it; a logistic unit says whether it
belongs to the article. A page beyond ``STRETCH`` blocks is read in stretches of that length that
overlap by twice ``MARGIN``; each block's label comes from the stretch in which it lies further inside.

The labeller is trained on the driver on ``SAMPLE`` stretches of at most ``TRAIN_BLOCKS`` blocks, cut from
all parts of at most ``SAMPLE`` different pages (those with the smallest hash of their html; of their
stretches those with the smallest hash); executors turn them into vectors, so that the driver's memory doesn't depend
on the length of pages. Labels of the page itself come from the meaning of tags and class names (``taught``). That alone would
teach names only, so ``COPIES`` of each stretch are written as new pages whose labels are known from how they are made
(``_rewritten``): the article in other containers and elements, boxes of many names within and around it, and, in a third of
them, all names and telling tags replaced by such as say nothing, so that text and place must tell.
Extraction reads whole pages and labels every block.

Elements are nodes that point at their parent and share its vector unless they add a name to it, so deep nesting costs a
small node for each element.

Defined results: null or empty html has an empty text; broken markup is read as far as it goes (a
tag that the end cuts off is dropped, an incomplete character reference stays as text);
pages that repeat are answered each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, rows
from .texthash import SOLID, words

SAMPLE, TRAIN_BLOCKS, HIDDEN, EPOCHS, STRETCH, MARGIN, DROP, DECAY = 192, 160, 24, 16, 2048, 128, 0.1, 0.01
PATH_DIM, WORD_DIM, OTHER_DIM, COPIES = 160, 16, 9, 8
INPUT = PATH_DIM + WORD_DIM + OTHER_DIM

#: Names of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template svg iframe object".split())
CLOSES_ITSELF = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
BOILER_TAGS = frozenset("nav footer aside form menu dialog button select textarea label title head".split())
BOILER_NAME = re.compile(
    r"(?:^|[-_.#])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|copyright|disqus|footer|gdpr|legal|login|masthead|menu|modal|nav\w*|newsletter|notices?|popup|promo\w*|related|repl(?:y|ies)|respond|search|share|shar\w*|sidebar|side|signup|social|sponsor\w*|subscribe|tags?|toolbar|widgets?)(?:$|[-_])"
)
MAIN_NAME = re.compile(r"(?:^|[-_.#])(?:article|content|entry|main|post|story|body)(?:$|[-_])")

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*|[^>]*)(?:>|\Z))", re.S)
_NAME = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I | re.S)



def _add(x: np.ndarray, name: str) -> None:
    """Adds a name to two places of x, so that names that share one can be told apart by the other."""
    h = int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    x[h % PATH_DIM] += 1.0 if h >> 40 & 1 else -1.0
    x[(h >> 16) % PATH_DIM] += 1.0 if h >> 41 & 1 else -1.0


def _parts(n: str) -> tuple[str, ...]:
    return (n, *(re.split("[-_]+", n[1:]) if n[0] in ".#" else ()))


_NONE = np.zeros(PATH_DIM, np.float32)


class Path:
    """An element below its parent: its names, the hashed names of the whole way, what the names mean, and how much text it holds.

    ``held`` counts the names of a way down; ``page`` is a list with the length of the page's text."""

    __slots__ = ("boiler", "inside", "main_name", "main_tag", "names", "page", "text", "up", "whole")

    def __init__(self, up: Path | None, names: tuple[str, ...], held: dict[str, int], page: list[int]):
        self.up, self.names, self.page, self.text = up, names, page, 0
        self.whole = up.whole if up else _NONE
        self.boiler, self.inside = (up.boiler, up.inside) if up else (False, False)
        self.main_tag, self.main_name = (up.main_tag, up.main_name) if up else (False, False)
        for n in names:
            for part in _parts(n):
                if not held.get(part):
                    if self.whole is (up.whole if up else _NONE):
                        self.whole = self.whole.copy()
                    _add(self.whole, part)
                held[part] = held.get(part, 0) + 1
            main = n in ("article", "main", "@main")
            self.inside |= main
            self.main_tag |= main
            named = n[0] in ".#"
            self.main_name |= bool(named and MAIN_NAME.search(n))
            self.boiler |= n in BOILER_TAGS or (n == "header" and not self.inside) or n in ("@navigation", "@banner", "@contentinfo", "@complementary", "@search") or bool(named and BOILER_NAME.search(n))

    def shares(self) -> list[float]:
        """What share of the page's text, links left out, this element and the three around it hold."""
        out, p = [], self
        for _ in range(4):
            out.append(p.text / max(1, self.page[0]))
            p = p.up or p
        return out


Block = tuple  # path (None outside all elements), tag, text, share of link text


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order; their text is decoded and its white space folded."""
    out: list[Block] = []
    stack: list[tuple[str, Path, int]] = []
    held: dict[str, int] = {}
    same: dict[tuple[str, ...], tuple[str, ...]] = {}  # equal names are one object
    page_text = [0]
    deep: dict[str, list[int]] = {}  # of each tag the places in the stack
    text: list[str] = []
    linked = link = at = 0

    def close():
        nonlocal linked
        if text:
            whole = " ".join(_html.unescape("".join(text)).split())
            if whole:
                share = min(1.0, linked / len(whole))
                out.append((stack[-1][1] if stack else None, stack[-1][0] if stack else "", whole, share))
                page_text[0] += round(len(whole) * (1 - share))
            text.clear()
        linked = 0

    def cut(k: int):
        while len(stack) > k:
            tag, path, before = stack.pop()
            path.text = page_text[0] - before
            deep[tag].pop()
            for n in path.names:
                for part in _parts(n):
                    held[part] -= 1

    def pop(tags: tuple, below: frozenset = frozenset()):
        at = max((deep[t][-1] for t in tags if deep.get(t)), default=-1)
        if at >= 0 and not any(deep.get(t) and deep[t][-1] > at for t in below):
            close()
            cut(at)

    ends: dict[str, re.Pattern] = {}
    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        end = m.start() if m else size
        if end > at:
            piece = page[at:end]
            text.append(piece)
            if link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW_TAGS:
            if not m[1] and not (tag == "svg" and m[3].endswith("/")):  # only markup of other languages closes itself
                if tag not in ends:
                    ends[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I)
                e = ends[tag].search(page, at)
                at = e.end() if e else size
            continue
        if tag == "a":
            link = 0 if m[1] else 1
        if tag == "br":
            text.append(" ")
        if tag not in BLOCK_TAGS:
            continue
        if m[1]:
            if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                close()
            pop((tag,))
            continue
        close()
        if tag in VOID_TAGS:
            continue
        link = 0
        if stack and stack[-1][0] == "p":
            cut(len(stack) - 1)
        if tag in CLOSES_ITSELF:
            pop(tuple(CLOSES_ITSELF[tag].split()), frozenset(("ul", "ol", "dl", "table", "select")))
        names = [tag]
        if m[3]:
            for kind, a, b, c in _NAME.findall(m[3]):
                mark = {"class": ".", "id": "#", "role": "@"}[kind.lower()]
                names += [mark + x for x in (a or b or c).lower().split()]
        deep.setdefault(tag, []).append(len(stack))
        own = same.setdefault(tuple(names), tuple(names))
        stack.append((tag, Path(stack[-1][1] if stack else None, own, held, page_text), page_text[0]))
    close()
    cut(0)
    return out


def taught(blocks: list[Block]) -> list[bool]:
    """Labels from the meaning of tags and names, for training."""
    good = [p is None or not p.boiler for p, *_ in blocks]
    for test in (lambda p: p.main_tag, lambda p: p.main_name):
        inside = [g and p is not None and test(p) for g, (p, *_) in zip(good, blocks, strict=True)]
        if any(inside):
            return inside
    return good


def vectors(blocks: list[Block]) -> np.ndarray:
    """A row for each block."""
    x = np.zeros((len(blocks), INPUT), np.float32)
    if not blocks:
        return x
    for k, (path, _, text, link) in enumerate(blocks):
        if path is not None:
            x[k, :PATH_DIM] = path.whole
            for name in path.names:
                _add(x[k, :PATH_DIM], "leaf" + name)
            x[k, -9:-5] = path.shares()
        n = len(text)
        x[k, -5:] = (link, min(1.0, n / 400), np.log1p(n) / 8, (text.count(".") + text.count(",")) / n, text[-1] in ".!?:;")
    # many names on a way count by their square root, so that deep pages stay in the range that training has seen
    length = np.abs(x[:, :PATH_DIM]).sum(1, keepdims=True)
    x[:, :PATH_DIM] *= np.sqrt(24 / np.maximum(length, 24))
    h, at = words([t for *_, t, _ in blocks], SOLID, b" ")
    slot = (h >> np.uint64(40)).astype(np.int64)
    sign = np.where(slot & 1 << 20, 1.0, -1.0)
    row = np.repeat(np.arange(len(blocks)), np.diff(at))
    bag = np.bincount(row * WORD_DIM + slot % WORD_DIM, sign, len(blocks) * WORD_DIM).reshape(-1, WORD_DIM)
    x[:, PATH_DIM : PATH_DIM + WORD_DIM] = bag / np.sqrt(np.maximum(1, np.diff(at)))[:, None]
    return x


class BiLSTM:
    """Two LSTMs, one from each end, and a logistic unit on both states and the block itself."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"{d}w"] = rng.standard_normal((INPUT + HIDDEN, 4 * HIDDEN)).astype(np.float32) * (1 / np.sqrt(INPUT + HIDDEN))
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p[f"{d}b"] = bias
        self.p["ow"] = rng.standard_normal((2 * HIDDEN + INPUT, 1)).astype(np.float32) * 0.2
        self.p["ob"] = np.zeros(1, np.float32)

    @staticmethod
    def _gate(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None):
        """x: time x pages x INPUT; mask: time x pages x 1. Returns time x pages x HIDDEN."""
        w, b, h_ = self.p[f"{d}w"], self.p[f"{d}b"], HIDDEN
        pre = x @ w[:INPUT] + b
        h = np.zeros((x.shape[1], h_), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((*x.shape[:2], h_), np.float32)
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        for t in steps:
            z = pre[t] + h @ w[INPUT:]
            s = self._gate(z[:, : 3 * h_])
            i, f, o, g = s[:, :h_], s[:, h_ : 2 * h_], s[:, 2 * h_ :], np.tanh(z[:, 3 * h_ :])
            m = mask[t]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            c = m * new + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            out[t] = h
        return out

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([*(self._run(x, mask, d, None) for d in "fb"), x], 2)
        return self._gate(both @ self.p["ow"] + self.p["ob"])[..., 0]

    def learn(self, x, mask, y, state: dict, rate: float) -> None:
        """A step of Adam on the mean cross-entropy."""
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([*(self._run(x, mask, d, kept[d]) for d in "fb"), x], 2)
        p = self._gate(both @ self.p["ow"] + self.p["ob"])
        dz = (p - y[..., None]) * mask / max(1.0, float(mask.sum()))
        grad = {"ow": both.reshape(-1, 2 * HIDDEN + INPUT).T @ dz.reshape(-1, 1), "ob": dz.sum((0, 1))}
        back = dz @ self.p["ow"].T
        for n, d in enumerate("fb"):
            w = self.p[f"{d}w"]
            own = back[..., n * HIDDEN : (n + 1) * HIDDEN]
            gw, gb = np.zeros_like(w), np.zeros_like(self.p[f"{d}b"])
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for t, h, c, i, f, o, g, tc, m in reversed(kept[d]):
                dh = dh + own[t]
                do, dn = dh * m * tc, dh * m * o * (1 - tc * tc) + dc * m
                dz_ = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), do * o * (1 - o), dn * i * (1 - g * g)], 1)
                gw[:INPUT] += x[t].T @ dz_
                gw[INPUT:] += h.T @ dz_
                gb += dz_.sum(0)
                dh = dh * (1 - m) + dz_ @ w[INPUT:].T
                dc = dc * (1 - m) + dn * f
            grad[f"{d}w"], grad[f"{d}b"] = gw, gb
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        state["n"] = n = state.get("n", 0) + 1
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m, v = state.get(k, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            state[k] = m, v
            self.p[k] = (self.p[k] - rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8) - rate * DECAY * self.p[k]).astype(np.float32)


def padded(x: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((max(sizes), len(sizes), x.shape[1]), np.float32)
    mask = np.zeros((max(sizes), len(sizes), 1), np.float32)
    at = 0
    for k, n in enumerate(sizes):
        out[:n, k], mask[:n, k] = x[at : at + n], 1
        at += n
    return out, mask


#: Elements of articles and containers around them, and names of what surrounds or interrupts them, for the pages that are written for training.
_HOMES = ["article", "main", "main article", "div.content", "div#content", "section.post", "div.entry-content", "div.story-body", "div.article-body", "div#main div.post-content", "div.post-body", "div#page div.entry"]
_LEAVES = ["h1", "h2", "h3", "p", "p", "ul li", "ol li", "table tr td", "table tbody tr th", "dl dt", "dl dd", "blockquote", "blockquote p", "pre", "pre code", "figure figcaption", "section p", "section h2", "div", "div p"]
_BOXES = (
    "ad ads advert advertisement ad-slot sponsored sponsored-links promo banner related share social sidebar comments comment comment-list disqus_thread replies newsletter subscribe cookie-notice cookies consent notice popup modal menu "
    "nav navbar breadcrumbs site-footer footer site-header header masthead copyright widget login search tags toolbar"
).split()
_BOX_TAGS = ["div", "div", "div", "section", "aside", "ul", "form", "nav", "footer", "header", "ol"]
_BOX_LEAVES = ["p", "p", "", "li", "h2", "h3", "label", "div", "div p", "ul li"]
_PLAIN = {t: "div" for t in ("article", "main", "nav", "header", "footer", "aside", "section", "form", "menu", "dialog")}


class Page:
    """Markup in the making, with a label for each block that it will give."""

    def __init__(self, rng, plain: bool):
        self.rng, self.plain, self.out, self.labels = rng, plain, [], []
        self.names: dict[str, str] = {}

    def open(self, way: str) -> list[str]:
        """Opens elements like ``div.a section#b``; their tags, for closing."""
        tags = []
        for step in way.split():
            tag, sign, name = *re.match(r"(\w+)([.#]?)", step).groups(), re.sub(r"^\w+[.#]?", "", step)
            if self.plain:  # one name that says nothing for each that does
                tag = _PLAIN.get(tag, tag)
                name = self.names.setdefault(name, f"{'abcdefgh'[self.rng.integers(8)]}{self.rng.integers(99)}") if name else ""
            mark = {".": f" class={name}", "#": f" id={name}"}.get(sign, "") if name else ""
            self.out.append(f"<{tag}{mark}>")
            tags.append(tag)
        return tags

    def shut(self, tags: list[str]) -> None:
        self.out += [f"</{t}>" for t in reversed(tags)]

    def leaf(self, way: str, text: str, link: bool, label: bool) -> None:
        tags = self.open(way) if way else []
        text = _html.escape(text)
        self.out.append(f"<a href=x>{text}</a>" if link else text)
        self.shut(tags)
        self.labels.append(label)


def _rewritten(blocks: list[Block], labels: list[bool], rng) -> tuple[list[Block], list[bool]]:
    """A page of the same texts with other elements and boxes. What isn't the article's comes from the page's own such texts, or from any words."""
    page = Page(rng, rng.random() < 1 / 3)
    other = [t for (*_, t, _), y in zip(blocks, labels, strict=True) if not y]
    texts = [t for *_, t, _ in blocks]

    def words_of(some: list[str]) -> str:
        return " ".join(some[rng.integers(len(some))].split()[: int(rng.choice([2, 6, 15, 60]))]) or "more"

    def box(inside: bool) -> None:
        """Some blocks in a box; within a plain page's article there is none, since nothing would tell it."""
        if inside and page.plain:
            return
        tag, name = _BOX_TAGS[rng.integers(len(_BOX_TAGS))], _BOXES[rng.integers(len(_BOXES))]
        own = tag if not inside and tag in ("aside", "form", "nav", "footer", "header") and rng.random() < 0.4 else f"{tag}{'.#'[rng.integers(2)]}{name}"
        leaf = "li" if tag in ("ul", "ol") else _BOX_LEAVES[rng.integers(len(_BOX_LEAVES))]
        linked = leaf.endswith("li") and rng.random() < 0.7
        tags = page.open(own + " div" * int(rng.integers(0, 3)) if tag not in ("ul", "ol") else own)
        for k in range(int(rng.integers(1, 6 if leaf.endswith("li") else 3))):
            some = other if other and (page.plain or rng.random() < 0.5) else texts
            page.leaf(leaf or ("p" if k else ""), words_of(some) if not linked else " ".join(words_of(some).split()[:3]), linked, False)
        page.shut(tags)

    wrap = page.open("body" + "".join(f" div.{'abcdefgh'[rng.integers(8)]}{rng.integers(100)}" for _ in range(rng.integers(0, 4))))
    for _ in range(rng.integers(0, 4)):
        box(False)
    first = labels.index(True)
    last = len(labels) - labels[::-1].index(True)
    home: list[str] = []
    for k, ((path, tag, text, link), y) in enumerate(zip(blocks, labels, strict=True)):
        if k == first:
            home = page.open(_HOMES[rng.integers(len(_HOMES))] + " div" * int(rng.choice([0, 0, 1, 3])))
        if y:
            usual = tag if tag in ("p", "h1", "h2", "h3", "li", "td", "th", "dt", "dd", "pre", "blockquote") and rng.random() < 0.5 else _LEAVES[rng.integers(len(_LEAVES))]
            way = {"li": "ul li", "td": "table tr td", "th": "table tr th", "dt": "dl dt", "dd": "dl dd"}.get(usual, usual)
            if way.split()[-1] in ("li", "td", "th", "dt") and rng.random() < 0.6:  # lists and tables of an article have short parts too
                *outer, leaf = way.split()
                tags = page.open(" ".join(outer))
                for _ in range(int(rng.integers(1, 5))):
                    page.leaf(leaf, " ".join(words_of(texts).split()[: int(rng.integers(1, 6))]), False, True)
                page.shut(tags)
            else:
                page.leaf(way, text, link > 0.5, True)
            if rng.random() < 0.3:
                box(True)
        elif not first <= k < last and not page.plain:
            named = (n for p in _ups(path) for n in p.names if n[0] in ".#" and re.fullmatch(r"[\w-]+", n[1:]) and BOILER_NAME.search(n))
            page.leaf(f"div{next(named, '.' + _BOXES[rng.integers(len(_BOXES))])} p", text, link > 0.5, False)
        if k == last - 1:
            if rng.random() < 0.4:
                box(True)
            page.shut(home)
    for _ in range(rng.integers(0, 4)):
        box(False)
    page.shut(wrap)
    return blocks_of("".join(page.out)), page.labels


def _ups(path: Path | None):
    while path is not None:
        yield path
        path = path.up


Lesson = tuple  # vectors of a stretch of blocks, their labels


def lessons_of(page: str, seed: int = 5) -> list[list[Lesson]]:
    """The stretches of a page, each with pages written from it, as vectors and labels."""
    blocks = blocks_of(page)
    labels, out = taught(blocks), []
    rng = np.random.default_rng([seed, zlib.crc32(page.encode("utf-8", "surrogatepass"))])
    for at in range(0, len(blocks), TRAIN_BLOCKS):
        b, y = blocks[at : at + TRAIN_BLOCKS], labels[at : at + TRAIN_BLOCKS]
        some = [(b, y)] + ([_rewritten(b, y, rng) for _ in range(COPIES)] if any(y) else [])
        out.append([(vectors(bs), np.array(ys, bool)) for bs, ys in some if len(bs) == len(ys)])
    return out


def train_labeller(lessons: list[Lesson], epochs: int = EPOCHS, seed: int = 5) -> BiLSTM:
    rng = np.random.default_rng(seed)
    net, state = BiLSTM(seed), {}
    data = sorted((d for d in lessons if len(d[0])), key=lambda d: len(d[0]))
    ready = []
    for group in (data[k : k + 24] for k in range(0, len(data), 24)):
        x, mask = padded(np.concatenate([v for v, _ in group]), [len(v) for v, _ in group])
        y = np.zeros(mask.shape[:2], np.float32)
        for k, (_, ls) in enumerate(group):
            y[: len(ls), k] = ls
        ready.append((x, mask, y))
    for e in range(epochs):
        for k in rng.permutation(len(ready)):
            x, mask, y = ready[k]
            seen = rng.random((*x.shape[:2], INPUT), np.float32) >= DROP  # no single name or word may decide
            net.learn(x * seen / (1 - DROP), mask, y, state, 0.02 * 0.85**e)
    return net


def _stretches(n: int) -> list[tuple[int, int, int, int]]:
    """(begin, end, from, to): blocks begin..end are read together and tell the labels of from..to."""
    if n <= STRETCH:
        return [(0, n, 0, n)]
    step = STRETCH - 2 * MARGIN
    out = []
    for at in range(0, n - 2 * MARGIN, step):
        end = min(n, at + STRETCH)
        out.append((at, end, at + MARGIN if at else 0, end if end == n else end - MARGIN))
        if end == n:
            break
    return out


def label_pages(blocks: list[list[Block]], net: BiLSTM) -> list[np.ndarray]:
    """For each page the probability of each block that it belongs to the article.

    Stretches of similar length are read together; a group times its longest stretch is bounded."""
    out = [np.zeros(len(b), np.float32) for b in blocks]
    jobs = sorted(((k, *s) for k, b in enumerate(blocks) if b for s in _stretches(len(b))), key=lambda j: j[2] - j[1])
    at = 0
    while at < len(jobs):
        end = at + 1
        while end < len(jobs) and (end + 1 - at) * (jobs[end][2] - jobs[end][1]) <= 2 * STRETCH:
            end += 1
        group = jobs[at:end]
        at = end
        flat = [x for k, a, b, *_ in group for x in blocks[k][a:b]]
        p = net.predict(*padded(vectors(flat), [b - a for _, a, b, *_ in group]))
        for col, (k, a, _, lo, hi) in enumerate(group):
            out[k][lo:hi] = p[lo - a : hi - a, col]
    return out


def extract(pages: list[str | None], net: BiLSTM) -> list[str]:
    """Texts of pages: the blocks that the labeller takes for the article, joined by empty lines."""
    blocks = [blocks_of(p or "") for p in pages]
    return ["\n\n".join(t for (*_, t, _), q in zip(b, p, strict=True) if q >= 0.5) for b, p in zip(blocks, label_pages(blocks, net), strict=True)]


def train_on(pages: DataFrame) -> BiLSTM:
    """A labeller from the sample of ``pages(html)``; a stretch comes to the driver as a few tens of KB of half floats."""
    html = F.col("html").cast("string")
    hashed = pages.where("html is not null").select(F.xxhash64(html).alias("h"), html.alias("html"))
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(SAMPLE).collect()]
    if not least:
        return train_labeller([])
    some = hashed.where(F.col("h") <= least[-1]).groupBy("h").agg(F.min("html").alias("html"))

    def teach(batches):
        for h, page in rows(batches, "h", "html"):
            for n, stretch in enumerate(lessons_of(page)):
                x = [v.astype(np.float16).tobytes() for v, _ in stretch]
                y = [np.packbits(ls).tobytes() for _, ls in stretch]
                yield pa.record_batch([pa.array([h]), pa.array([n]), pa.array([x], pa.list_(pa.binary())), pa.array([y], pa.list_(pa.binary()))], names=["h", "n", "x", "y"])

    taken = some.mapInArrow(teach, "h long, n long, x array<binary>, y array<binary>").orderBy(F.xxhash64("h", "n"), "h", "n").limit(SAMPLE).collect()
    lessons = []
    for r in taken:
        for x, y in zip(r.x, r.y, strict=True):
            v = np.frombuffer(x, np.float16).reshape(-1, INPUT).astype(np.float32)
            lessons.append((v, np.unpackbits(np.frombuffer(y, np.uint8))[: len(v)].astype(bool)))
    return train_labeller(lessons)


def main_text(pages: DataFrame) -> DataFrame:
    """For each row of ``pages(page_id, url, html)``: page_id, url, text, n_chars."""
    html = F.col("html").cast("string")
    net = train_on(pages)

    def run(batches):
        for b in batches:
            at = 0
            for part in chunked(rows([b], "html"), lambda r: len(r[0] or "") + 200, 1 << 20):
                own = b.slice(at, len(part))
                at += len(part)
                texts = extract([h for (h,) in part], net)
                cols = [own.column(own.schema.get_field_index(c)) for c in ("page_id", "url")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    held = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    return held.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_recurrent_main_text(spark, sf_dir):
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
