"""Boolean trees as Columns.

A tree becomes one predicate, which Catalyst simplifies and pushes down; NOT keeps rows whose field is
null, as set difference does."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ast import And, Empty, Node, Not, Or, Term
from .parser import QueryError, parse

_UNITS = {"kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "b": 1}


def _glob(value: str) -> str:
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in value)


def _bound(value: str) -> Column:
    if m := re.fullmatch(r"(?i)(\d+(?:\.\d+)?)(kb|mb|gb|b)?", value):
        n = float(m[1]) * _UNITS[(m[2] or "b").lower()]
        return F.lit(int(n) if n == int(n) else n)
    return F.lit(value)


def _has(text: Column, t: Term) -> Column:
    """A word-level test on text, by regular expressions over its tokens."""
    if t.kind == "regex":
        return F.lower(text).rlike(t.value)
    tokens = T.ascii_tokens(text)
    if t.kind == "wildcard":
        return F.exists(tokens, lambda x: x.rlike(f"^{_glob(t.value.lower())}$"))
    if t.kind == "fuzzy":
        return F.exists(tokens, lambda x: F.levenshtein(x, F.lit(t.value.lower())) <= t.distance)
    asked = re.findall("[a-z0-9]+", t.value.lower())
    if not asked:
        return F.lit(False)
    if t.kind == "near":
        at = [_places(tokens, w) for w in asked]
        ok = F.lit(True)
        for x in at[1:]:
            ok = ok & _close(at[0], x, t.distance + len(asked) - 1)
        return ok & (F.size(at[0]) > 0)
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(f" {' '.join(asked)} ")


def _places(tokens: Column, word: str) -> Column:
    return F.filter(F.transform(tokens, lambda x, i: F.when(x == word, i).otherwise(-1)), lambda i: i >= 0)


def _close(a: Column, b: Column, reach: int) -> Column:
    return F.exists(a, lambda i: F.exists(b, lambda j: F.abs(i - j) <= reach))


def predicate(n: Node, fields: dict[str, str]) -> Column:
    """fields: names in queries -> columns; terms without a field ask content."""
    match n:
        case And():
            return predicate(n.left, fields) & predicate(n.right, fields)
        case Or():
            return predicate(n.left, fields) | predicate(n.right, fields)
        case Not():
            return ~predicate(n.inner, fields)
        case Empty():
            return F.lit(True)
    name = n.field or "content"
    if name not in fields:
        raise QueryError(f"no such field: {name}")
    c = F.col(fields[name])
    if n.kind == "exists":
        return c.isNotNull()
    if n.kind == "range":
        ok = c.isNotNull()
        if n.low is not None:
            ok = ok & ((c >= _bound(n.low)) if n.inclusive[0] else (c > _bound(n.low)))
        if n.high is not None:
            ok = ok & ((c <= _bound(n.high)) if n.inclusive[1] else (c < _bound(n.high)))
    elif name == "content":
        ok = _has(c, n)
    elif n.kind == "wildcard":
        ok = F.lower(c).rlike(f"^{_glob(n.value.lower())}$")
    elif n.kind == "regex":
        ok = F.lower(c).rlike(n.value)
    else:
        ok = F.lower(c) == n.value.lower()
    return F.coalesce(ok, F.lit(False))


def boolean_search(docs: DataFrame, text: str, fields: dict[str, str]) -> DataFrame:
    return docs.where(predicate(parse(text), fields))
