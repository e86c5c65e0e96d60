"""Boolean queries: nodes, text form and estimates."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Node:
    def __str__(self) -> str:
        return show(self)


@dataclass(frozen=True)
class Term(Node):
    """kind: word, phrase, wildcard, range, exists, regex, fuzzy or near."""

    value: str
    kind: str = "word"
    field: str | None = None
    boost: float = 1.0
    low: str | None = None
    high: str | None = None
    inclusive: tuple[bool, bool] = (True, True)
    distance: int = 0


@dataclass(frozen=True)
class And(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Or(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Not(Node):
    inner: Node


@dataclass(frozen=True)
class Empty(Node):
    pass


#: Share of documents that a kind of term is taken to match.
SELECTIVITY = {"phrase": 0.1, "near": 0.1, "word": 0.3, "fuzzy": 0.3, "range": 0.5, "regex": 0.6, "wildcard": 0.7, "exists": 0.8}


def show(n: Node) -> str:
    match n:
        case Term():
            text = {
                "phrase": f'"{n.value}"', "near": f'"{n.value}"~{n.distance}', "regex": f"/{n.value}/", "exists": "*", "fuzzy": f"{n.value}~{n.distance}",
                "range": f"{'[' if n.inclusive[0] else '{'}{n.low or '*'} TO {n.high or '*'}{']' if n.inclusive[1] else '}'}",
            }.get(n.kind, n.value)
            return (f"{n.field}:" if n.field else "") + text + (f"^{n.boost:g}" if n.boost != 1 else "")
        case And():
            return f"({show(n.left)} AND {show(n.right)})"
        case Or():
            return f"({show(n.left)} OR {show(n.right)})"
        case Not():
            return f"NOT {show(n.inner)}"
    return ""


def selectivity(n: Node) -> float:
    match n:
        case Term():
            return SELECTIVITY[n.kind]
        case And():
            return selectivity(n.left) * selectivity(n.right)
        case Or():
            p, q = selectivity(n.left), selectivity(n.right)
            return p + q - p * q
        case Not():
            return 1 - selectivity(n.inner)
    return 1.0


def complexity(n: Node) -> float:
    match n:
        case Term():
            return 1.0
        case And() | Or():
            return 1 + complexity(n.left) + complexity(n.right)
        case Not():
            return 1.5 + complexity(n.inner)
    return 0.0


@dataclass
class Usage:
    fields: dict[str, int] = field(default_factory=dict)
    operators: dict[str, int] = field(default_factory=dict)
    terms: list[Term] = field(default_factory=list)


def usage(n: Node) -> Usage:
    """How often fields and operators occur, and the terms in order."""
    u, todo = Usage(), [n]
    while todo:
        x = todo.pop()
        match x:
            case Term():
                u.terms.append(x)
                key = x.field or "content"
                u.fields[key] = u.fields.get(key, 0) + 1
            case And() | Or():
                op = type(x).__name__.upper()
                u.operators[op] = u.operators.get(op, 0) + 1
                todo += [x.right, x.left]
            case Not():
                u.operators["NOT"] = u.operators.get("NOT", 0) + 1
                todo.append(x.inner)
    return u


def simplified(n: Node) -> Node:
    """Without double negations and empty operands; conjuncts that match less come first."""
    match n:
        case And() | Or():
            a, b = simplified(n.left), simplified(n.right)
            if isinstance(a, Empty) or isinstance(b, Empty):
                return b if isinstance(a, Empty) else a
            if isinstance(n, And) and selectivity(b) < selectivity(a):
                a, b = b, a
            return type(n)(a, b)
        case Not():
            inner = simplified(n.inner)
            return inner.inner if isinstance(inner, Not) else inner if isinstance(inner, Empty) else Not(inner)
    return n


def _operands(n: Node, kind: type) -> list[Node]:
    return _operands(n.left, kind) + _operands(n.right, kind) if isinstance(n, kind) else [n]


def canonical(n: Node) -> Node:
    """One form for trees that commuting, regrouping, repeating, absorbing and double negation turn into each other."""
    match n:
        case Not():
            inner = canonical(n.inner)
            return inner.inner if isinstance(inner, Not) else inner if isinstance(inner, Empty) else Not(inner)
        case And() | Or():
            kind, other = type(n), Or if isinstance(n, And) else And
            own = {show(x): x for y in _operands(n, kind) for x in _operands(canonical(y), kind) if not isinstance(x, Empty)}
            held = {k: {show(y) for y in _operands(x, other)} for k, x in own.items()}
            # an operand goes if the parts of another are among its own: a AND (a OR b) is a
            left = [x for k, x in sorted(own.items()) if not any(j != k and held[j] < held[k] for j in own)]
            if not left:
                return Empty()
            out = left[-1]
            for x in reversed(left[:-1]):
                out = kind(x, out)
            return out
    return n
