"""Arithmetic between fields: ``@variance divided by @budget times 100``.

Prose is never guessed at. A text is a formula only if it is one from its first character to its last: references, numbers and brackets, joined by plus, minus, times (multiplied by) and divided by, or
their signs, with the usual precedence and from left to right. A quotient by zero is null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<ref>@[A-Za-z_`](?:[\w`.:-]*[\w`])?)|(?P<number>\d+(?:\.\d+)?)|(?P<word>plus|minus|times|multiplied\s+by|divided\s+by)\b|(?P<sign>[-+*/()]))", re.I)
_SIGNS = {"plus": "+", "minus": "-", "times": "*", "multiplied by": "*", "divided by": "/"}

Lookup = Callable[[str], Column]
Node = Callable[[Lookup], Column]


class NotAFormula(ValueError):
    pass


@dataclass(frozen=True)
class Formula:
    """What a text says: the references that it takes, in order, and how their columns make its own."""

    refs: tuple[str, ...]
    column: Node


def formula(text: str) -> Formula:
    tokens, at, text = [], 0, text.strip().rstrip(".")
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise NotAFormula(text)
        word = m.group("word")
        sign = _SIGNS[re.sub(r"\s+", " ", word.lower())] if word else m.group("sign")
        tokens.append((sign, "") if sign else (m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    refs: list[str] = []
    tokens.append(("end", ""))
    place = 0

    def taken(*kinds: str) -> str | None:
        nonlocal place
        if tokens[place][0] in kinds:
            place += 1
            return tokens[place - 1][0]
        return None

    def factor() -> Node:
        kind, value = tokens[place]
        if taken("ref"):
            name = value[1:].replace("`", "")
            refs.append(name)
            return lambda of: of(name)
        if taken("number"):
            return lambda of: F.lit(float(value) if "." in value else int(value))
        if taken("-"):
            inner = factor()
            return lambda of: -inner(of)
        if taken("("):
            inner = total()
            if not taken(")"):
                raise NotAFormula(text)
            return inner
        raise NotAFormula(text)

    def joined(part: Callable[[], Node], signs: str) -> Node:
        left = part()
        while sign := taken(*signs):
            left = _applied(sign, left, part())
        return left

    def total() -> Node:
        return joined(lambda: joined(factor, "*/"), "+-")

    made = total()
    if place != len(tokens) - 1 or not refs:
        raise NotAFormula(text)
    return Formula(tuple(dict.fromkeys(refs)), made)


def _applied(sign: str, left: Node, right: Node) -> Node:
    return {
        "+": lambda of: left(of) + right(of),
        "-": lambda of: left(of) - right(of),
        "*": lambda of: left(of) * right(of),
        "/": lambda of: F.try_divide(left(of), right(of)),
    }[sign]


def stages(needs: dict[str, set[str]]) -> list[list[str]]:
    """Names in stages: each needs only names of earlier stages, or none of these. A cycle is an error that names it."""
    left, out = dict(needs), []
    while left:
        ready = [n for n, of in left.items() if not of & set(left)]
        if not ready:
            way = [next(iter(left))]
            while way[-1] not in way[:-1]:
                way.append(next(n for n in left if n in left[way[-1]]))
            raise ValueError(f"target fields need each other: {' -> '.join(way[way.index(way[-1]) :])}")
        out.append(ready)
        for n in ready:
            del left[n]
    return out
