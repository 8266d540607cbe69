"""Filter expressions of specifications as column expressions, through a grammar of their own: no text reaches the SQL parser.

    or := and (OR and)* ; and := not (AND not)* ; not := [NOT] test ; test := sum [compare sum | [NOT] IN (...) | [NOT] LIKE sum | IS [NOT] NULL | BETWEEN sum AND sum]
    sum := atom (('+'|'-'|'*'|'/') atom)*
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^']|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`)|(?P<number>\d+(?:\.\d+)?)|(?P<name>@?[A-Za-z_][\w.]*)|(?P<mark><=|>=|!=|<>|==|[=<>(),+*/-]))")


class NotAPredicate(ValueError):
    pass


class _Reader:
    def __init__(self, text: str, column: Callable[[str], Column]):
        self.parts, self.at, self.column = [], 0, column
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise NotAPredicate(text[at : at + 40])
            self.parts.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()

    def word(self, *words: str) -> bool:
        if self.at < len(self.parts) and self.parts[self.at][1].upper() in words and self.parts[self.at][0] != "text":
            self.at += 1
            return True
        return False

    def either(self) -> Column:
        out = self.both()
        while self.word("OR"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.test()
        while self.word("AND"):
            out = out & self.test()
        return out

    def test(self) -> Column:
        if self.word("NOT"):
            return ~self.test()
        if self.word("("):
            out = self.either()
            if not self.word(")"):
                raise NotAPredicate("a parenthesis is not closed")
            return out
        left = self.sum()
        for sign, f in (("=", Column.__eq__), ("==", Column.__eq__), ("!=", Column.__ne__), ("<>", Column.__ne__), ("<=", Column.__le__), (">=", Column.__ge__), ("<", Column.__lt__), (">", Column.__gt__)):
            if self.word(sign):
                return f(left, self.sum())
        if self.word("IS"):
            no = self.word("NOT")
            if not self.word("NULL"):
                raise NotAPredicate("IS without NULL")
            return left.isNotNull() if no else left.isNull()
        no = self.word("NOT")
        if self.word("IN"):
            out = left.isin(*self.list())
        elif self.word("LIKE"):
            kind, text = self.parts[self.at]
            self.at += 1
            out = left.like(_text(text))
        elif self.word("BETWEEN"):
            low = self.sum()
            if not self.word("AND"):
                raise NotAPredicate("BETWEEN without AND")
            out = left.between(low, self.sum())
        elif no:
            raise NotAPredicate("NOT without IN, LIKE or BETWEEN")
        else:
            return left
        return ~out if no else out

    def list(self) -> list[Column]:
        out, end = [], None
        for a, b in (("(", ")"), ("{", "}")):
            end = b if end is None and self.word(a) else end
        if end is None:
            raise NotAPredicate("IN without a list")
        while not self.word(end):
            out.append(self.atom())
            self.word(",")
        return out

    def sum(self) -> Column:
        out = self.atom()
        while self.at < len(self.parts) and self.parts[self.at][1] in ("+", "-", "*", "/") and self.parts[self.at][0] == "mark":
            sign = self.parts[self.at][1]
            self.at += 1
            out = {"+": Column.__add__, "-": Column.__sub__, "*": Column.__mul__, "/": Column.__truediv__}[sign](out, self.atom())
        return out

    def atom(self) -> Column:
        if self.at >= len(self.parts):
            raise NotAPredicate("the expression ends too early")
        kind, text = self.parts[self.at]
        self.at += 1
        if kind == "text":
            return F.lit(_text(text))
        if kind == "number":
            return F.lit(float(text) if "." in text else int(text))
        if kind == "name":
            if text.upper() in ("TRUE", "FALSE"):
                return F.lit(text.upper() == "TRUE")
            if text.upper() == "DATE" and self.at < len(self.parts) and self.parts[self.at][0] == "text":
                self.at += 1
                return F.lit(_text(self.parts[self.at - 1][1])).cast("date")
            return self.column(text.removeprefix("@"))
        if text == "-":
            return -self.atom()
        raise NotAPredicate(text)


def _text(quoted: str) -> str:
    return quoted[1:-1].replace("''", "'") if quoted[0] == "'" else quoted[1:-1]


def predicate(text: str, column: Callable[[str], Column] = F.col) -> Column:
    """The condition that text states; NotAPredicate if it isn't one. Backticked, double- and single-quoted words are text; a bare word is a column."""
    reader = _Reader(text, column)
    out = reader.either()
    if reader.at != len(reader.parts):
        raise NotAPredicate(" ".join(t for _, t in reader.parts[reader.at :])[:40])
    return out
