"""Specification text to a tree of plain records. Parsing never fails: what cannot be read becomes an error row, and reading goes on at the next block."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<space>[ \t\f\r\n]+)|(?P<warning>//!.*)|(?P<question>//\?.*)|(?P<comment>//.*)
    |(?P<long>\"\"\"(?:[^"]|"(?!""))*\"\"\")|(?P<string>"(?:[^"\\]|\\.)*")|(?P<tick>`(?:[^`\\]|\\.)+`)
    |(?P<number>[0-9]+(?:\.[0-9]+)?)|(?P<arrow>->)|(?P<spread>\.\.\.)|(?P<colons>::)|(?P<compare>>=|<=|!=|==|<|>)
    |(?P<name>[A-Za-z_](?:[A-Za-z0-9_]|-(?!>))*)|(?P<mark>[{}()\[\],|:@.*/+\-=])|(?P<other>.)""",
    re.X,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    row: int
    column: int


@dataclass
class Meta:
    kind: str  # tag, kv, enum, slice, note
    key: str
    value: str | None = None
    values: list[str] = field(default_factory=list)


@dataclass
class Field:
    name: str
    type: str | None
    is_list: bool
    meta: list[Meta]
    children: list[Field]
    spreads: list[str]
    row: int
    column: int

    @property
    def is_record(self) -> bool:
        return self.type == "record"


@dataclass
class Step:
    kind: str  # text, map, spread
    text: str
    atoms: list[tuple[str, str]] = field(default_factory=list)
    entries: list[tuple[str, str, str | None]] = field(default_factory=list)  # comparison or "", key, value


@dataclass
class Arrow:
    kind: str  # map, computed, nested, each, flatten
    sources: list[str]
    target: str
    steps: list[Step]
    meta: list[Meta]
    children: list[Arrow]
    text: str
    row: int


@dataclass
class Source:
    name: str
    meta: list[Meta]
    is_prose: bool


@dataclass
class Block:
    kind: str  # schema, fragment, transform, mapping
    name: str | None
    namespace: str | None
    meta: list[Meta]
    file: str
    row: int
    fields: list[Field] = field(default_factory=list)
    spreads: list[str] = field(default_factory=list)
    notes: list[tuple[str, int]] = field(default_factory=list)
    steps: list[Step] = field(default_factory=list)
    sources: list[Source] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)
    arrows: list[Arrow] = field(default_factory=list)

    @property
    def key(self) -> str:
        own = self.name or f"<anon>@{self.file}:{self.row}"
        return f"{self.namespace}::{own}" if self.namespace else own

    def tag(self, key: str) -> bool:
        return any(m.kind == "tag" and m.key == key for m in self.meta)

    def value(self, key: str) -> str | None:
        return next((m.value for m in self.meta if m.key == key and m.value is not None), None)


@dataclass
class Module:
    file: str
    blocks: list[Block] = field(default_factory=list)
    imports: list[tuple[list[str], str, int]] = field(default_factory=list)
    namespaces: list[tuple[str, list[Meta], int]] = field(default_factory=list)
    notes: list[tuple[str, int, str | None]] = field(default_factory=list)
    comments: list[tuple[str, str, int, str | None]] = field(default_factory=list)  # kind, text, row, block
    errors: list[tuple[int, int, str]] = field(default_factory=list)


class _Bad(Exception):
    pass


def unquote(text: str) -> str:
    if text.startswith('"""'):
        lines = text[3:-3].strip("\n").split("\n")
        pad = min((len(x) - len(x.lstrip()) for x in lines[1:] if x.strip()), default=0)
        return "\n".join([lines[0].strip(), *(x[pad:].rstrip() for x in lines[1:])]).strip()
    if text[:1] in '"`':
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    return text


class _Parser:
    def __init__(self, text: str, file: str):
        self.text, self.at, self.module = text, 0, Module(file)
        self.tokens: list[Token] = []
        row, line = 0, 0
        for m in _TOKEN.finditer(text):
            kind, got = m.lastgroup, m.group()
            token = Token(kind, got, m.start(), m.end(), row, m.start() - line)
            if kind in ("warning", "question"):
                self.module.comments.append((kind, got[3:].strip(), row, None))
            elif kind == "other":
                self.module.errors.append((row, token.column, f"unexpected {got!r}"))
            elif kind not in ("space", "comment"):
                self.tokens.append(token)
            if "\n" in got:
                row, line = row + got.count("\n"), m.start() + got.rindex("\n") + 1
        self.tokens.append(Token("end", "", len(text), len(text), row, 0))

    # ---- tokens
    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def next(self) -> Token:
        token = self.now
        if token.kind != "end":
            self.at += 1
        return token

    def accept(self, text: str) -> bool:
        if self.now.text == text and self.now.kind not in ("string", "tick", "long"):
            self.at += 1
            return True
        return False

    def expect(self, text: str) -> Token:
        if self.now.text != text:
            raise _Bad(f"expected {text!r}, found {self.now.text[:40]!r}")
        return self.next()

    def label(self) -> str:
        if self.now.kind not in ("name", "tick"):
            raise _Bad(f"expected a name, found {self.now.text[:40]!r}")
        return unquote(self.next().text)

    def qualified(self) -> str:
        name = self.label()
        return f"{name}::{self.label()}" if self.accept("::") else name

    # ---- blocks
    def parse(self) -> Module:
        while self.now.kind != "end":
            begin = self.at
            try:
                self.item(None)
            except _Bad as bad:
                self.module.errors.append((self.now.row, self.now.column, str(bad)))
                self.at = max(self.at, begin + 1)
                starts = ("schema", "fragment", "transform", "mapping", "namespace", "import", "note")
                while self.now.kind != "end" and not (self.now.text in starts and self.now.column == 0):
                    self.at += 1
        spans = [(b.row, b.key) for b in self.module.blocks]
        self.module.comments = [(k, t, r, next((name for at, name in reversed(spans) if at <= r), None)) for k, t, r, _ in self.module.comments]
        return self.module

    def item(self, namespace: str | None) -> None:
        token = self.now
        if token.text == "import" and namespace is None:
            self.next()
            self.expect("{")
            names = []
            while not self.accept("}"):
                names.append(self.qualified())
                self.accept(",")
            self.expect("from")
            self.module.imports.append((names, unquote(self.next().text), token.row))
        elif token.text == "note":
            self.module.notes.append((self.note(), token.row, namespace))
        elif token.text == "namespace" and namespace is None:
            self.next()
            name = self.label()
            self.module.namespaces.append((name, self.meta(), token.row))
            self.expect("{")
            while not self.accept("}"):
                if self.now.kind == "end":
                    raise _Bad("the namespace is not closed")
                self.item(name)
        elif token.text in ("schema", "fragment", "transform", "mapping"):
            self.block(namespace)
        else:
            raise _Bad(f"unexpected {token.text[:40]!r}")

    def note(self) -> str:
        self.expect("note")
        self.expect("{")
        parts = []
        while not self.accept("}"):
            if self.now.kind not in ("string", "long"):
                raise _Bad("a note holds strings")
            parts.append(unquote(self.next().text))
        return "\n".join(parts)

    def block(self, namespace: str | None) -> None:
        token = self.next()
        name = self.label() if self.now.kind in ("name", "tick") else None
        block = Block(token.text, name, namespace, self.meta(), self.module.file, token.row)
        self.expect("{")
        if block.kind in ("schema", "fragment"):
            block.fields, block.spreads, block.notes = self.body()
        elif block.kind == "transform":
            block.steps = self.chain()
            self.expect("}")
        else:
            self.mapping(block)
        self.module.blocks.append(block)

    # ---- metadata
    def meta(self) -> list[Meta]:
        out: list[Meta] = []
        if not self.accept("("):
            return out
        while not self.accept(")"):
            if self.accept(","):
                continue
            key = self.label()
            if key in ("enum", "slice") and self.accept("{"):
                values = []
                while not self.accept("}"):
                    if not self.accept(","):
                        values.append(unquote(self.next().text))
                out.append(Meta(key, key, None, values))
            elif key == "note" and self.now.kind in ("string", "long"):
                out.append(Meta("note", key, unquote(self.next().text)))
            elif self.now.text in (",", ")"):
                out.append(Meta("tag", key))
            else:
                out.append(Meta("kv", key, *self.meta_value()))
        return out

    def meta_value(self) -> tuple[str, list[str]]:
        values: list[str] = []
        start, end, depth = self.now.start, self.now.end, 0
        only = self.now if self.now.kind in ("string", "long", "tick") else None
        count = 0
        while self.now.kind != "end" and (depth or self.now.text not in (",", ")")):
            token = self.next()
            depth += {"{": 1, "}": -1, "(": 1, ")": -1}.get(token.text, 0) if token.kind == "mark" else 0
            if depth and token.kind in ("name", "string", "tick", "number"):
                values.append(unquote(token.text))
            end, count = token.end, count + 1
        return (unquote(only.text) if only and count == 1 else " ".join(self.text[start:end].split())), values

    # ---- fields
    def body(self) -> tuple[list[Field], list[str], list[tuple[str, int]]]:
        fields, spreads, notes = [], [], []
        while not self.accept("}"):
            token = self.now
            if token.kind == "end":
                raise _Bad("a block is not closed")
            if self.accept("..."):
                spreads.append(self.spread())
            elif token.text == "note" and self.peek().text == "{":
                notes.append((self.note(), token.row))
            else:
                fields.append(self.field())
        return fields, spreads, notes

    def spread(self) -> str:
        """A label of several words must stand in one line."""
        first = self.now
        if first.kind == "tick":
            return unquote(self.next().text)
        words = [self.qualified()]
        while self.now.kind == "name" and self.now.row == first.row and self.peek().text not in ("(", "::") and self.tokens[self.at - 1].row == first.row:
            words.append(self.next().text)
        return " ".join(words)

    def field(self) -> Field:
        token = self.now
        name, is_list, kind = self.label(), False, None
        if self.now.text == "list_of":
            self.next()
            is_list = True
        if self.now.kind == "name":
            first = self.next()
            kind = first.text
            if self.now.text == "(" and self.now.start == first.end and kind != "record":
                start = self.now.start
                while self.now.kind != "end" and self.now.text != ")":
                    self.next()
                kind += self.text[start : self.expect(")").end]
        meta = self.meta()
        if kind is None and not meta:
            raise _Bad(f"field {name!r} has neither type nor metadata")
        children, spreads = [], []
        if kind == "record":
            self.expect("{")
            children, spreads, _ = self.body()
        return Field(name, kind, is_list, meta, children, spreads, token.row, token.column)

    # ---- mappings
    def mapping(self, block: Block) -> None:
        while not self.accept("}"):
            token = self.now
            if token.kind == "end":
                raise _Bad("the mapping is not closed")
            if token.text == "note" and self.peek().text == "{":
                block.notes.append((self.note(), token.row))
            elif token.text in ("source", "target") and self.peek().text == "{":
                self.at += 2
                while not self.accept("}"):
                    if self.accept(","):
                        continue
                    prose = self.now.kind in ("string", "long")
                    name = unquote(self.next().text) if prose else self.qualified()
                    if token.text == "source":
                        block.sources.append(Source(name, self.meta(), prose))
                    else:
                        self.meta()
                        block.targets.append(name)
            else:
                block.arrows.append(self.arrow())

    def path(self) -> str:
        out = "." if self.accept(".") else ""
        out += self.label()
        if self.accept("::"):
            out += "::" + self.label()
        while self.now.text == "." and self.now.start == self.tokens[self.at - 1].end:
            self.next()
            out += "." + self.label()
        return out

    def arrow(self) -> Arrow:
        start = self.now
        kind = "map"
        if start.text in ("each", "flatten") and self.peek().kind in ("name", "tick", "mark") and (self.peek().text not in ("->", ",", ".") or self.peek().text == "." and self.peek().start > start.end):
            kind = self.next().text
        sources = []
        while self.now.text != "->":
            sources.append(self.path())
            self.accept(",")
        self.expect("->")
        target, meta, steps, children = self.path(), self.meta(), [], []
        if not sources:
            kind = "computed"
        if self.accept("{"):
            if kind in ("each", "flatten") or self._holds_arrows():
                kind = "nested" if kind == "map" else kind
                while not self.accept("}"):
                    if self.now.kind == "end":
                        raise _Bad("a block of arrows is not closed")
                    children.append(self.arrow())
            else:
                steps = self.chain()
                self.expect("}")
        return Arrow(kind, sources, target, steps, meta, children, self.text[start.start : self.tokens[self.at - 1].end], start.row)

    def _holds_arrows(self) -> bool:
        """Whether the braces just opened hold arrows, not a chain: an arrow comes before they close, outside inner braces."""
        depth, n = 0, 0
        while (token := self.peek(n)).kind != "end" and not (depth == 0 and token.text == "}"):
            depth += {"{": 1, "}": -1}.get(token.text, 0) if token.kind == "mark" else 0
            if token.kind == "arrow" and depth == 0:
                return True
            n += 1
        return False

    # ---- chains
    def chain(self) -> list[Step]:
        steps: list[Step] = []
        while self.now.text != "}" and self.now.kind != "end":
            if self.accept("|"):
                continue
            start = self.now
            if self.accept("..."):
                name = self.spread()
                steps.append(Step("spread", name))
            elif start.text == "map" and self.peek().text == "{":
                steps.append(self.value_map())
            else:
                atoms, depth = [], 0
                while self.now.kind != "end" and not (depth == 0 and self.now.text in ("|", "}") and self.now.kind == "mark"):
                    token = self.next()
                    depth += {"(": 1, ")": -1}.get(token.text, 0) if token.kind == "mark" else 0
                    atoms.append((token.kind, token.text))
                steps.append(Step("text", self.text[start.start : self.tokens[self.at - 1].end], atoms))
        return steps

    def value_map(self) -> Step:
        start = self.now
        self.at += 2
        entries: list[tuple[str, str, str | None]] = []
        while not self.accept("}"):
            if self.accept(","):
                continue
            if self.now.kind == "end":
                raise _Bad("a map is not closed")
            compare = self.next().text if self.now.kind == "compare" else ""
            key = []
            while self.now.text != ":" and self.now.kind != "end":
                key.append(self.now)
                self.next()
            self.expect(":")
            value = self.now
            self.next()
            while self.now.kind in ("name", "number") and self.now.row == value.row and self.peek().text != ":":
                self.next()
            raw = self.text[value.start : self.tokens[self.at - 1].end]
            name = unquote(key[0].text) if len(key) == 1 else " ".join(k.text for k in key)
            quoted = len(key) == 1 and key[0].kind in ("string", "tick")
            special = {"null": "\0null", "_": "\0default", "default": "\0default"}.get(name, name) if not quoted else name
            entries.append((compare, special, None if raw == "null" else unquote(raw)))
        return Step("map", self.text[start.start : self.tokens[self.at - 1].end], [], entries)


def parse(text: str, file: str = "<text>") -> Module:
    """The tree of one file; rows and columns count from 0."""
    return _Parser(text, file).parse()
