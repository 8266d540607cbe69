"""A specification's canonical text, and edits of its text. Comments are kept by edits, not by printing."""

from __future__ import annotations

import re

from weftline.lang.syntax import Arrow, Block, Field, Meta, Module, Step

_NAME = re.compile(r"[A-Za-z_](?:[A-Za-z0-9_]|-(?!>))*\Z")


def _name(text: str) -> str:
    return "::".join(p if _NAME.match(p) else f"`{p}`" for p in text.split("::"))


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _meta(meta: list[Meta]) -> str:
    def one(m: Meta) -> str:
        if m.kind in ("enum", "slice"):
            return f"{m.kind} {{{', '.join(v if _NAME.match(v) or v.replace('.', '', 1).isdigit() else _quoted(v) for v in m.values)}}}"
        if m.kind == "note":
            return f"note {_quoted(m.value or '')}"
        if m.kind == "tag":
            return m.key
        plain = m.values or re.fullmatch(r"@?[\w.:-]+", m.value or "")
        return f"{m.key} {m.value if plain else _quoted(m.value or '')}"

    return f" ({', '.join(map(one, meta))})" if meta else ""


def _fields(fields: list[Field], spreads: list[str], pad: str) -> list[str]:
    out = []
    for f in fields:
        kind = f" list_of {f.type}" if f.is_list else f" {f.type}" if f.type else ""
        line = f"{pad}{_name(f.name)}{kind}{_meta(f.meta)}"
        out += [f"{line} {{", *_fields(f.children, f.spreads, pad + "  "), f"{pad}}}"] if f.is_record else [line]
    return out + [f"{pad}...{_name(s) if ' ' not in s else s}" for s in spreads]


def _steps(steps: list[Step]) -> str:
    return " | ".join(f"...{s.text}" if s.kind == "spread" else " ".join(s.text.split()) if '"' not in s.text else s.text for s in steps)


def _arrow(a: Arrow, pad: str) -> list[str]:
    path = lambda p: ("." if p.startswith(".") else "") + ".".join(_name(x) for x in p.lstrip(".").split("."))
    head = f"{pad}{a.kind + ' ' if a.kind in ('each', 'flatten') else ''}{', '.join(map(path, a.sources))}{' ' if a.sources else ''}-> {path(a.target)}{_meta(a.meta)}"
    if a.kind in ("each", "flatten", "nested"):
        return [f"{head} {{", *(line for c in a.children for line in _arrow(c, pad + "  ")), f"{pad}}}"]
    return [f"{head} {{ {_steps(a.steps)} }}" if a.steps else head]


def _block(b: Block, pad: str) -> list[str]:
    head = f"{pad}{b.kind}{' ' + _name(b.name) if b.name else ''}{_meta(b.meta)} {{"
    inner = pad + "  "
    body = [f"{inner}note {{ {_quoted(t)} }}" for t, _ in b.notes]
    if b.kind in ("schema", "fragment"):
        body += _fields(b.fields, b.spreads, inner)
    elif b.kind == "transform":
        body.append(inner + _steps(b.steps))
    else:
        if b.sources:
            body.append(f"{inner}source {{ {', '.join(_quoted(s.name) if s.is_prose else _name(s.name) + _meta(s.meta) for s in b.sources)} }}")
        body += [f"{inner}target {{ {_name(t)} }}" for t in b.targets]
        body += [line for a in b.arrows for line in _arrow(a, inner)]
    return [head, *body, f"{pad}}}"]


def to_text(module: Module) -> str:
    """The canonical text: two spaces a level, one field or arrow a line. Parsing it gives the same tree."""
    out = [f"import {{ {', '.join(map(_name, names))} }} from {_quoted(path)}" for names, path, _ in module.imports]
    out += [f"note {{ {_quoted(t)} }}" for t, _, space in module.notes if space is None]
    for b in module.blocks:
        if b.namespace is None:
            out += ["", *_block(b, "")]
    for space in dict.fromkeys([n for n, _, _ in module.namespaces] + [b.namespace for b in module.blocks if b.namespace]):
        meta = next((m for n, m, _ in module.namespaces if n == space and m), [])
        out += ["", f"namespace {_name(space)}{_meta(meta)} {{", *(f"  note {{ {_quoted(t)} }}" for t, _, s in module.notes if s == space)]
        out += [line for b in module.blocks if b.namespace == space for line in _block(b, "  ")] + ["}"]
    return "\n".join(out).strip() + "\n"


def add_source(text: str, mapping: str, source: str) -> str:
    """text with a source added to a mapping's one-line ``source { }``; unchanged if there is no such line or the source is there."""
    at = re.search(rf"^[ \t]*mapping\s+`?{re.escape(mapping.split('::')[-1])}`?[\s({{]", text, re.M)
    line = re.compile(r"(source\s*\{)([^{}\n]*)(\})").search(text, at.end()) if at else None
    if line is None or re.search(rf"(?<![\w:]){re.escape(source)}(?![\w:])", line[2]):
        return text
    inside = line[2].rstrip()
    return f"{text[: line.start(2)]}{inside}{',' if inside.strip() else ''} {source} {text[line.start(3) :]}"
