"""A workspace as DataFrames: one row for each schema, field, mapping, arrow, metadata entry, note, reference, import and edge.

The rows are made on the driver, where the text is parsed; a specification has thousands of rows at most. Everything that is asked of them is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from weftline.catalog.refs import find_refs
from weftline.lang.names import Workspace, canonical
from weftline.lang.syntax import Arrow, Block, Meta, unquote

_DDL = {
    "files": "file string, n_blocks int, n_errors int",
    "namespaces": "name string, note string, file string, row int",
    "imports": "file string, name string, path string, row int",
    "diagnostics": "file string, row int, col int, message string",
    "schemas": "key string, kind string, namespace string, name string, is_metric boolean, note string, n_fields int, n_spreads int, file string, row int, seq int",
    "fields": "owner string, path string, name string, parent string, type string, is_list boolean, is_record boolean, depth int, ordinal int, tags array<string>, row int",
    "mappings": "key string, namespace string, name string, sources array<string>, target string, n_arrows int, file string, row int",
    "arrows": "id int, mapping string, kind string, target string, sources array<string>, depth int, classification string, steps string, file string, row int",
    "metadata": "owner_kind string, owner string, field string, ordinal int, kind string, key string, value string, values array<string>",
    "nl_items": "kind string, owner string, field string, text string, file string, row int",
    "nl_refs": "owner string, mapping string, target_field string, context string, ref string, kind string, schema string, field string, row int, col int",
    "sedges": "src string, dst string, role string, mapping string",
    "fedges": "ordinal int, src string, dst string, mapping string, classification string",
    "definitions": "kind string, key string, namespace string, name string, file string, row int, seq int",
    "dependencies": "src string, dst string, kind string, file string, row int",
}


class Catalog:
    """DataFrames by name, made when they are first asked for."""

    def __init__(self, spark: SparkSession, workspace: Workspace):
        self.spark, self.workspace = spark, workspace

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.spark.createDataFrame(list(getattr(self, f"_{name}")()), _DDL[name])
        return self._made[name]

    @cached_property
    def _made(self) -> dict[str, DataFrame]:
        return {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in _DDL:
            return self.table(name)
        raise AttributeError(name)

    # ---- rows
    def _files(self) -> Iterator[tuple]:
        for m in self.workspace.modules:
            yield m.file, len(m.blocks), len(m.errors)

    def _namespaces(self) -> Iterator[tuple]:
        for m in self.workspace.modules:
            for name, meta, row in m.namespaces:
                yield name, next((x.value for x in meta if x.kind == "note"), None), m.file, row

    def _imports(self) -> Iterator[tuple]:
        for m in self.workspace.modules:
            for names, path, row in m.imports:
                for name in names:
                    yield m.file, name, path, row

    def _diagnostics(self) -> Iterator[tuple]:
        for m in self.workspace.modules:
            for row, column, message in m.errors:
                yield m.file, row, column, message

    def _schemas(self) -> Iterator[tuple]:
        w = self.workspace
        for seq, (key, b) in enumerate({**w.schemas, **{f"{k}": v for k, v in w.fragments.items() if k not in w.schemas}}.items()):
            yield key, b.kind, b.namespace, b.name, w.is_metric(key), next((m.value for m in b.meta if m.kind == "note"), None), sum(1 for _ in w.paths(key)), len(b.spreads), b.file, b.row, seq

    def _fields(self) -> Iterator[tuple]:
        w = self.workspace
        for key in w.fields:
            for i, (path, f, depth) in enumerate(w.paths(key)):
                parent = path.rpartition(".")[0] or None
                yield key, path, f.name, parent, f.type, f.is_list, f.is_record, depth, i, [m.key for m in f.meta], f.row

    def _mappings(self) -> Iterator[tuple]:
        for key, b in self.workspace.mappings.items():
            n = sum(1 for a, _, _ in walk(b.arrows) if a.kind in ("map", "computed", "nested"))
            yield key, b.namespace, b.name, [self._schema(s.name, b) for s in b.sources if not s.is_prose], self._schema(b.targets[0], b) if b.targets else None, n, b.file, b.row

    def _schema(self, name: str, block: Block) -> str:
        return self.workspace.find(name, block.namespace, self.workspace.schemas) or name

    def _arrows(self) -> Iterator[tuple]:
        i = 0
        for key, b in self.workspace.mappings.items():
            for a, prefix, depth in walk(b.arrows):
                sources, target = full_paths(a, prefix)
                yield i, key, a.kind, target, sources, depth, classification(a), " | ".join(s.text for s in a.steps) or None, b.file, a.row
                i += 1

    def _metadata(self) -> Iterator[tuple]:
        w = self.workspace
        for b in w.blocks:
            yield from (("block" if b.kind != "mapping" else "mapping", b.key, None, *r) for r in _meta_rows(b.meta))
        for key in w.fields:
            for path, f, _ in w.paths(key):
                yield from (("field", key, path, *r) for r in _meta_rows(f.meta))

    def _texts(self) -> Iterator[tuple[str, str, str | None, str, str, int, Block | None]]:
        """(kind, owner, field, text, file, row, mapping) of everything that is prose."""
        w = self.workspace
        for m in w.modules:
            for text, row, namespace in m.notes:
                yield "note", namespace or m.file, None, text, m.file, row, None
            for kind, text, row, owner in m.comments:
                yield kind, owner or m.file, None, text, m.file, row, None
        for b in w.blocks:
            mapping = b if b.kind == "mapping" else None
            for meta in b.meta:
                if meta.kind == "note":
                    yield "note", b.key, None, meta.value or "", b.file, b.row, None
            for text, row in b.notes:
                yield "note", b.key, None, text, b.file, row, mapping
            for s in b.sources:
                if s.is_prose:
                    yield "source", b.key, None, s.name, b.file, b.row, mapping
            for s in b.steps:
                if '"' in s.text:
                    yield "transform", b.key, None, s.text, b.file, b.row, None
            for a, prefix, _ in walk(b.arrows):
                for s in a.steps:
                    if s.kind == "text":
                        yield "transform", b.key, full_paths(a, prefix)[1], s.text, b.file, a.row, mapping
        for key in {**w.schemas, **w.fragments}:
            for path, f, _ in w.paths(key):
                for meta in f.meta:
                    if meta.kind == "note":
                        yield "note", key, path, meta.value or "", "", f.row, None

    def _nl_items(self) -> Iterator[tuple]:
        for kind, owner, field, text, file, row, _ in self._texts():
            yield kind, owner, field, unquote(text) if kind == "transform" and text.startswith('"') else text, file, row

    def _nl_refs(self) -> Iterator[tuple]:
        for kind, owner, field, text, _, row, mapping in self._texts():
            for r in find_refs(text.replace('"', " "), self.workspace, mapping):
                yield owner, mapping.key if mapping else None, field, kind, r.ref, r.kind, r.schema, r.field, row + r.row, r.column

    def _sedges(self) -> Iterator[tuple]:
        w, seen = self.workspace, set()
        for key, b in w.mappings.items():
            declared = {self._schema(n, b) for n in [*(s.name for s in b.sources if not s.is_prose), *b.targets]}
            rows = [(self._schema(s.name, b), key, "source", key) for s in b.sources if not s.is_prose]
            rows += [(key, self._schema(t, b), "target", key) for t in b.targets]
            rows += [(r[6], key, "nl_ref", key) for r in self._nl_refs() if r[1] == key and r[6] and r[6] not in declared]
            for row in rows:
                if row not in seen:
                    seen.add(row)
                    yield row
        for key, b in w.schemas.items():
            if w.is_metric(key):
                for name in _source_names(b):
                    yield self._schema(name, b), key, "metric_source", None

    def _fedges(self) -> Iterator[tuple]:
        w, n = self.workspace, 0
        refs: dict[tuple[str, str], list[str]] = {}
        for r in self._nl_refs():
            if r[1] and r[2] is not None and r[3] == "transform" and r[6] and r[7]:
                refs.setdefault((r[1], r[2]), []).append(f"{canonical(r[6])}.{r[7]}")
        for key, b in w.mappings.items():
            sources = [self._schema(s.name, b) for s in b.sources if not s.is_prose]
            target = self._schema(b.targets[0], b) if b.targets else None
            for a, prefix, _ in walk(b.arrows):
                paths, out = full_paths(a, prefix)
                if target is None:
                    continue
                dst, declared = f"{canonical(target)}.{out}", []
                for p in paths:
                    src = f"{canonical(self._owner(p, sources))}.{self._bare(p, sources)}"
                    declared.append(src)
                    yield n, src, dst, key, classification(a)
                    n += 1
                for src in dict.fromkeys(refs.get((key, out), [])):
                    if src not in declared and src != dst:
                        yield n, src, dst, key, "nl-derived"
                        n += 1

    def _owner(self, path: str, sources: list[str]) -> str:
        """The schema that a source path belongs to: the one it names, else the first."""
        if "::" in path:
            space, rest = path.split("::", 1)
            return f"{space}::{rest.split('.')[0]}"
        head = path.split(".")[0]
        named = [s for s in sources if s.split("::")[-1] == head and "." in path]
        return named[0] if named else sources[0] if sources else "?"

    def _bare(self, path: str, sources: list[str]) -> str:
        path = path.split("::")[-1]
        head, _, rest = path.partition(".")
        return rest if rest and any(s.split("::")[-1] == head for s in sources) else path

    def _definitions(self) -> Iterator[tuple]:
        for seq, b in enumerate(self.workspace.blocks):
            yield "metric" if b.kind == "schema" and b.tag("metric") else b.kind, b.key, b.namespace, b.name, b.file, b.row, seq

    def _dependencies(self) -> Iterator[tuple]:
        """What each block uses: sources, targets, spread fragments, called transforms, ref metadata, metric sources, imports and prose references."""
        w = self.workspace
        for b in w.blocks:
            kind = {"mapping": "mapping"}.get(b.kind, b.kind)
            for s in b.sources:
                if not s.is_prose:
                    yield b.key, self._schema(s.name, b), "mapping", b.file, b.row
            for t in b.targets:
                yield b.key, self._schema(t, b), "mapping", b.file, b.row
            if b.kind in ("schema", "fragment"):
                for name in _all_spreads(b):
                    yield b.key, w.find(name, b.namespace, w.fragments) or name, "fragment_spread", b.file, b.row
                for f in _all_fields(b.fields):
                    for m in f.meta:
                        if m.key == "ref" and m.value:
                            yield b.key, self._schema(m.value.removeprefix("@").rpartition(".")[0] or m.value, b), "ref_metadata", b.file, f.row
            if kind == "schema" and b.tag("metric"):
                for name in _source_names(b):
                    yield b.key, self._schema(name, b), "metric", b.file, b.row
            for steps in [b.steps, *(a.steps for a, _, _ in walk(b.arrows))]:
                for s in steps:
                    if s.kind == "spread":
                        yield b.key, w.find(s.text, b.namespace, w.transforms) or s.text, "transform_call", b.file, b.row
        for m in w.modules:
            for names, _, row in m.imports:
                for name in names:
                    yield m.file, name, "import", m.file, row
        for r in self._nl_refs():
            if r[6]:
                yield r[0], r[6], "nl_ref", "", r[8]


def _meta_rows(meta: list[Meta]) -> Iterator[tuple]:
    for i, m in enumerate(meta):
        yield i, m.kind, m.key, m.value, list(m.values)


def _source_names(b: Block) -> list[str]:
    return [n for m in b.meta if m.key == "source" for n in (m.values or [m.value or ""])]


def _all_fields(fields: list) -> Iterator:
    for f in fields:
        yield f
        yield from _all_fields(f.children)


def _all_spreads(b: Block) -> Iterator[str]:
    yield from b.spreads
    for f in _all_fields(b.fields):
        yield from f.spreads


def walk(arrows: list[Arrow], prefix: tuple[str, str] = ("", ""), depth: int = 0) -> Iterator[tuple[Arrow, tuple[str, str], int]]:
    """Every arrow at any depth, with the source and target paths that it is inside."""
    for a in arrows:
        yield a, prefix, depth
        if a.children:
            sources, target = full_paths(a, prefix)
            yield from walk(a.children, (sources[0] if sources else prefix[0], target), depth + 1)


def full_paths(a: Arrow, prefix: tuple[str, str]) -> tuple[list[str], str]:
    """An arrow's paths from the top; a path that starts with a dot, or inside another arrow does not start with its path, is relative."""

    def full(path: str, outer: str) -> str:
        bare = path.lstrip(".")
        if not outer or "::" in path or bare == outer or bare.startswith(f"{outer}."):
            return bare
        return f"{outer}.{bare}"

    return [full(s, prefix[0]) for s in a.sources], full(a.target, prefix[1])


def classification(a: Arrow) -> str:
    return "nl" if a.steps else "none"
