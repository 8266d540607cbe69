"""Names across a workspace: lookup, canonical form, and fragment expansion."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

from weftline.lang.syntax import Block, Field, Module


def canonical(key: str) -> str:
    """[ns]::name; the colons stay without a namespace."""
    return key if "::" in key else f"::{key}"


class Workspace:
    """All blocks by key. A schema defined twice has both definitions' fields; of other kinds the last one counts. Every block is kept for checks."""

    def __init__(self, modules: list[Module]):
        self.modules = modules
        self.blocks: list[Block] = [b for m in modules for b in m.blocks]
        self.schemas: dict[str, Block] = {}
        self.fragments: dict[str, Block] = {}
        self.transforms: dict[str, Block] = {}
        self.mappings: dict[str, Block] = {}
        for b in self.blocks:
            kinds = {"schema": self.schemas, "fragment": self.fragments, "transform": self.transforms, "mapping": self.mappings}[b.kind]
            if b.kind == "schema" and b.key in kinds:
                old = kinds[b.key]
                known = {f.name for f in old.fields}
                b = replace(old, fields=[*old.fields, *(f for f in b.fields if f.name not in known)], spreads=[*old.spreads, *b.spreads])
            kinds[b.key] = b
        self.cycles: list[tuple[str, str]] = []
        self.missing: list[tuple[str, str]] = []
        self.fields = {k: self._expand(s) for k, s in {**self.fragments, **self.schemas}.items()}

    @staticmethod
    def find(name: str, namespace: str | None, among: dict[str, Block]) -> str | None:
        """Qualified names match as they are; others in the current namespace, then bare."""
        name = name.removeprefix("::")
        if "::" in name:
            return name if name in among else None
        if namespace and f"{namespace}::{name}" in among:
            return f"{namespace}::{name}"
        return name if name in among else None

    @staticmethod
    def find_typed(name: str, among: dict[str, Block]) -> str | None:
        """A name as a user types it: exact, or the only one that ends in ::name."""
        name = name.removeprefix("::")
        if name in among:
            return name
        ends = [k for k in among if k.endswith(f"::{name}")]
        return ends[0] if len(ends) == 1 else None

    def is_metric(self, key: str) -> bool:
        return key in self.schemas and self.schemas[key].tag("metric")

    def _expand(self, block: Block) -> list[Field]:
        return self._with_spreads(block.fields, block.spreads, block, (block.key,), set())

    def _with_spreads(self, fields: list[Field], spreads: list[str], block: Block, path: tuple[str, ...], seen: set[str]) -> list[Field]:
        """Own fields, then those of spread fragments in their order; a fragment counts once, and a cycle is noted."""
        out = [replace(f, children=self._with_spreads(f.children, f.spreads, block, path, set()), spreads=[]) if f.is_record else f for f in fields]
        for name in spreads:
            key = self.find(name, block.namespace, self.fragments)
            if key is None:
                self.missing.append((block.key, name))
            elif key in path:
                self.cycles.append((block.key, key))
            elif key not in seen:
                seen.add(key)
                fragment = self.fragments[key]
                out += self._with_spreads(fragment.fields, fragment.spreads, fragment, (*path, key), seen)
        return out

    def paths(self, key: str) -> Iterator[tuple[str, Field, int]]:
        """Every field path below a schema or fragment, with its field and depth."""

        def walk(fields: list[Field], prefix: str, depth: int) -> Iterator[tuple[str, Field, int]]:
            for f in fields:
                yield prefix + f.name, f, depth
                yield from walk(f.children, f"{prefix}{f.name}.", depth + 1)

        yield from walk(self.fields.get(key, []), "", 0)
