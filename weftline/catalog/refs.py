"""References in prose: where they stand, and what they mean."""

from __future__ import annotations

import re
from dataclasses import dataclass

from weftline.lang.names import Workspace
from weftline.lang.syntax import Block

_PART = r"(?:[A-Za-z_][A-Za-z0-9_-]*|`[^`]+`)"
_REF = re.compile(rf"(?:(?<=^)|(?<=[\s(\[{{,;]))@({_PART}(?:::{_PART})?(?:\.{_PART})*)", re.M)


@dataclass(frozen=True)
class Found:
    ref: str
    kind: str  # namespaced-field, namespaced-schema, dotted-field, bare
    row: int
    column: int
    schema: str | None
    field: str | None

    @property
    def resolved(self) -> bool:
        return self.schema is not None


def at_refs(text: str) -> list[tuple[str, int, int]]:
    """(reference without backticks, row, column) of each @reference: after the start, white space or an opening sign or separator, so not in addresses."""
    out = []
    for m in _REF.finditer(text):
        before = text[: m.start()]
        out.append((m.group(1).replace("`", ""), before.count("\n"), m.start() - (before.rfind("\n") + 1)))
    return out


def classify(ref: str) -> str:
    if "::" in ref:
        return "namespaced-field" if "." in ref.split("::", 1)[1] else "namespaced-schema"
    return "dotted-field" if "." in ref else "bare"


def resolve(ref: str, workspace: Workspace, mapping: Block | None) -> tuple[str | None, str | None]:
    """(schema key, field path) that a reference means; the field is None if it means a schema; (None, None) if nothing is found.

    First the mapping's own sources and target, in their order; then, for dotted references always and for bare ones outside mappings, any schema; then an entity of the
    namespace, then one without.
    """
    namespace = mapping.namespace if mapping else None
    has = lambda key, path: any(p == path for p, _, _ in workspace.paths(key))
    if "::" in ref:
        space, rest = ref.split("::", 1)
        head, _, path = rest.partition(".")
        key = f"{space}::{head}"
        if key in workspace.schemas and (not path or has(key, path)):
            return key, path or None
        return None, None
    own = []
    if mapping:
        for name in [*(s.name for s in mapping.sources if not s.is_prose), *mapping.targets]:
            key = workspace.find(name, namespace, workspace.schemas)
            if key:
                own.append(key)
    head, _, path = ref.partition(".")
    if path:
        for key in own:
            if key.split("::")[-1] == head and has(key, path):
                return key, path
    for key in own:
        if has(key, ref):
            return key, ref
    if path:
        key = workspace.find(head, namespace, workspace.schemas)
        if key and has(key, path):
            return key, path
    if path or not mapping:
        for key in sorted(workspace.schemas):
            if has(key, ref):
                return key, ref
    key = workspace.find(ref, namespace, workspace.schemas)
    return (key, None) if key else (None, None)


def find_refs(text: str, workspace: Workspace, mapping: Block | None) -> list[Found]:
    return [Found(ref, classify(ref), row, column, *resolve(ref, workspace, mapping)) for ref, row, column in at_refs(text)]
