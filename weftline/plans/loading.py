"""A mapping's load strategy, compiled from its tokens and its target's: what is there and what comes to what is there after the load.

A mapping says how its rows are merged (merge, match_on, on_match, on_no_match, delete_flag, delete_timestamp); a target schema says what history it keeps (scd 1, 2 or 6, natural_key, track, ignore).
The rows come from compile_mapping and the merge from the load operators, so all of it is one lazy plan. Nothing is written: the caller writes the result to a new path.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.lang.names import Workspace
from weftline.lang.syntax import Block
from weftline.operators import load
from weftline.plans.compile import Compiled, Options, compile_mapping

#: What the tokens may say.
STRATEGIES, ACTIONS = ("upsert", "append", "soft_delete", "full_refresh"), ("update", "insert", "skip", "error")
_HISTORY = ("valid_from", "valid_to", "is_current", "row_hash", "surrogate_key")


@dataclass
class Strategy:
    """merge and scd as declared (scd: 0 without a token); keys: match_on, else the target's natural_key; track: the fields whose change makes a version (empty: all but the keys and ignore)."""

    merge: str
    scd: int
    keys: list[str]
    on_match: str = "update"
    on_no_match: str = "insert"
    delete_flag: str | None = None
    delete_timestamp: str | None = None
    track: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)


def _several(block: Block | None, key: str) -> list[str]:
    """A token's value or values: ``match_on a`` or ``match_on {a, b}``."""
    for m in block.meta if block else ():
        if m.key == key:
            return list(m.values) or ([m.value] if m.value else [])
    return []


def strategy(workspace: Workspace, mapping: str) -> Strategy:
    """What a mapping's tokens and its target's say; an error where they contradict each other or lack what they need."""
    key = workspace.find_typed(mapping, workspace.mappings)
    if key is None:
        raise KeyError(f"no mapping {mapping!r}")
    block = workspace.mappings[key]
    target = workspace.schemas.get(workspace.find(block.targets[0], block.namespace, workspace.schemas) or "") if block.targets else None
    scd = target.value("scd") if target else None
    if scd not in (None, "1", "2", "6"):
        raise ValueError(f"scd {scd} is not known")
    merge = block.value("merge") or ("upsert" if scd else "full_refresh")
    if merge not in STRATEGIES:
        raise ValueError(f"merge {merge} is not known")
    keys = _several(block, "match_on") or _several(target, "natural_key")
    if merge in ("upsert", "soft_delete") and not keys:
        raise ValueError(f"merge {merge} needs match_on")
    flag = block.value("delete_flag")
    if merge == "soft_delete" and not flag:
        raise ValueError("merge soft_delete needs delete_flag")
    said = {k: block.value(k) or default for k, default in (("on_match", "update"), ("on_no_match", "insert"))}
    for k, action in said.items():
        if action not in ACTIONS or (k, action) in (("on_match", "insert"), ("on_no_match", "update")):
            raise ValueError(f"{k} {action} is not known")
    return Strategy(merge, int(scd or 0), keys, said["on_match"], said["on_no_match"], flag, block.value("delete_timestamp"), _several(target, "track"), _several(target, "ignore"))


def _opened(rows: DataFrame, how: Strategy) -> DataFrame:
    """An empty table with the columns that the rows of a first load need."""
    empty = rows.limit(0)
    if how.merge == "soft_delete":
        more = {how.delete_flag: "boolean"} | ({how.delete_timestamp: "timestamp_ntz"} if how.delete_timestamp else {})
        return empty.withColumns({c: F.lit(None).cast(kind) for c, kind in more.items() if c not in rows.columns})
    if how.scd in (2, 6):
        kinds = dict(zip(_HISTORY, ("timestamp_ntz", "timestamp_ntz", "boolean", "string", "string"), strict=True))
        return empty.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items()})
    return empty


def load_mapping(workspace: Workspace, mapping: str, inputs: dict[str, DataFrame], target: DataFrame | None = None, options: Options | None = None) -> Compiled:
    """The target's rows after the mapping has been run into it (None: it is empty), with the rows that have warnings and the prose that is unresolved.

    Upserts and versions raise where a key comes twice; append ignores match_on. Target columns without an arrow keep their values, and are null in new rows. A dimension of scd 2 gets valid_from,
    valid_to, is_current, row_hash and surrogate_key; one of scd 6 current_<field> of each tracked field as well. A version starts at Options.now, which loads of versions and deletions need.
    """
    options = options or Options()
    how = strategy(workspace, mapping)
    made = compile_mapping(workspace, mapping, inputs, options)
    rows = made.rows
    for k in how.keys if how.merge in ("upsert", "soft_delete") else ():
        if k not in rows.columns:
            raise ValueError(f"nothing is mapped to the key {k!r}")
    there = _opened(rows, how) if target is None else target
    if (how.scd in (2, 6) or how.merge == "soft_delete") and options.now is None:
        raise ValueError("the time of the load is missing: Options.now")
    if how.merge == "append":
        out = there.unionByName(rows, allowMissingColumns=True)
    elif how.merge == "full_refresh":
        out = rows
    elif how.merge == "soft_delete":
        if how.on_match == "skip":
            rows = rows.join(there.select(*how.keys), how.keys, "left_anti")
        out = load.soft_delete(there, rows, how.keys, how.delete_flag, how.delete_timestamp, options.now, how.on_no_match)
    elif how.scd in (2, 6):
        track = how.track or [c for c in rows.columns if c not in (*how.keys, *how.ignore)]
        plain = [c for c in there.columns if not c.startswith("current_") or c in rows.columns]
        out = load.scd2_merge(there.select(*plain), rows, how.keys, track, options.now)
        if how.scd == 6:
            out = load.scd6(out, how.keys, track)
    else:
        out = load.upsert(there, rows, how.keys, how.on_match, how.on_no_match)
    return Compiled(out, made.warnings, made.unresolved)
