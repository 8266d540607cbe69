"""Retention over tables that reference each other, rejection of bad rows in one pass, and what a job may go on with.

Rows that have outlived their retention go; what becomes of the rows that reference them, and of those that these reference, is settled until nothing changes, so that every table stays
referentially whole. References may form cycles, a table may reference itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftline.lang.names import Workspace
from weftline.storage import cut_lineage, fresh_dir

#: What happens to a row whose parent goes: it goes too, it keeps its parent, or its reference becomes null.
ACTIONS = ("cascade", "restrict", "null")


@dataclass(frozen=True)
class Reference:
    child: str
    column: str
    parent: str
    action: str = "cascade"


def references(workspace: Workspace, tables: list[str], actions: dict[tuple[str, str], str] | None = None) -> tuple[dict[str, str], list[Reference]]:
    """(primary key of each table, references between them), as declared by ``pk`` and ``ref``. actions: by (table, column), cascade where nothing is said."""
    keys: dict[str, str] = {}
    found = []
    for t in tables:
        for path, f, _ in workspace.paths(t):
            for m in f.meta:
                if m.key == "pk":
                    keys.setdefault(t, path)
                elif m.key == "ref" and m.value:
                    parent = m.value.removeprefix("@").rpartition(".")[0]
                    if parent in tables:
                        found.append(Reference(t, path, parent, (actions or {}).get((t, path), "cascade")))
    for r in found:
        if r.action not in ACTIONS:
            raise ValueError(f"{r.action} is not known")
        if r.parent not in keys:
            raise ValueError(f"{r.parent} has no primary key")
    return keys, found


def _spread(start: dict[str, DataFrame], step: Callable[[str, DataFrame], dict[str, DataFrame]], tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Ids by table, from start until no step adds any; a step gets only what the last one added. Each round's ids are cut from their history."""
    known = {t: cut_lineage(ids.distinct()) for t, ids in start.items()}
    fresh = {t: ids for t, ids in known.items() if not ids.isEmpty()}
    while fresh:
        added: dict[str, list[DataFrame]] = {}
        for t, ids in fresh.items():
            for other, more in step(t, ids).items():
                added.setdefault(other, []).append(more)
        fresh = {}
        for t, parts in added.items():
            new = reduce(DataFrame.union, parts).distinct()
            new = cut_lineage(new.join(known[t], "_id", "left_anti") if t in known else new)
            if not new.isEmpty():
                fresh[t] = new
                known[t] = known[t].union(new) if t in known else new
    return known


def retain_whole(tables: dict[str, DataFrame], keys: dict[str, str], refs: list[Reference], expired: dict[str, Column]) -> dict[str, DataFrame]:
    """The tables without what has expired (a condition per table; null: no), and referentially as whole as they were.

    Under ``cascade`` a row goes with its parent, under ``null`` its reference is emptied, and under ``restrict`` an expired parent stays while a row that has not expired references it; then the parents
    that would take it along by cascade stay as well. Rows that reference nothing, or a row that was never there, are left as they are. A table without a primary key has no children; its own rows go by their
    whole contents. Each round is a semi-join of the tables' keys with the ids of the last round: as many rounds as the longest chain of references.
    """
    old = {t: F.coalesce(c, F.lit(False)) for t, c in expired.items()}

    def parents(t: str, ids: DataFrame, of: Callable[[Reference], bool]) -> dict[str, list[DataFrame]]:
        """The parents of rows of t that have these ids."""
        out: dict[str, list[DataFrame]] = {}
        for r in refs:
            if r.child == t and of(r):
                rows = tables[t].select(F.col(keys[t]).alias("_id"), F.col(r.column).alias("_up")).where("_up IS NOT NULL")
                out.setdefault(r.parent, []).append(rows.join(ids, "_id", "left_semi").select(F.col("_up").alias("_id")))
        return out

    def merged(found: dict[str, list[DataFrame]]) -> dict[str, DataFrame]:
        return {t: reduce(DataFrame.union, parts) for t, parts in found.items()}

    # what stays though it has expired: parents of rows that have not, under restrict, and whatever would take these along
    held: dict[str, list[DataFrame]] = {}
    for r in refs:
        if r.action == "restrict":
            live = tables[r.child].where(~old[r.child]) if r.child in old else tables[r.child]
            held.setdefault(r.parent, []).append(live.where(F.col(r.column).isNotNull()).select(F.col(r.column).alias("_id")))
    kept = _spread(merged(held), lambda t, ids: merged(parents(t, ids, lambda r: r.action != "null")), tables) if held else {}
    gone_at_first = {}
    for t, condition in old.items():
        if t in keys:
            ids = tables[t].where(condition).select(F.col(keys[t]).alias("_id"))
            gone_at_first[t] = ids.join(kept[t], "_id", "left_anti") if t in kept else ids

    def children(t: str, ids: DataFrame) -> dict[str, DataFrame]:
        out: dict[str, list[DataFrame]] = {}
        for r in refs:
            if r.parent == t and r.action == "cascade" and r.child in keys:
                rows = tables[r.child].select(F.col(keys[r.child]).alias("_id"), F.col(r.column).alias("_up"))
                out.setdefault(r.child, []).append(rows.join(ids.select(F.col("_id").alias("_up")), "_up", "left_semi").select("_id"))
        return merged(out)

    gone = _spread(gone_at_first, children, tables) if gone_at_first else {}
    out = {}
    for t, rows in tables.items():
        columns = rows.columns
        if t not in keys and t in old:
            rows = rows.where(~old[t])
        elif t in gone:
            rows = rows.join(gone[t], rows[keys[t]] == gone[t]["_id"], "left_anti")
        for r in refs:
            if r.child == t and r.parent in gone:
                lost = gone[r.parent].select(F.col("_id").alias("_lost"))
                if r.action == "null":
                    rows = rows.join(lost, rows[r.column] == F.col("_lost"), "left").withColumn(r.column, F.when(F.col("_lost").isNull(), F.col(r.column))).drop("_lost")
                elif t not in keys:
                    rows = rows.join(lost, rows[r.column] == F.col("_lost"), "left_anti")
        out[t] = rows.select(*columns)
    return out


@dataclass
class Checked:
    """good and rejected rows (with ``reasons``), and how many rows there were and broke each rule."""

    good: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


class TooManyRejected(ValueError):
    pass


def checked(df: DataFrame, rules: dict[str, Column], threshold: float | None = None, name: str = "checked") -> Checked:
    """df in good and rejected rows, by one pass: it is read and written once, and the counts are observed by the job that writes. rules: what is wrong with a row (null: nothing), by name.

    Where more than the share ``threshold`` of the rows is rejected, TooManyRejected names the counts, and no rows are given.
    """
    broken = {n: F.coalesce(c, F.lit(False)) for n, c in rules.items()}
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in broken.items())))
    told = df.withColumn("reasons", reasons).withColumn("rejected", F.size("reasons") > 0)
    seen = Observation()
    watched = told.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if("rejected").alias("rejected"), *(F.count_if(F.array_contains("reasons", n)).alias(f"rule {n}") for n in rules)
    )
    path = fresh_dir(df.sparkSession, name)
    watched.write.partitionBy("rejected").parquet(path)
    counts = {k.removeprefix("rule "): v for k, v in seen.get.items()}
    if threshold is not None and counts["rejected"] > threshold * counts["rows"]:
        raise TooManyRejected(f"{counts['rejected']} of {counts['rows']} rows are rejected: {counts}")
    read = df.sparkSession.read.schema(told.schema).parquet(path)
    return Checked(read.where("NOT rejected").select(*df.columns), read.where("rejected").drop("rejected"), counts)
