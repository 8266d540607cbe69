"""Passes over the time lines of keys in sorted order, with hot keys cut by time.

A key's rows are dealt by (key, slot), a slot being some days, so that a key with very many rows is many tasks' work. What a slot needs from the ones before it, the last version before it begins,
comes from a table of one row per key and slot, which is aggregated before it is shuffled. Every pass is linear in the rows: no fact is paired with versions that it does not take.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

_BEFORE = (Window.unboundedPreceding, -1)


def slot(df: DataFrame, at: str, days: int) -> Column:
    """The number of the stretch of so many days (for numbers: so many units) that a time lies in; it never falls while the time grows."""
    kind = df.schema[at].dataType
    if isinstance(kind, TimestampType):  # instants: their dates may go back where clocks do
        return F.floor(F.unix_micros(F.col(at)) / (86_400_000_000 * days))
    if isinstance(kind, (DateType, TimestampNTZType)):
        return F.floor(F.unix_date(F.col(at).cast("date")) / days)
    if isinstance(kind, NumericType):
        return F.floor(F.col(at) / days)
    raise TypeError(f"{at} is no time: {kind.simpleString()}")


def as_of(facts: DataFrame, versions: DataFrame, keys: list[str], at: str, start: str = "valid_from", end: str | None = "valid_to", days: int = 1) -> DataFrame:
    """Each fact with the version of its key that was in force: the one with the greatest start <= at, if at < its end (null: open).

    Both sides are merged in one sorted pass that carries the last version along, so a key with many facts and many versions costs their sum, not their product. Versions of a key must not
    overlap. Of versions that start at the same time the one with the greatest hash counts. Null keys and times match nothing. versions' own columns, without the keys, follow those of facts.
    """
    if facts.schema[at].dataType != versions.schema[start].dataType:
        facts, versions = (df.withColumn("_at", F.col(c).cast("timestamp_ntz")) for df, c in ((facts, at), (versions, start)))
    else:
        facts, versions = facts.withColumn("_at", F.col(at)), versions.withColumn("_at", F.col(start))
    names = [f"_k{i}" for i in range(len(keys))]
    own = [c for c in facts.columns if c != "_at"]
    more = [c for c in versions.columns if c != "_at" and c not in keys]
    kind = versions.select(F.struct(*more).alias("v")).schema["v"].dataType
    known = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.col("_at").isNotNull())
    named = lambda df: [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)] + [slot(df, "_at", days).alias("_slot"), "_at"]
    f = facts.select(*named(facts), F.struct(*own).alias("_fact"), F.lit(None).cast(kind).alias("_version"))
    none = f.schema["_fact"].dataType
    v = versions.where(known).select(*named(versions), F.lit(None).cast(none).alias("_fact"), F.struct(*more).alias("_version"))
    place = ["_at", F.col("_fact").isNotNull(), F.xxhash64("_version")]
    inside = F.last("_version", ignorenulls=True).over(Window.partitionBy(*names, "_slot").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0))
    merged = f.unionByName(v).withColumn("_in", inside).where("_fact IS NOT NULL")
    ends = v.groupBy(*names, "_slot").agg(F.max_by("_version", F.struct("_at", F.xxhash64("_version"))).alias("_last"))
    asked = f.select(*names, "_slot").distinct().select("*", F.lit(None).cast(kind).alias("_last"))
    slots = asked.unionByName(ends).groupBy(*names, "_slot").agg(F.first("_last", ignorenulls=True).alias("_last"))
    carried = slots.select(*names, "_slot", F.last("_last", ignorenulls=True).over(Window.partitionBy(*names).orderBy("_slot").rowsBetween(*_BEFORE)).alias("_carried"))
    out = merged.join(carried, [*names, "_slot"], "left").withColumn("_version", F.coalesce("_in", "_carried"))
    if end is not None:
        until = F.col(f"_version.{end}").cast(facts.schema["_at"].dataType)
        out = out.withColumn("_version", F.when(until.isNull() | (F.col("_at") < until), F.col("_version")))
    return out.select("_fact.*", "_version.*")


def levels(changes: DataFrame, keys: list[str], at: str, values: list[str], until: Column, day: str = "snapshot_date") -> DataFrame:
    """A periodic snapshot without gaps: for each key and day, from its first change to ``until``, the values after the last change up to the end of that day.

    A day's last change is aggregated before the shuffle; of changes at one time that with the greatest hash counts. Then a key's days with a change, not its rows, are put in order, and each
    is repeated up to the next. Rows with a null key or time are left out.
    """
    known = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.col(at).isNotNull())
    by_day = changes.where(known).withColumn(day, F.col(at).cast("date")).where(F.col(day) <= until)
    last = by_day.groupBy(*keys, day).agg(F.max_by(F.struct(*values), F.struct(at, F.xxhash64(*values))).alias("_v"))
    following = F.lead(day).over(Window.partitionBy(*keys).orderBy(day))
    stretch = last.withColumn("_to", F.coalesce(F.date_sub(following, 1), until))
    return stretch.select(*keys, F.explode(F.sequence(day, "_to")).alias(day), "_v.*")


def running_levels(changes: DataFrame, keys: list[str], at: str, value: str, until: Column, day: str = "snapshot_date", balance: str = "balance") -> DataFrame:
    """Like levels, of an amount that changes add to: the balance of each key at the end of each day. Sums of a day come first, so only a key's days are put in order."""
    known = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.col(at).isNotNull())
    moved = changes.where(known).withColumn(day, F.col(at).cast("date")).where(F.col(day) <= until).groupBy(*keys, day).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_moved"))
    by = Window.partitionBy(*keys).orderBy(day)
    so_far = moved.select(*keys, day, F.sum("_moved").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias(balance), F.lead(day).over(by).alias("_next"))
    return so_far.select(*keys, F.explode(F.sequence(F.col(day), F.coalesce(F.date_sub("_next", 1), until))).alias(day), balance)


def point_in_time(hub: DataFrame, key: str, satellites: dict[str, DataFrame], dates: Sequence[Column], start: str = "load_date", days: int = 30) -> DataFrame:
    """A point-in-time table: a row for each key of the hub and snapshot date, with ``{name}_{start}`` of the version of each satellite that was in force, null where there was none.

    Joins on key and that column are equi joins, in whatever query comes later: the time line is searched once, here. Versions count as long as nothing newer starts.
    """
    pit = hub.select(key).distinct().select(key, F.explode(F.array(*dates)).alias("snapshot_date"))
    for name, rows in satellites.items():
        own = rows.select(key, F.col(start).alias(f"{name}_{start}"))
        pit = as_of(pit, own, [key], "snapshot_date", f"{name}_{start}", None, days)
    return pit


def in_force(hub: DataFrame, key: str, satellites: dict[str, DataFrame], dates: Sequence[Column], start: str = "load_date") -> DataFrame:
    """point_in_time with the columns of the versions in force, prefixed by their satellites' names: what with_satellites makes of it, for some dozens of dates.

    A satellite's rows are aggregated to one a key, with its version at each date, where the satellite has put them for its own order by key, so they move no more and no version is joined.
    Of versions that start at the same time the one with the greatest hash counts."""
    out = hub.select(key).distinct()
    dated = F.array(*dates)
    for name, rows in satellites.items():
        own = rows.select(key, F.struct(*(F.col(c).alias(f"{name}_{c}") for c in rows.columns if c != key)).alias("_v"), F.col(start).cast("timestamp_ntz").alias("_start"))
        known = own.where(F.col(key).isNotNull() & F.col("_start").isNotNull()).withColumn("_at", F.struct("_start", F.xxhash64("_v")))
        then = [F.max_by("_v", F.when(F.col("_start") <= d.cast("timestamp_ntz"), F.col("_at"))) for d in dates]
        out = out.join(known.groupBy(key).agg(F.array(*then).alias(f"_{name}")), key, "left")
    flat = out.select(key, F.posexplode(dated).alias("_i", "snapshot_date"), *(f"_{n}" for n in satellites))
    return flat.select(key, "snapshot_date", *(F.element_at(f"_{n}", F.col("_i") + 1).alias(f"_{n}") for n in satellites)).select(key, "snapshot_date", *(f"_{n}.*" for n in satellites))


def with_satellites(pit: DataFrame, key: str, satellites: dict[str, DataFrame], start: str = "load_date") -> DataFrame:
    """A point-in-time table with the columns of its satellites' versions, prefixed by their names: one equi join each."""
    for name, rows in satellites.items():
        own = rows.select(*(F.col(c).alias(c if c == key else f"{name}_{c}") for c in rows.columns))
        pit = pit.join(own, [key, f"{name}_{start}"], "left")
    return pit
