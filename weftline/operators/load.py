"""Load strategies as pure functions from the rows that are there and those that come to the rows after the load.

Nothing is written here: a caller writes the result to a new path, or with a table format's own merge. One shuffle by key for each strategy that matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import timeline


def _checked(source: DataFrame, keys: list[str]) -> DataFrame:
    """source, which raises where a key comes twice: a match would be ambiguous."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return source.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit("a key comes twice in the source"))).otherwise(F.lit(True)).cast("boolean")).drop("_n")


def _paired(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows t and s of equal keys, or one of them; nulls are equal to nulls, so that a load that is run again changes nothing."""
    t = target.select(F.struct(*target.columns).alias("t"), *(F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)))
    s = source.select(F.struct(*source.columns).alias("s"), *(F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)))
    same = reduce(lambda a, b: a & b, (F.col(f"_t{i}").eqNullSafe(F.col(f"_s{i}")) for i in range(len(keys))))
    both = t.join(s, same, "full_outer")
    return both.select("t", "s", *(F.coalesce(F.col(f"_t{i}"), F.col(f"_s{i}")).alias(k) for i, k in enumerate(keys)))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], on_match: str = "update", on_no_match: str = "insert", check: bool = True) -> DataFrame:
    """Matching rows take the source's values, others are inserted; the rest stays. on_match: update, skip or error; on_no_match: insert, skip or error."""
    both = _paired(target, _checked(source, keys) if check else source, keys)
    has_t, has_s = F.col("t").isNotNull(), F.col("s").isNotNull()
    for wanted, when, text in ((on_match, has_t & has_s, "a row matches"), (on_no_match, ~has_t & has_s, "a row does not match")):
        if wanted == "error":
            both = both.where(F.when(when, F.raise_error(F.lit(text)).cast("boolean")).otherwise(True))
    if on_no_match == "skip":
        both = both.where(has_t)
    from_source = (has_s & ~has_t) if on_match == "skip" else has_s
    out = []
    for c in target.columns:
        new = F.col(f"s.{c}") if c in source.columns else F.col(f"t.{c}")
        out.append(F.when(from_source, new).otherwise(F.col(f"t.{c}")).alias(c))
    return both.select(*out)


def append(target: DataFrame, source: DataFrame) -> DataFrame:
    return target.unionByName(source)


def full_refresh(target: DataFrame, source: DataFrame) -> DataFrame:
    return source.select(*target.columns)


def soft_delete(target: DataFrame, deleted: DataFrame, keys: list[str], flag: str = "is_deleted", at: str | None = None, now: Column | None = None, on_no_match: str = "insert") -> DataFrame:
    """Rows whose key comes in deleted are flagged, with the time; keys that are not there are inserted as deleted, or skipped."""
    both = _paired(target, deleted, keys)
    gone, there = F.col("s").isNotNull(), F.col("t").isNotNull()
    if on_no_match == "skip":
        both = both.where(there)
    now = F.current_timestamp() if now is None else now
    out = []
    for c in target.columns:
        if c == flag:
            out.append(F.when(gone, True).otherwise(F.col(f"t.{c}")).alias(c))
        elif c == at:
            out.append(F.when(gone, now).otherwise(F.col(f"t.{c}")).alias(c))
        elif c in deleted.columns:
            out.append(F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")).alias(c))
        else:
            out.append(F.col(f"t.{c}").alias(c))
    return both.select(*out)


def _joined(values: list[Column], by: str) -> Column:
    """Texts in one, from which each can be told: a separator or backslash inside a value has a backslash before it, and a null is a backslash and an N."""
    escaped = (F.regexp_replace(v.cast("string"), r"([\\|])", r"\\$1") for v in values)
    return F.concat_ws(by, *(F.coalesce(v, F.lit("\\N")) for v in escaped))


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the columns; different values have different texts, and nulls are told from any of them."""
    return F.sha2(_joined([F.col(c) for c in columns], "|"), 256)


def _one_at_a_time(rows: DataFrame, keys: list[str], at: str, digest: str) -> DataFrame:
    """rows, of those of a key at the same time only the one with the greatest digest: whatever order rows come in, the same one is kept."""
    after = F.lead(at).over(Window.partitionBy(*keys).orderBy(at, digest))
    return rows.withColumn("_after", after).where(F.col("_after").isNull() | (F.col("_after") != F.col(at))).drop("_after")


def scd2_history(snapshots: DataFrame, keys: list[str], at: str, track: list[str]) -> DataFrame:
    """Versions from all snapshots of each key: valid_from, valid_to (open: null), is_current, row_hash, surrogate_key. A version starts where a tracked column changes.
    Of snapshots at the same time the one with the greatest hash counts."""
    by = Window.partitionBy(*keys).orderBy(at, "row_hash")
    hashed = _one_at_a_time(snapshots.withColumn("row_hash", row_hash(track)), keys, at, "row_hash")
    starts = hashed.withColumn("_was", F.lag("row_hash").over(by)).where(F.col("_was").isNull() | (F.col("_was") != F.col("row_hash"))).drop("_was")
    closed = starts.withColumn("valid_to", F.lead(at).over(by)).withColumnRenamed(at, "valid_from")
    return closed.withColumn("is_current", F.col("valid_to").isNull()).withColumn("surrogate_key", F.sha2(_joined([*map(F.col, keys), F.col("valid_from")], "|"), 256))


def scd2_merge(dimension: DataFrame, source: DataFrame, keys: list[str], track: list[str], now: Column) -> DataFrame:
    """A dimension with versions after a load: changed current versions are closed at now, and new versions open; keys that don't come stay as they are."""
    new = _checked(source, keys).withColumn("row_hash", row_hash(track))
    _, same = _keys_of(new, keys)
    current = dimension.where("is_current").select(*(F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)), F.col("row_hash").alias("_old"))
    differing = new.join(current, same, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("row_hash"))).select(*new.columns)
    key = F.sha2(_joined([*map(F.col, keys), now], "|"), 256)
    opened = differing.withColumns({"valid_from": now, "valid_to": F.lit(None).cast("timestamp_ntz"), "is_current": F.lit(True), "surrogate_key": key})
    changed, same = _keys_of(differing, keys)
    closed = dimension.join(changed.withColumn("_changed", F.lit(True)), same, "left")
    closing = F.col("is_current") & F.coalesce("_changed", F.lit(False))
    closed = closed.withColumns({"valid_to": F.when(closing, now).otherwise(F.col("valid_to")), "is_current": F.col("is_current") & ~closing}).select(*dimension.columns)
    return closed.unionByName(opened.select(*(F.col(c).cast(dimension.schema[c].dataType) for c in dimension.columns if c in opened.columns)), allowMissingColumns=True)


def scd2_arrivals(versions: DataFrame, sightings: DataFrame, source: DataFrame, keys: list[str], at: str, track: list[str]) -> tuple[DataFrame, DataFrame]:
    """(versions, sightings) after rows have come whose time may lie in the past: whatever order rows arrive in, the versions are those of scd2_history over all of them.

    A change for the past splits the version that was in force then, or moves a start back, or goes into one that says the same. To know where the split one resumes, what was seen when is kept:
    sightings(keys, at, track), a row for each key and time, the one with the greatest hash where several came. Only the keys that come are derived again, from their own sightings; the versions of
    all others pass unchanged. Rows without a time are left out; null keys are keys.
    """
    named = [*keys, at, *track]
    new = source.where(F.col(at).isNotNull()).select(*named)
    touched, same = _keys_of(new, keys)
    seen = sightings.select(*named)
    told = seen.join(touched, same, "left_semi").unionByName(new).withColumn("row_hash", row_hash(track))
    told = _one_at_a_time(told, keys, at, "row_hash").drop("row_hash")
    again = scd2_history(told, keys, at, track)
    return versions.join(touched, same, "left_anti").unionByName(again.select(*versions.columns)), seen.join(touched, same, "left_anti").unionByName(told)


def _keys_of(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """The distinct keys of rows, under names of their own, and the condition that they are the keys of a row of another table; nulls are equal to nulls."""
    distinct = rows.select(*(F.col(k).alias(f"_t{i}") for i, k in enumerate(keys))).distinct()
    return distinct, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_t{i}")) for i, k in enumerate(keys)))


def scd6(history: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """A history of versions with current_<field> on every row."""
    by = Window.partitionBy(*keys).orderBy("valid_from").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return history.withColumns({f"current_{f}": F.last(f).over(by) for f in fields})


def hash_key(columns: list[str]) -> Column:
    """A vault's hash key: upper-case, trimmed business keys."""
    return F.sha2(_joined([F.upper(F.trim(F.col(c).cast("string"))) for c in columns], "||"), 256)


def hub(source: DataFrame, business: list[str], name: str, load_date: str, record_source: Column, existing: DataFrame | None = None) -> DataFrame:
    """One row for each business key, the first that came, without those that are there."""
    keyed = source.where(~_any_null(business)).select(hash_key(business).alias(f"{name}_hk"), *business, F.col(load_date).alias("load_date"), record_source.alias("record_source"))
    first = keyed.groupBy(f"{name}_hk", *business).agg(F.min_by("record_source", "load_date").alias("record_source"), F.min("load_date").alias("load_date"))
    return first if existing is None else first.join(existing.select(f"{name}_hk"), f"{name}_hk", "left_anti")


def _any_null(columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def satellite(source: DataFrame, business: list[str], name: str, fields: list[str], load_date: str) -> DataFrame:
    """A row for each change of the fields, with load_end_date where the next one starts; rows without a key belong to no hub and are left out. Of rows at the same time the one with the
    greatest hash counts."""
    hashed = source.where(~_any_null(business)).select(hash_key(business).alias(f"{name}_hk"), row_hash(fields).alias("hash_diff"), *fields, F.col(load_date).alias("load_date"))
    hashed = _one_at_a_time(hashed, [f"{name}_hk"], "load_date", "hash_diff")
    by = Window.partitionBy(f"{name}_hk").orderBy("load_date", "hash_diff")
    changed = hashed.withColumn("_was", F.lag("hash_diff").over(by)).where(F.col("_was").isNull() | (F.col("_was") != F.col("hash_diff"))).drop("_was")
    return changed.withColumn("load_end_date", F.lead("load_date").over(by))


def link(source: DataFrame, hubs: dict[str, list[str]], name: str, load_date: str) -> DataFrame:
    """One row for each combination of hub keys: a key for each hub and one of its own."""
    every = [c for columns in hubs.values() for c in columns]
    keyed = source.where(~_any_null(every)).select(hash_key(every).alias(f"{name}_hk"), *(hash_key(c).alias(f"{h}_hk") for h, c in hubs.items()), F.col(load_date).alias("load_date"))
    return keyed.groupBy(f"{name}_hk", *(f"{h}_hk" for h in hubs)).agg(F.min("load_date").alias("load_date"))


def effectivity(links: DataFrame, driving: list[str], start: str) -> DataFrame:
    """When each link of a driving key was in force: start_date, end_date, is_current."""
    return links.withColumnRenamed(start, "start_date").withColumn("end_date", F.lead("start_date").over(Window.partitionBy(*driving).orderBy("start_date"))).withColumn("is_current", F.col("end_date").isNull())


def current(versions: DataFrame) -> DataFrame:
    """The versions that no later one ended."""
    return versions.where("load_end_date IS NULL")


def as_of(facts: DataFrame, versions: DataFrame, keys: list[str], at: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Each fact with the version of its key that was in force: start <= at < end, an open end being null. Versions of a key must not overlap; see timeline.as_of."""
    return timeline.as_of(facts, versions, keys, at, start, end)


def with_dimension_keys(facts: DataFrame, dimensions: dict[str, tuple[DataFrame, str, str]], batch: str | None = None, now: Column | None = None) -> DataFrame:
    """facts with {dim}_key for each dimension (rows, natural key, the facts' column), from its current version; facts that match none keep a null key. With a
    batch also etl_batch_id and loaded_at."""
    for name, (rows, natural, column) in dimensions.items():
        keys = rows.where("is_current").select(F.col(natural).alias("_natural"), F.col("surrogate_key").alias(f"{name}_key"))
        facts = facts.join(keys, facts[column] == keys["_natural"], "left").drop("_natural")
    if batch is not None:
        facts = facts.withColumns({"etl_batch_id": F.lit(batch), "loaded_at": F.current_timestamp() if now is None else now})
    return facts


def grain_violations(facts: DataFrame, grain: list[str]) -> DataFrame:
    """Combinations of the grain's columns that come more than once."""
    return facts.groupBy(*grain).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def periodic_snapshot(snapshots: DataFrame, state: DataFrame, date: Column) -> DataFrame:
    """The snapshots so far with the state of a date; a date that is there is replaced."""
    new = state.withColumn("snapshot_date", date)
    return snapshots.join(new.select("snapshot_date").distinct(), "snapshot_date", "left_anti").unionByName(new)


def accumulating_snapshot(target: DataFrame, events: DataFrame, keys: list[str], milestone: str, at: str, milestones: list[str]) -> DataFrame:
    """One row a key with the first time of each milestone; what was there before stays."""
    new = events.groupBy(*keys).agg(*(F.min(F.when(F.col(milestone) == m, F.col(at))).alias(m) for m in milestones))
    both = _paired(target, new, keys)
    return both.select(*keys, *(F.coalesce(F.col(f"t.{m}"), F.col(f"s.{m}")).alias(m) for m in milestones))
