"""Data quality and governance: declared constraints as violation rows, masks, retention and access tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.catalog.tables import Catalog
from weftline.lang.names import Workspace

#: Levels of classification from open to closed.
LEVELS = ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED")
FORMATS = {"email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$", "E.164": r"^\+[1-9][0-9]{1,14}$"}


def required(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that come more than once, with n."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def member(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows whose value is none of values; nulls pass."""
    return df.where(~F.col(column).cast("string").isin(*values))


def referential(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose value, not being null, is no key of parent."""
    keys = parent.select(F.col(key).alias("_key")).distinct()
    return df.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_key"), "left_anti")


def formatted(df: DataFrame, column: str, form: str) -> DataFrame:
    return df.where(~F.col(column).rlike(FORMATS[form]))


def checks(workspace: Workspace, schema: str, df: DataFrame, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """rule, field, n: how many rows of df break each constraint that the schema declares. One pass for all rules on single rows; one each for keys and references."""
    single: list[tuple[str, str, Column]] = []
    others: list[DataFrame] = []
    for path, f, _ in workspace.paths(schema):
        for m in f.meta:
            c = F.col(path)
            if m.key in ("required", "pk") and ("required", path) not in {x[:2] for x in single}:
                single.append(("required", path, c.isNull()))
            if m.key in ("pk", "unique"):
                others.append(unique(df.where(c.isNotNull()), [path]).agg(F.lit("unique").alias("rule"), F.lit(path).alias("field"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")))
            if m.kind == "enum":
                single.append(("enum", path, ~c.cast("string").isin(*m.values)))
            if m.key == "format" and m.value in FORMATS:
                single.append(("format", path, ~c.rlike(FORMATS[m.value])))
            if m.key == "ref" and m.value and parents:
                name, _, key = m.value.removeprefix("@").rpartition(".")
                if name in parents:
                    others.append(referential(df, path, parents[name], key).agg(F.lit("ref").alias("rule"), F.lit(path).alias("field"), F.count(F.lit(1)).alias("n")))
    counted = df.agg(*(F.count_if(bad).alias(f"c{i}") for i, (_, _, bad) in enumerate(single))) if single else None
    if counted is not None:
        rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(p).alias("field"), F.col(f"c{i}").alias("n")) for i, (r, p, _) in enumerate(single)))
        others.insert(0, counted.select(F.explode(rows).alias("x")).select("x.rule", "x.field", "x.n"))
    return reduce(DataFrame.union, others)


def mask(column: Column, how: str) -> Column:
    """partial_email keeps the first letter and the domain, last_four the last four characters; hash and redact keep nothing. Nulls stay null."""
    text = column.cast("string")
    return {
        "partial_email": lambda: F.regexp_replace(text, r"^(.)[^@]*(@.*)$", "$1***$2"),
        "last_four": lambda: F.concat(F.lit("****"), F.right(text, F.lit(4))),
        "hash": lambda: F.sha2(text, 256),
        "redact": lambda: F.when(text.isNotNull(), F.lit("REDACTED")),
    }[how]()


def masked(workspace: Workspace, schema: str, df: DataFrame) -> DataFrame:
    """df with every field masked that the schema masks."""
    how = {p: m.value for p, f, d in workspace.paths(schema) for m in f.meta if m.key == "mask" and m.value and d == 0}
    return df.select(*(mask(F.col(c), how[c]).alias(c) if c in how else F.col(c) for c in df.columns))


def access_view(workspace: Workspace, schema: str, df: DataFrame, clearance: str) -> DataFrame:
    """What a clearance may see: columns above it are masked if they say how, else left out."""
    level = {p: LEVELS.index(m.value.upper()) for p, f, d in workspace.paths(schema) for m in f.meta if m.key == "classification" and m.value and d == 0}
    how = {p: m.value for p, f, d in workspace.paths(schema) for m in f.meta if m.key == "mask" and m.value and d == 0}
    allowed = LEVELS.index(clearance.upper())
    out = []
    for c in df.columns:
        if level.get(c, 0) <= allowed:
            out.append(F.col(c))
        elif c in how:
            out.append(mask(F.col(c), how[c]).alias(c))
    return df.select(*out)


def duration(text: str) -> str:
    """3y, 90d, 6m or 2w as an interval."""
    return f"INTERVAL {int(text[:-1])} {dict(y='YEAR', m='MONTH', w='WEEK', d='DAY')[text[-1]]}"


def expired(anchor: str, keep: str, now: Column) -> Column:
    return F.col(anchor) < now - F.expr(duration(keep))


def retain(df: DataFrame, anchor: str, keep: str, now: Column, null_out: list[str] | None = None) -> DataFrame:
    """Without rows whose anchor is older than keep; or, with null_out, with those columns emptied in such rows."""
    old = F.coalesce(expired(anchor, keep, now), F.lit(False))
    if null_out is None:
        return df.where(~old)
    return df.select(*(F.when(~old, F.col(c)).alias(c) if c in null_out else F.col(c) for c in df.columns))


def with_threshold(df: DataFrame, bad: Column, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows); the good ones raise an error if the share of rejected ones is over threshold."""
    bad = F.coalesce(bad, F.lit(False))
    share = df.agg(F.avg(bad.cast("double")).alias("_share"))
    said = F.when(F.col("_share") > threshold, F.raise_error(F.lit("too many rows are rejected")).cast("boolean")).otherwise(True)
    return df.where(~bad).join(F.broadcast(share), F.lit(True)).where(said).drop("_share"), df.where(bad)


def propagated(c: Catalog) -> DataFrame:
    """field, classification, retention_days, pii: of each target field, the highest classification, the shortest retention and any personal data of the fields it comes from."""
    shown = F.when(F.col("owner").contains("::"), F.col("owner")).otherwise(F.concat(F.lit("::"), F.col("owner")))
    meta = c.metadata.where("owner_kind = 'field'").select(F.concat_ws(".", shown, "field").alias("src"), "key", "value")
    level = F.array_position(F.array(*map(F.lit, LEVELS)), F.upper("value"))
    unit = F.when(F.right("value", F.lit(1)) == "y", 365).when(F.right("value", F.lit(1)) == "m", 30).when(F.right("value", F.lit(1)) == "w", 7).otherwise(1)
    days = F.expr("substr(value, 1, length(value) - 1)").try_cast("int") * unit
    joined = c.fedges.select("src", "dst").join(meta, "src")
    got = joined.groupBy(F.col("dst").alias("field")).agg(
        F.max(F.when(F.col("key") == "classification", level)).alias("_level"), F.min(F.when(F.col("key") == "retention", days)).alias("retention_days"),
        F.coalesce(F.bool_or(F.col("key") == "pii"), F.lit(False)).alias("pii"),
    )
    return got.select("field", F.get(F.array(*map(F.lit, LEVELS)), (F.col("_level") - 1).cast("int")).alias("classification"), "retention_days", "pii")
