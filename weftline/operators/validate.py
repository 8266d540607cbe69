"""Rules over a specification, each a DataFrame of rule, severity, subject and message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.catalog.tables import Catalog

#: Columns that conventions add to a schema, by the tag that asks for them.
CONVENTION = {
    "hub": ("load_date", "record_source"), "link": ("load_date", "record_source"), "satellite": ("load_date", "record_source", "load_end_date", "hash_diff"),
    "dimension": ("valid_from", "valid_to", "is_current", "surrogate_key", "row_hash"), "fact": ("etl_batch_id", "loaded_at"),
}
#: Step names that prose may refer to without meaning a field; lint leaves them out.
STEP_WORDS = (
    "trim", "lowercase", "uppercase", "coalesce", "round", "split", "first", "last", "to_utc", "to_iso8601", "parse", "null_if_empty", "null_if_invalid", "drop_if_invalid", "drop_if_null",
    "warn_if_invalid", "warn_if_null", "error_if_invalid", "error_if_null", "validate_email", "now_utc", "title_case", "escape_html", "truncate", "to_number", "prepend", "max_length",
)


def _rows(df: DataFrame, rule: str, severity: str, subject: Column | str, message: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), (F.col(subject) if isinstance(subject, str) else subject).alias("subject"), message.alias("message"))


def duplicate_definitions(c: Catalog) -> DataFrame:
    """A name that was defined before in its namespace, whatever the kinds."""
    order = Window.partitionBy("namespace", "name").orderBy("seq")
    again = c.definitions.where("name IS NOT NULL").withColumn("r", F.row_number().over(order)).where("r > 1")
    return _rows(again, "duplicate-definition", "error", "key", F.concat(F.lit("defined again as "), F.col("kind")))


def namespace_conflicts(c: Catalog) -> DataFrame:
    clash = c.namespaces.where("note IS NOT NULL").groupBy("name").agg(F.count_distinct("note").alias("n")).where("n > 1")
    return _rows(clash, "namespace-metadata-conflict", "error", "name", F.concat(F.col("n").cast("string"), F.lit(" different notes")))


def undefined_references(c: Catalog) -> DataFrame:
    """Sources, targets, metric sources, spreads, transforms and ref tags that name nothing; the message lists what has that name in a namespace."""
    used = c.dependencies.where("kind IN ('mapping', 'metric', 'fragment_spread', 'transform_call', 'ref_metadata')")
    known = c.definitions.select(F.col("key").alias("dst")).distinct()
    lost = used.join(known, "dst", "left_anti").select("src", "dst", "kind").distinct()
    near = c.definitions.where("namespace IS NOT NULL").groupBy(F.col("name").alias("dst")).agg(F.array_join(F.array_sort(F.collect_set("key")), ", ").alias("hint"))
    told = lost.join(near, "dst", "left")
    return _rows(told, "undefined-ref", "warning", "src", F.concat(F.col("kind"), F.lit(" "), F.col("dst"), F.coalesce(F.concat(F.lit("; there is "), F.col("hint")), F.lit(""))))


def unresolved_prose(c: Catalog) -> DataFrame:
    """References in prose that name nothing, step names among them."""
    return _unresolved(c.nl_refs)


def unresolved_in_lint(c: Catalog) -> DataFrame:
    """The lint form: the name of a step is an instruction and no reference."""
    return _unresolved(c.nl_refs.where(~F.col("ref").isin(*STEP_WORDS)))


def _unresolved(refs: DataFrame) -> DataFrame:
    lost = refs.where("schema IS NULL")
    return _rows(lost, "unresolved-nl-ref", "warning", "owner", F.concat(F.lit("@"), F.col("ref")))


def _outside(c: Catalog) -> DataFrame:
    """References of mappings, not in notes, to schemas that they don't declare."""
    declared = c.mappings.select("key", F.explode(F.concat("sources", F.array("target"))).alias("schema"))
    refs = c.nl_refs.where("mapping IS NOT NULL AND schema IS NOT NULL AND context <> 'note'")
    return refs.join(declared, (refs["mapping"] == declared["key"]) & (refs["schema"] == declared["schema"]), "left_anti")


def prose_not_in_source(c: Catalog) -> DataFrame:
    return _rows(_outside(c), "nl-ref-not-in-source", "warning", "mapping", F.concat(F.lit("@"), F.col("ref")))


def hidden_sources(c: Catalog) -> DataFrame:
    """The lint form of the same finding: one row for each mapping and schema, which a fix would add to the sources."""
    return _rows(_outside(c).select("mapping", "schema").distinct(), "hidden-source-in-nl", "error", "mapping", F.concat(F.lit("add source "), F.col("schema")))


def _convention_fields(c: Catalog) -> DataFrame:
    """owner, path of the columns that a schema has by convention: by its tags (a dimension's only with history, scd 2 or 6), and the hash keys of hubs and links, of a
    satellite's parent and of a link's hubs."""
    meta = c.metadata.where("owner_kind = 'block'")
    tags = meta.select("owner", F.col("key").alias("tag"))
    history = meta.where("key = 'scd' AND value IN ('2', '6')").select("owner").distinct()
    kept = tags.where("tag <> 'dimension'").union(tags.where("tag = 'dimension'").join(history, "owner", "left_semi"))
    extra = c.spark.createDataFrame([(t, p) for t, ps in CONVENTION.items() for p in ps], "tag string, path string")
    names = c.schemas.where("kind = 'schema'").select(F.col("key").alias("owner"), "name")
    own = tags.where("tag IN ('hub', 'link')").join(names, "owner").select("owner", "name")
    listed = F.concat(F.split(F.coalesce("value", F.lit("")), ","), F.coalesce("values", F.array().cast("array<string>")))
    others = [meta.where(F.col("key") == key).join(tags.where(F.col("tag") == tag), "owner", "left_semi").select("owner", F.explode(listed).alias("name")).select("owner", F.trim("name").alias("name")) for tag, key in (("satellite", "parent"), ("link", "link_hubs"))]
    keys = own.union(others[0]).union(others[1]).where("name <> ''").select("owner", F.concat("name", F.lit("_hk")).alias("path"))
    return kept.join(extra, "tag").select("owner", "path").union(keys)


def fields_not_in_schema(c: Catalog) -> DataFrame:
    """Arrow paths that no field has. Paths that start with a dot are valid, as are a convention's columns; schemas whose spreads are missing are not checked."""
    m = c.mappings
    paths = c.fields.select("owner", "path")
    valid = paths.union(_convention_fields(c)).distinct()
    known = c.schemas.where("kind = 'schema'").select(F.col("key").alias("owner"))
    open_ = c.spark.createDataFrame([(k,) for k, _ in c.workspace.missing] or [("",)], "owner string")
    target = c.arrows.join(m.select(F.col("key").alias("mapping"), F.col("target").alias("owner")), "mapping").select("mapping", "owner", F.col("target").alias("path"))
    e = c.fedges.where("classification <> 'nl-derived'").select("mapping", "src")
    source = e.select("mapping", F.regexp_replace(F.regexp_extract("src", r"^((?:[^.:]*::)?[^.]*)\.", 1), "^::", "").alias("owner"), F.regexp_extract("src", r"^[^.]*\.(.*)$", 1).alias("path"))
    both = target.union(source).join(known, "owner", "left_semi").join(open_, "owner", "left_anti")
    lost = both.join(valid, ["owner", "path"], "left_anti").distinct()
    return _rows(lost, "field-not-in-schema", "warning", "mapping", F.concat_ws(".", "owner", "path"))


def circular_spreads(c: Catalog) -> DataFrame:
    rows = c.spark.createDataFrame(sorted(set(c.workspace.cycles)) or [], "owner string, fragment string")
    return _rows(rows, "circular-spread", "error", "owner", F.col("fragment"))


def imports(c: Catalog) -> DataFrame:
    """Imported names that no file of the workspace defines, and files that are missing."""
    lost = c.imports.join(c.definitions.select(F.col("key").alias("name")), "name", "left_anti")
    missing = c.diagnostics.where("message LIKE 'missing import%'")
    return _rows(lost, "undefined-import", "warning", "file", F.col("name")).union(_rows(missing, "missing-import", "warning", "file", F.col("message")))


def parse_errors(c: Catalog) -> DataFrame:
    return _rows(c.diagnostics.where("message NOT LIKE 'missing import%'"), "parse-error", "error", "file", F.concat(F.col("row").cast("string"), F.lit(": "), F.left("message", F.lit(40))))


def import_scope(c: Catalog) -> DataFrame:
    """Blocks that a file uses and that exist, but in no file that it reaches by imports."""
    import posixpath

    files = {m.file: [posixpath.normpath(posixpath.join(posixpath.dirname(m.file), p)) for _, p, _ in m.imports] for m in c.workspace.modules}
    reachable = []
    for start in files:
        seen, waiting = set(), [start]
        while waiting:
            f = waiting.pop()
            if f in files and f not in seen:
                seen.add(f)
                waiting += files[f]
        reachable += [(start, f) for f in seen]
    reach = c.spark.createDataFrame(reachable, "file string, home string")
    used = c.dependencies.where("kind IN ('mapping', 'metric', 'fragment_spread', 'transform_call', 'ref_metadata')").select("file", "src", "dst").distinct()
    homes = c.definitions.select(F.col("key").alias("dst"), F.col("file").alias("home"))
    lost = used.join(homes, "dst").join(reach, ["file", "home"], "left").join(used.join(homes, "dst").join(reach, ["file", "home"], "left_semi").select("file", "src", "dst").distinct(), ["file", "src", "dst"], "left_anti")
    return _rows(lost.select("src", "dst", "home").distinct(), "import-scope", "error", "src", F.concat_ws(" in ", "dst", "home"))


def merge_rules(c: Catalog) -> DataFrame:
    """Conventions of load strategies: what a merge strategy needs or doesn't take."""
    meta = c.metadata.where("owner_kind = 'mapping'").groupBy("owner").agg(F.map_from_entries(F.collect_list(F.struct("key", F.coalesce("value", F.lit(""))))).alias("m"))
    has = lambda k: F.map_contains_key("m", k)
    strategy = F.col("m")["merge"]
    rows = meta.where(has("merge"))
    checks = [
        ("merge-unknown", "error", ~strategy.isin("upsert", "append", "soft_delete", "full_refresh"), "unknown strategy"),
        ("merge-needs-match-on", "error", strategy.isin("upsert", "soft_delete") & ~has("match_on"), "match_on is missing"),
        ("merge-needs-delete-flag", "warning", (strategy == "soft_delete") & ~has("delete_flag"), "delete_flag is missing"),
        ("merge-append-match-on", "warning", strategy.isin("append", "full_refresh") & has("match_on"), "match_on has no effect"),
    ]
    out = None
    for rule, severity, bad, text in checks:
        got = _rows(rows.where(bad), rule, severity, "owner", F.lit(text))
        out = got if out is None else out.union(got)
    return out


def governance_rules(c: Catalog) -> DataFrame:
    """Fields with personal data that have no classification, retention or protection."""
    tags = c.metadata.where("owner_kind = 'field'").groupBy("owner", "field").agg(F.collect_set("key").alias("keys"))
    pii = tags.where(F.array_contains("keys", "pii"))
    subject = F.concat_ws(".", "owner", "field")
    out = None
    for key, others in (("classification", ("classification",)), ("retention", ("retention",)), ("protection", ("mask", "encrypt"))):
        lacking = pii.where(~F.arrays_overlap("keys", F.array(*map(F.lit, others))))
        got = _rows(lacking, f"pii-without-{key}", "warning", subject, F.lit(f"no {' or '.join(others)}"))
        out = got if out is None else out.union(got)
    return out


RULES = (duplicate_definitions, namespace_conflicts, undefined_references, unresolved_prose, prose_not_in_source, fields_not_in_schema, circular_spreads, imports, import_scope, parse_errors)
LINT = (hidden_sources, unresolved_in_lint, duplicate_definitions)


def validate(c: Catalog) -> DataFrame:
    """All findings; add governance_rules and merge_rules for conventions."""
    out = RULES[0](c)
    for rule in RULES[1:]:
        out = out.union(rule(c))
    return out


def lint(c: Catalog, select: tuple[str, ...] = (), ignore: tuple[str, ...] = ()) -> DataFrame:
    out = LINT[0](c)
    for rule in LINT[1:]:
        out = out.union(rule(c))
    out = out.where(F.col("rule").isin(*select)) if select else out
    return (out.where(~F.col("rule").isin(*ignore)) if ignore else out).orderBy("subject", "rule", "message")
