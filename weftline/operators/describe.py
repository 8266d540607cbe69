"""Questions about a specification, each a function from the catalog to a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.catalog.tables import Catalog

#: Weights of where a term is found, words that are no terms, and characters that count as a token.
WEIGHTS = {"name": 10, "field": 5, "nl_ref": 3, "nl": 2, "note": 2, "type": 1, "endpoint": 1, "metadata": 1}
STOP_WORDS = ("a", "an", "and", "are", "for", "from", "how", "in", "is", "of", "on", "or", "the", "to", "what", "where", "which", "with")
CHARS_A_TOKEN = 4


def summary(c: Catalog) -> DataFrame:
    """kind, n: how many of each kind; arrows count prose edges too, declared_arrows do not."""
    counts = c.definitions.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    derived = c.fedges.where("classification = 'nl-derived'")
    rows = [
        c.fields.agg(F.lit("fields").alias("kind"), F.count(F.lit(1)).alias("n")),
        c.arrows.where("kind IN ('map', 'computed', 'nested')").agg(F.lit("declared_arrows").alias("kind"), F.count(F.lit(1)).alias("n")),
        c.arrows.where("kind IN ('map', 'computed', 'nested')").select("id").union(derived.select("ordinal")).agg(F.lit("arrows").alias("kind"), F.count(F.lit(1)).alias("n")),
        c.files.agg(F.lit("files").alias("kind"), F.count(F.lit(1)).alias("n")),
        c.nl_items.groupBy(F.concat(F.col("kind"), F.lit("s")).alias("kind")).agg(F.count(F.lit(1)).alias("n")).where("kind IN ('warnings', 'questions')"),
    ]
    for r in rows:
        counts = counts.union(r)
    return counts


def schema(c: Catalog, name: str) -> DataFrame:
    return c.schemas.where(_named(name)).join(c.fields.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("ordinal", "path", "type", "is_list", "tags"))).alias("fields")).withColumnRenamed("owner", "key"), "key", "left")


def _named(name: str, column: str = "key") -> Column:
    """As a user types it: exact, or the end after the namespace."""
    name = name.removeprefix("::")
    return (F.col(column) == name) | F.col(column).endswith(f"::{name}")


def metric(c: Catalog, name: str) -> DataFrame:
    """key, metric_name, sources, grain, slices, filter and measures of a metric."""
    meta = c.metadata.where("owner_kind = 'block'")
    value = lambda k: F.max(F.when(F.col("m.key") == k, F.col("m.value")))
    rows = c.schemas.where("is_metric").where(_named(name)).alias("s").join(meta.alias("m"), F.col("s.key") == F.col("m.owner"), "left")
    got = rows.groupBy(F.col("s.key").alias("key")).agg(
        value("metric_name").alias("metric_name"), value("source").alias("source"), value("grain").alias("grain"), value("filter").alias("filter"),
        F.max(F.when(F.col("m.key") == "slice", F.col("m.values"))).alias("slices"),
    )
    return got.join(measures(c).groupBy(F.col("owner").alias("key")).agg(F.array_sort(F.collect_list("field")).alias("measures")), "key", "left")


def measures(c: Catalog) -> DataFrame:
    """owner, field, additivity: a bare or unknown measure is additive; fields without the tag are dimensions and have no row."""
    kind = F.when(F.col("value").isin("non_additive", "semi_additive"), F.col("value")).otherwise("additive")
    return c.metadata.where("owner_kind = 'field' AND key = 'measure'").select("owner", "field", kind.alias("additivity"))


def mapping(c: Catalog, name: str) -> DataFrame:
    rows = c.arrows.groupBy(F.col("mapping").alias("key")).agg(F.array_sort(F.collect_list(F.struct("id", "kind", "sources", "target", "depth", "classification", "steps"))).alias("arrows"))
    return c.mappings.where(_named(name)).join(rows, "key", "left")


def find(c: Catalog, tag: str, within: str = "all") -> DataFrame:
    """owner, field, key, value of metadata that names tag, as a key or as a member of an enum or slice, in any case; within: schema, metric, fragment or all."""
    tag = tag.lower()
    hits = c.metadata.where((F.lower("key") == tag) | F.exists("values", lambda v: F.lower(v) == tag)).select("owner", "field", "kind", "key", "value")
    kinds = c.schemas.select(F.col("key").alias("owner"), F.when(F.col("is_metric"), "metric").otherwise(F.col("kind")).alias("block"))
    rows = hits.join(kinds, "owner", "left")
    return (rows if within == "all" else rows.where((F.col("block") == within) | ((F.col("block") == "metric") & F.lit(within == "schema")))).drop("block")


def fields(c: Catalog, name: str) -> DataFrame:
    return c.fields.where(_named(name, "owner")).orderBy("owner", "ordinal")


def arrows(c: Catalog, field: str, role: str = "both") -> DataFrame:
    """The edges of one hop at a field ``[ns]::schema.path``: role source, target or both."""
    at = {"source": F.col("src") == field, "target": F.col("dst") == field}
    return c.fedges.where(at[role] if role in at else at["source"] | at["target"])


def coverage(c: Catalog) -> DataFrame:
    """mapping, side, owner, path, mapped: for each mapping, which fields of its sources and its target its arrows touch; a path covers its prefixes."""
    m = c.mappings
    touched = c.arrows.select("mapping", F.lit("target").alias("side"), F.col("target").alias("path")).union(c.arrows.select("mapping", F.lit("source").alias("side"), F.explode("sources").alias("path")))
    parts = F.split("path", r"\.")
    prefixes = touched.select("mapping", "side", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("path")).distinct()
    sides = m.select(F.col("key").alias("mapping"), F.lit("target").alias("side"), F.col("target").alias("owner")).union(m.select("key", F.lit("source"), F.explode("sources")))
    return sides.join(c.fields.select("owner", "path", "is_record"), "owner").join(prefixes.withColumn("mapped", F.lit(True)), ["mapping", "side", "path"], "left").select("mapping", "side", "owner", "path", "is_record", F.coalesce("mapped", F.lit(False)).alias("mapped"))


def unmapped(c: Catalog, name: str, by: str) -> DataFrame:
    """owner, path of a schema's fields that a mapping leaves out: leaves neither path nor name of which an arrow touches, and records that hold such leaves."""
    own = c.fields.where(_named(name, "owner"))
    touched = c.arrows.where(_named(by, "mapping")).select(F.explode(F.concat("sources", F.array("target"))).alias("p"))
    parts = F.split(F.replace(F.col("p"), F.lit("[]")), r"\.")
    covered = touched.select(F.explode(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ".")), parts)).alias("p")).distinct()
    leaves = own.where("NOT is_record").join(covered, own["path"] == covered["p"], "left_anti").join(covered, F.col("name") == covered["p"], "left_anti")
    up = F.split("path", r"\.")
    parents = leaves.where("depth > 0").select("owner", F.explode(F.transform(F.sequence(F.lit(1), F.size(up) - 1), lambda i: F.array_join(F.slice(up, 1, i), "."))).alias("path")).distinct()
    return leaves.select("owner", "path").union(parents)


def match_fields(c: Catalog, source: str, target: str) -> DataFrame:
    """source_path, target_path, state (matched, source-only, target-only): names agree without case, dashes, underscores and spaces; whole paths first, then last names; the first target wins."""
    plain = lambda x: F.regexp_replace(F.lower(x), r"[_\- ]", "")
    side = lambda n, p: c.fields.where(_named(n, "owner")).select(F.col("path").alias(f"{p}_path"), plain("path").alias(f"{p}_full"), plain("name").alias(f"{p}_leaf"), F.col("ordinal").alias(f"{p}_ord"))
    s, t = side(source, "source"), side(target, "target")
    either = s.join(t, s["source_full"] == t["target_full"]).select("source_path", "target_path", F.lit(0).alias("way"), "target_ord").union(s.join(t, s["source_leaf"] == t["target_leaf"]).select("source_path", "target_path", F.lit(1), "target_ord"))
    best = either.withColumn("r", F.row_number().over(Window.partitionBy("source_path").orderBy("way", "target_ord"))).where("r = 1").select("source_path", "target_path")
    lone_s = s.join(best, "source_path", "left_anti").select("source_path", F.lit(None).cast("string").alias("target_path"), F.lit("source-only").alias("state"))
    lone_t = t.join(best, "target_path", "left_anti").select(F.lit(None).cast("string").alias("source_path"), "target_path", F.lit("target-only").alias("state"))
    return best.withColumn("state", F.lit("matched")).unionByName(lone_s).unionByName(lone_t)


def where_used(c: Catalog, name: str) -> DataFrame:
    """user, kind, file, row: mappings, metrics, spreads, transform calls, ref metadata, imports and prose that use a block."""
    return c.dependencies.where(_named(name, "dst")).select(F.col("src").alias("user"), "kind", "file", "row").distinct()


def prose(c: Catalog, scope: str = "all", kind: str | None = None) -> DataFrame:
    """Prose of a block, of a field (``block.path``), or all."""
    rows = c.nl_items if scope == "all" else c.nl_items.where(_named(scope, "owner") | (F.concat_ws(".", "owner", "field") == scope))
    return rows if kind is None else rows.where(F.col("kind") == kind)


def prose_refs(c: Catalog, mapping: str | None = None, unresolved: bool = False) -> DataFrame:
    rows = c.nl_refs if mapping is None else c.nl_refs.where(_named(mapping, "mapping"))
    return rows.where("schema IS NULL") if unresolved else rows


def metadata(c: Catalog, scope: str, tags_only: bool = False) -> DataFrame:
    """Metadata of a block, or of a field (``block.path``)."""
    rows = c.metadata.where((_named(scope, "owner") & F.col("field").isNull()) | (F.concat_ws(".", "owner", "field") == scope))
    return rows.where("kind = 'tag'") if tags_only else rows


def warnings(c: Catalog, questions: bool = False) -> DataFrame:
    return c.nl_items.where(F.col("kind") == ("question" if questions else "warning"))


def context(c: Catalog, question: str, budget: int = 4000) -> DataFrame:
    """block, score, tokens: the blocks that a question is about, best first, as many as fit the budget; the first always fits."""
    words = [w for w in dict.fromkeys(question.lower().split()) if w not in STOP_WORDS]
    blocks = c.definitions.where("kind <> 'import'").select(F.col("key").alias("block"), F.coalesce("name", "key").alias("name"))
    texts = blocks.select("block", F.lit("name").alias("place"), F.col("name").alias("text"))
    more = [
        c.fields.select(F.col("owner").alias("block"), F.lit("field").alias("place"), F.col("name").alias("text")), c.fields.select("owner", F.lit("type"), "type"),
        c.nl_items.select("owner", F.when(F.col("kind") == "note", "note").otherwise("nl"), "text"), c.nl_refs.select("owner", F.lit("nl_ref"), "ref"),
        c.mappings.select("key", F.lit("endpoint"), F.explode(F.concat("sources", F.array("target")))), c.metadata.select("owner", F.lit("metadata"), F.concat_ws(" ", "key", "value", F.array_join("values", " "))),
    ]
    for m in more:
        texts = texts.union(m)
    weight = F.lit(0)
    for place, w in WEIGHTS.items():
        weight = F.when(F.col("place") == place, w).otherwise(weight)
    hits = sum((F.lower("text").contains(w).cast("int") for w in words), F.lit(0))
    scored = texts.where("text IS NOT NULL").groupBy("block").agg(F.sum(hits * weight).alias("score"), F.ceil(F.sum(F.length("text")) / CHARS_A_TOKEN).alias("tokens")).join(blocks.select("block").distinct(), "block", "left_semi").where("score > 0")
    order = Window.orderBy(F.desc("score"), "block")
    running = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return scored.select("block", "score", "tokens", running.alias("used"), F.row_number().over(order).alias("r")).where((F.col("used") <= budget) | (F.col("r") == 1)).select("block", "score", "tokens")


def diff(old: Catalog, new: Catalog) -> DataFrame:
    """what, key, change (added, removed, changed), detail: between two workspaces, of blocks, fields, arrows and metadata."""
    parts = [
        ("block", lambda c: c.definitions.select(F.concat_ws(" ", "kind", "key").alias("key"), F.lit("").alias("body")).distinct()),
        ("field", lambda c: c.fields.select(F.concat_ws(".", "owner", "path").alias("key"), F.concat_ws(" ", F.coalesce("type", F.lit("")), F.col("is_list").cast("string")).alias("body"))),
        ("arrow", lambda c: c.arrows.select(F.concat(F.col("mapping"), F.lit(": "), F.array_join("sources", ","), F.lit(" -> "), F.col("target")).alias("key"), F.coalesce("steps", F.lit("")).alias("body"))),
        ("metadata", lambda c: c.metadata.select(F.concat_ws(".", "owner", "field", "key").alias("key"), F.concat(F.coalesce("value", F.lit("")), F.array_join("values", ",")).alias("body")).groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("body")), "; ").alias("body"))),
        ("note", lambda c: c.nl_items.where("kind = 'note'").select(F.concat_ws(".", "owner", "field").alias("key"), F.col("text").alias("body")).groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("body")), "; ").alias("body"))),
    ]
    out = None
    for what, rows in parts:
        a, b = rows(old).withColumnRenamed("body", "was"), rows(new).withColumnRenamed("body", "is")
        change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("changed")
        got = a.join(b, "key", "full_outer").where(~F.col("was").eqNullSafe(F.col("is"))).select(F.lit(what).alias("what"), "key", change.alias("change"), F.when(F.col("was").isNotNull() & F.col("is").isNotNull(), F.concat("was", F.lit(" => "), "is")).alias("detail"))
        out = got if out is None else out.union(got)
    return out
