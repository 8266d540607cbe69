"""Lineage over edge tables: breadth-first rounds of joins, each node at its least distance."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.catalog.tables import Catalog
from weftline.storage import cut_lineage


def reach_from(edges: DataFrame, starts: DataFrame, depth: int = 10) -> DataFrame:
    """edges(src, dst) and starts(start, node) to (start, node, depth): what each start reaches, all of them in one walk. The starts themselves are no results."""
    hops = edges.select("src", "dst").distinct()
    visited = cut_lineage(starts.distinct().withColumn("depth", F.lit(0)))
    frontier, found = visited, []
    for hop in range(1, depth + 1):
        step = frontier.select("start", F.col("node").alias("src")).join(hops, "src").select("start", F.col("dst").alias("node")).distinct()
        new = cut_lineage(step.join(visited.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(hop)))
        if new.isEmpty():
            break
        found.append(new)
        visited, frontier = visited.union(new), new
    return functools.reduce(DataFrame.union, found, visited.limit(0))


def reach(edges: DataFrame, start: str, depth: int = 10) -> DataFrame:
    """edges(ordinal, src, dst, ...) to the nodes that start reaches: node, depth, and the columns of the first edge that got there.

    A round joins the last round's nodes with the edges and leaves out what was reached before; of several edges to a node the one from the earlier
    node, and then the smaller ordinal, counts. start itself is not a result, so cycles end.
    """
    spark = edges.sparkSession
    carried = [c for c in edges.columns if c not in ("src", "dst", "ordinal")]
    visited = spark.createDataFrame([(start, 0, 0)], "node string, depth int, at long")
    found: DataFrame | None = None
    frontier = visited
    for hop in range(1, depth + 1):
        step = frontier.withColumnRenamed("node", "src").select("src", F.col("at").alias("before")).join(edges, "src").join(visited.select(F.col("node").alias("dst")), "dst", "left_anti")
        first = step.withColumn("r", F.row_number().over(Window.partitionBy("dst").orderBy("before", "ordinal"))).where("r = 1")
        order = Window.orderBy("before", "ordinal")  # the nodes of one distance in a specification
        new = cut_lineage(first.select(F.col("dst").alias("node"), F.lit(hop).alias("depth"), F.row_number().over(order).cast("long").alias("at"), *carried))
        if new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        visited = visited.union(new.select("node", "depth", "at"))
        frontier = new
    if found is None:
        return spark.createDataFrame([], edges.select(F.col("dst").alias("node"), F.lit(1).alias("depth"), *carried).schema)
    return found.select("node", "depth", *carried)


def _turned(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def schema_edges(catalog: Catalog) -> DataFrame:
    """Schema to schema through a mapping, and metric sources: src, dst, mapping, ordinal."""
    e = catalog.sedges
    into = e.where("role IN ('source', 'nl_ref')").select("src", "mapping")
    out = e.where("role = 'target'").select("dst", "mapping")
    hops = into.join(out, "mapping").select("src", "dst", "mapping").union(e.where("role = 'metric_source'").select("src", "dst", F.lit(None).cast("string").alias("mapping")))
    return hops.distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("src", "dst", "mapping")))


def lineage(catalog: Catalog, schema: str, upstream: bool = False, depth: int = 10) -> DataFrame:
    """node, depth, mapping: schemas and metrics down- or upstream."""
    edges = schema_edges(catalog)
    return reach(_turned(edges) if upstream else edges, schema, depth)


def field_lineage(catalog: Catalog, field: str, upstream: bool = False, depth: int = 10) -> DataFrame:
    """node, depth, mapping, classification: fields down- or upstream of ``[ns]::schema.path``."""
    edges = catalog.fedges.select("ordinal", "src", "dst", "mapping", "classification")
    return reach(_turned(edges) if upstream else edges, field, depth)


def upstream_paths(spark: SparkSession, edges: DataFrame, target: str, depth: int = 10) -> DataFrame:
    """Every path (array of nodes, root first) that ends in target."""
    view = f"weftline_edges_{uuid.uuid4().hex}"
    edges.select("src", "dst").distinct().createOrReplaceTempView(view)
    paths = spark.sql(
        f"""WITH RECURSIVE walk(node, path, n) AS (
             SELECT :target, array(:target), 0
             UNION ALL
             SELECT e.src, concat(array(e.src), w.path), w.n + 1 FROM {view} e JOIN walk w ON e.dst = w.node WHERE w.n < :depth AND NOT array_contains(w.path, e.src))
           SELECT path FROM walk w LEFT ANTI JOIN {view} e ON e.dst = w.node WHERE n > 0""",
        args={"target": target, "depth": depth},
    )
    spark.catalog.dropTempView(view)  # the plan has the edges themselves
    return paths


def nodes(catalog: Catalog, namespace: str | None = None) -> DataFrame:
    """kind, key: schemas, metrics, mappings and transforms; fragments are no nodes. With a namespace, also the ends of its edges outside it."""
    all_ = catalog.definitions.where("kind <> 'fragment'").select("kind", "key", "namespace").distinct()
    if namespace is None:
        return all_.select("kind", "key")
    own = all_.where(F.col("namespace") == namespace)
    edges = catalog.sedges
    ends = edges.join(own.select(F.col("key").alias("src")), "src", "left_semi").select(F.col("dst").alias("key")).union(edges.join(own.select(F.col("key").alias("dst")), "dst", "left_semi").select(F.col("src").alias("key")))
    return all_.join(ends.union(own.select("key")).distinct(), "key", "left_semi").select("kind", "key")


def schema_rollup(catalog: Catalog) -> DataFrame:
    """src, dst, mapping, classification of schema pairs: of a mapping's field edges the first of each pair; mappings without any give each source with the target."""
    head = lambda c: F.regexp_extract(c, r"^([^.]*)\.", 1)
    edges = catalog.fedges.select(head("src").alias("src"), head("dst").alias("dst"), "mapping", "classification", "ordinal")
    rolled = edges.groupBy("src", "dst", "mapping").agg(F.min_by("classification", "ordinal").alias("classification"))
    bare = catalog.mappings.join(catalog.fedges.select(F.col("mapping").alias("key")).distinct(), "key", "left_anti")
    shown = lambda c: F.when(c.contains("::"), c).otherwise(F.concat(F.lit("::"), c))
    bare = bare.select("key", "target", F.explode("sources").alias("source"))
    return rolled.union(bare.select(shown(F.col("source")).alias("src"), shown(F.col("target")).alias("dst"), F.col("key").alias("mapping"), F.lit("none").alias("classification")))


def impact(catalog: Catalog, tag: str) -> DataFrame:
    """field, node, depth: everything downstream of each field that bears a tag."""
    tagged = catalog.metadata.where((F.col("owner_kind") == "field") & (F.lower("key") == tag.lower()))
    owner = F.when(F.col("owner").contains("::"), F.col("owner")).otherwise(F.concat(F.lit("::"), F.col("owner")))
    starts = tagged.select(F.concat_ws(".", "owner", "field").alias("start"), F.concat_ws(".", owner, "field").alias("node"))
    return reach_from(catalog.fedges, starts).withColumnRenamed("start", "field")


def model(catalog: Catalog) -> DataFrame:
    """key, kind, fields, edges: each node with its fields and outgoing edges nested, for drawing."""
    fields = catalog.fields.groupBy(F.col("owner").alias("key")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "path", "type", "is_list"))).alias("fields"))
    edges = catalog.sedges.groupBy(F.col("src").alias("key")).agg(F.array_sort(F.collect_set(F.struct("dst", "role"))).alias("edges"))
    return nodes(catalog).join(fields, "key", "left").join(edges, "key", "left")
