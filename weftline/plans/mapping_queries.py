"""Registered queries on mappings: arithmetic between targets, several lists, groups, load tokens and more steps, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.lang.names import Workspace
from weftline.lang.syntax import parse
from weftline.operators import graph, quality
from weftline.plans.compile import Options, compile_mapping
from weftline.plans.loading import load_mapping
from weftline.plans.registry import query
from weftline.sources import copybook
from weftline.storage import written


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- arithmetic between targets
_BUDGET = Workspace([parse("""
schema lineitem { l_orderkey BIGINT l_extendedprice DOUBLE l_discount DOUBLE l_tax DOUBLE l_quantity DOUBLE l_returnflag STRING l_linestatus STRING }
schema budget { flag STRING spend DOUBLE saved DOUBLE net DOUBLE net_pct DECIMAL(18,4) share DOUBLE per_line DOUBLE lines BIGINT }
mapping budget_vs_spend (group_by l_returnflag) {
  source { lineitem }
  target { budget }
  -> net_pct { "@net divided by @spend times 100" | round(4) }
  l_returnflag -> flag
  l_extendedprice -> spend { sum }
  l_discount -> saved { sum }
  -> net { "@spend minus @saved" }
  -> per_line { "(@spend - @saved) / (@lines - @lines)" }
  l_orderkey -> lines { count }
  -> share { "@net_pct divided by 100" | round(3) }
}
schema priced { id BIGINT number INT gross DOUBLE vat DOUBLE total DOUBLE }
mapping priced_lines {
  source { lineitem }
  target { priced }
  l_orderkey -> id
  l_quantity -> number
  -> total { "@gross plus @vat" }
  -> gross { "@l_extendedprice times (1 minus @lineitem.l_discount)" }
  -> vat { "@gross times 0.21" }
}
""")])


@query("target_arithmetic", """WITH g AS (SELECT l_returnflag AS flag, sum(l_extendedprice) AS spend, sum(l_discount) AS saved, count(l_orderkey) AS lines FROM lineitem GROUP BY 1)
    SELECT flag, round(spend, 2) AS spend, round(spend - saved, 2) AS net, round((spend - saved) / spend * 100, 4)::DECIMAL(18,4) AS net_pct, round(round((spend - saved) / spend * 100, 4)::DECIMAL(18,4)::DOUBLE / 100, 3) AS share, NULL::DOUBLE AS per_line, lines FROM g""")
def target_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a group computed from each other, in three stages; a quotient by zero is null."""
    got = compile_mapping(_BUDGET, "budget_vs_spend", {"lineitem": _t(spark, d, "lineitem")}).rows
    return got.select("flag", F.round("spend", 2).alias("spend"), F.round("net", 2).alias("net"), "net_pct", "share", "per_line", "lines")


@query("target_arithmetic_rows", """SELECT l_orderkey AS id, l_quantity::INT AS number, round(l_extendedprice * (1 - l_discount), 6) AS gross, round(l_extendedprice * (1 - l_discount) + l_extendedprice * (1 - l_discount) * 0.21::DOUBLE, 8) AS total FROM lineitem""")
def target_arithmetic_rows(spark: SparkSession, d: str) -> DataFrame:
    got = compile_mapping(_BUDGET, "priced_lines", {"lineitem": _t(spark, d, "lineitem")}).rows
    return got.select("id", "number", F.round("gross", 6).alias("gross"), F.round("total", 8).alias("total"))


# ---- several lists
_LISTS = Workspace([parse("""
schema days {
  user BIGINT
  views list_of record { value DOUBLE at TIMESTAMP }
  buys list_of record (filter value > 20) { value DOUBLE }
}
schema side_by_side { user BIGINT seen DOUBLE bought DOUBLE }
mapping beside {
  source { days }
  target { side_by_side }
  flatten views -> side_by_side { user -> user .value -> seen }
  flatten buys -> side_by_side { .value -> bought }
}
schema customers { key BIGINT orders list_of record { key BIGINT status STRING lines list_of record { number INT flag STRING price DOUBLE } } }
schema deep_line { customer BIGINT order_id BIGINT status STRING number INT price DOUBLE }
mapping inside {
  source { customers }
  target { deep_line }
  flatten orders -> deep_line {
    key -> customer
    .key -> order_id
    .status -> status { lowercase }
    flatten .lines -> deep_line { .number -> number .price -> price }
  }
}
schema most { status STRING dearest STRING first_key BIGINT n BIGINT }
mapping grouped (group_by o_orderstatus) {
  source { orders }
  target { most }
  o_orderstatus -> status
  o_orderpriority -> dearest
  o_orderkey -> first_key
  o_custkey -> n { count }
}
""")])


@query("flatten_side_by_side", """WITH v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'view'),
    b AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'purchase' AND value > 20)
    SELECT coalesce(v.user_id, b.user_id) AS user, v.value AS seen, b.value AS bought FROM v FULL JOIN b ON v.user_id = b.user_id AND v.i = b.i""")
def flatten_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """A user's views and larger purchases, the first with the first and so on: as many rows as the longer list has, not their product."""
    e = _t(spark, d, "events")
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.struct("ts", "event_id", "value"))))
    per = e.groupBy(F.col("user_id").alias("user")).agg(listed("view").alias("v"), listed("purchase").alias("b"))
    days = per.select("user", F.transform("v", lambda x: F.struct(x["value"].alias("value"), x["ts"].alias("at"))).alias("views"), F.transform("b", lambda x: F.struct(x["value"].alias("value"))).alias("buys"))
    return compile_mapping(_LISTS, "beside", {"days": days}).rows


@query("flatten_inside", """SELECT o_custkey AS customer, o_orderkey AS order_id, lower(o_orderstatus) AS status, l_linenumber AS number, l_extendedprice AS price FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def flatten_inside(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders with lines, both lists flattened by one mapping."""
    line = F.struct(F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"))
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    orders = _t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    order = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), "lines")
    customers = orders.groupBy(F.col("o_custkey").alias("key")).agg(F.collect_list(order).alias("orders"))
    return compile_mapping(_LISTS, "inside", {"customers": customers}).rows


@query("group_other_columns", """SELECT o_orderstatus AS status, min(o_orderpriority) AS dearest, min(o_orderkey) AS first_key, count(*) AS n FROM orders GROUP BY 1""")
def group_other_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns that are neither key nor aggregate are the least of their group, whatever order rows come in."""
    return compile_mapping(_LISTS, "grouped", {"orders": _t(spark, d, "orders")}).rows


@query("group_other_columns_by_order", """SELECT o_orderstatus AS status, arg_min(o_orderpriority, (-o_totalprice, o_orderkey)) AS dearest, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS first_key, count(*) AS n FROM orders GROUP BY 1""")
def group_other_columns_by_order(spark: SparkSession, d: str) -> DataFrame:
    """The same columns of the dearest order."""
    order = F.struct(-F.col("o_totalprice"), F.col("o_orderkey"))
    return compile_mapping(_LISTS, "grouped", {"orders": _t(spark, d, "orders")}, Options(order=order)).rows


# ---- load strategies from tokens
_LOADS = Workspace([parse("""
schema customer { c_custkey BIGINT c_name STRING c_nationkey INT c_acctbal DOUBLE c_mktsegment STRING }
schema accounts { id BIGINT name STRING balance DOUBLE note STRING }
mapping `accounts upsert` (merge upsert, match_on id) { source { customer } target { accounts } c_custkey -> id c_name -> name { lowercase } c_acctbal -> balance }
mapping `accounts new` (merge upsert, match_on id, on_match skip) { source { customer } target { accounts } c_custkey -> id c_name -> name { uppercase } c_acctbal -> balance }
mapping `accounts known` (merge upsert, match_on {id, name}, on_no_match skip) { source { customer } target { accounts } c_custkey -> id c_name -> name c_acctbal -> balance { * 2 } }
mapping `accounts log` (merge append) { source { customer } target { accounts } c_custkey -> id c_name -> name }
schema closed { id BIGINT name STRING gone BOOLEAN gone_at TIMESTAMP }
mapping `accounts closed` (merge soft_delete, match_on id, delete_flag gone, delete_timestamp gone_at) { source { customer (filter "c_acctbal < 0") } target { closed } c_custkey -> id c_name -> name }
schema dim_customer (dimension, scd 2, natural_key id, track {segment}) { id BIGINT name STRING segment STRING nation INT }
mapping dim_load { source { customer } target { dim_customer } c_custkey -> id c_name -> name c_mktsegment -> segment c_nationkey -> nation }
schema dim_overlay (dimension, scd 6, natural_key id, ignore {name}) { id BIGINT name STRING segment STRING nation INT }
mapping overlay_load { source { customer } target { dim_overlay } c_custkey -> id c_name -> name c_mktsegment -> segment c_nationkey -> nation }
schema dim_first (dimension, scd 1, natural_key id) { id BIGINT segment STRING }
mapping first_load { source { customer } target { dim_first } c_custkey -> id c_mktsegment -> segment }
""")])


def _accounts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("kept").alias("note"))


def _into(spark: SparkSession, d: str, mapping: str, rows: DataFrame, target: DataFrame | None = None, now: str | None = None) -> DataFrame:
    at = None if now is None else F.lit(now).cast("timestamp_ntz")
    return load_mapping(_LOADS, mapping, {"customer": rows}, target, Options(now=at)).rows


_ACCOUNTS = "(SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, 'kept' AS note FROM customer WHERE c_custkey % 3 <> 0)"


@query("load_upsert", f"""SELECT coalesce(n.c_custkey, o.id) AS id, coalesce(lower(n.c_name), o.name) AS name, coalesce(n.c_acctbal, o.balance) AS balance, o.note FROM {_ACCOUNTS} o FULL JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) n ON o.id = n.c_custkey""")
def load_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Matched rows are updated and keep the columns that nothing is mapped to; the others come in."""
    return _into(spark, d, "accounts upsert", _t(spark, d, "customer").where("c_custkey % 2 = 0"), _accounts(spark, d))


@query("load_upsert_skip", f"""SELECT * FROM {_ACCOUNTS} UNION ALL SELECT c_custkey, upper(c_name), c_acctbal, NULL FROM customer WHERE c_custkey % 3 = 0""")
def load_upsert_skip(spark: SparkSession, d: str) -> DataFrame:
    return _into(spark, d, "accounts new", _t(spark, d, "customer"), _accounts(spark, d))


@query("load_update_only", f"""SELECT o.id, o.name, CASE WHEN o.id % 2 = 0 THEN o.balance * 2 ELSE o.balance END AS balance, o.note FROM {_ACCOUNTS} o""")
def load_update_only(spark: SparkSession, d: str) -> DataFrame:
    """Two fields are the key, and rows that are not there stay out."""
    return _into(spark, d, "accounts known", _t(spark, d, "customer").where("c_custkey % 2 = 0"), _accounts(spark, d))


@query("load_append", f"""SELECT * FROM {_ACCOUNTS} UNION ALL SELECT c_custkey, c_name, NULL, NULL FROM customer""")
def load_append(spark: SparkSession, d: str) -> DataFrame:
    return _into(spark, d, "accounts log", _t(spark, d, "customer"), _accounts(spark, d))


@query("load_soft_delete", """SELECT c_custkey AS id, c_name AS name, c_acctbal < 0 AS gone, CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-05-01' END AS gone_at FROM customer WHERE c_custkey % 3 <> 0 OR c_acctbal < 0""")
def load_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    there = _accounts(spark, d).select("id", "name", F.lit(False).alias("gone"), F.lit(None).cast("timestamp_ntz").alias("gone_at"))
    return _into(spark, d, "accounts closed", _t(spark, d, "customer"), there, "2024-05-01")


def _moved(rows: DataFrame) -> DataFrame:
    """Every third customer in another segment, every fifth with another name."""
    segment = F.when(F.col("c_custkey") % 3 == 0, "MOVED").otherwise(F.col("c_mktsegment"))
    return rows.withColumns({"c_mktsegment": segment, "c_name": F.when(F.col("c_custkey") % 5 == 0, F.lit("renamed")).otherwise(F.col("c_name"))})


_TWICE = """WITH c AS (SELECT *, c_custkey % 3 = 0 AND c_custkey % 2 = 0 AND c_mktsegment <> 'MOVED' AS moved, CASE WHEN c_custkey % 5 = 0 THEN 'renamed' ELSE c_name END AS renamed FROM customer)
    SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation, TIMESTAMP '2024-01-01' AS valid_from, CASE WHEN moved THEN TIMESTAMP '2024-02-01' END AS valid_to, NOT moved AS is_current FROM c
    UNION ALL SELECT c_custkey, renamed, 'MOVED', c_nationkey, TIMESTAMP '2024-02-01', NULL, true FROM c WHERE moved"""


@query("load_scd2", _TWICE)
def load_scd2(spark: SparkSession, d: str) -> DataFrame:
    """A first load and a second one of every second customer: only the tracked field makes versions, another name alone does not."""
    c = _t(spark, d, "customer")
    first = _into(spark, d, "dim_load", c, None, "2024-01-01")
    return _into(spark, d, "dim_load", _moved(c.where("c_custkey % 2 = 0")), first, "2024-02-01").drop("row_hash", "surrogate_key")


@query("load_scd6", f"""SELECT *, last_value(segment) OVER w AS current_segment, last_value(nation) OVER w AS current_nation FROM ({_TWICE}) WINDOW w AS (PARTITION BY id ORDER BY valid_from ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def load_scd6(spark: SparkSession, d: str) -> DataFrame:
    """The same with the current values on every version; all fields but the name are tracked."""
    c = _t(spark, d, "customer")
    first = _into(spark, d, "overlay_load", c, None, "2024-01-01")
    return _into(spark, d, "overlay_load", _moved(c.where("c_custkey % 2 = 0")), first, "2024-02-01").drop("row_hash", "surrogate_key")


@query("load_scd1", """SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'MOVED' ELSE c_mktsegment END AS segment FROM customer""")
def load_scd1(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    return _into(spark, d, "first_load", _moved(c.where("c_custkey % 2 = 0")), _into(spark, d, "first_load", c))


# ---- packed records
_RECORDS = parse("""
schema order_record (format copybook, encoding ebcdic) {
  KEY BIGINT (pic "9(10)", offset 1, length 10)
  HEAD record { STATUS STRING (pic "X(3)") PRIORITY STRING (pic "X(15)") }
  PRICE DECIMAL(11,2) (pic "S9(9)V99", encoding comp-3)
  NUMBERS INT (pic "9(4)", encoding comp)
  LINES list_of record (occurs 40, depends_on NUMBERS) { NUMBER INT (pic "9(2)") AMOUNT DECIMAL(9,2) (pic "S9(7)V99", encoding comp-3) FLAG STRING (pic "X") }
}
""").blocks[0].fields


@query("copybook_records", """SELECT o_orderkey AS "KEY", o_orderstatus AS status, o_orderpriority AS priority, (round(o_totalprice * 100) / 100)::DECIMAL(11,2) AS price, l_linenumber::INT AS number,
    (-round(l_extendedprice * 100) / 100)::DECIMAL(9,2) AS amount, l_returnflag AS flag FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def copybook_records(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines as mainframe records, and read back: EBCDIC text, zoned and packed decimals, a binary number, and as many lines as that says. Amounts are negative."""
    text = lambda c, n: copybook.to_ebcdic(F.rpad(c, n, " "))
    digits = lambda c, n: copybook.to_ebcdic(F.lpad(c.cast("string"), n, "0"))
    line = F.concat(digits(F.col("l_linenumber"), 2), copybook.packed(-F.round(F.col("l_extendedprice"), 2), 9, 2), text(F.col("l_returnflag"), 1))
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    number = F.unhex(F.lpad(F.hex(F.size("lines").cast("long")), 4, "0"))
    body = F.aggregate("lines", F.unhex(F.lit("")), lambda a, x: F.concat(a, x))
    head = F.concat(digits(F.col("o_orderkey"), 10), text(F.col("o_orderstatus"), 3), text(F.col("o_orderpriority"), 15), copybook.packed(F.round(F.col("o_totalprice"), 2), 11, 2), number, body)
    records = written(_t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(head.alias("value")), "records")
    read = records.select(*copybook.columns(F.col("value"), _RECORDS))
    flat = read.select("KEY", F.col("HEAD.STATUS").alias("status"), F.col("HEAD.PRIORITY").alias("priority"), F.col("PRICE").alias("price"), F.explode("LINES").alias("x"))
    return flat.select("KEY", "status", "priority", "price", F.col("x.NUMBER").alias("number"), F.col("x.AMOUNT").alias("amount"), F.col("x.FLAG").alias("flag"))


# ---- more steps, lists and checks
_MORE = Workspace([parse("""
schema customer { c_custkey BIGINT c_name STRING c_nationkey INT c_acctbal DOUBLE c_mktsegment STRING }
schema orders { o_orderkey BIGINT o_custkey BIGINT o_orderstatus STRING o_totalprice DOUBLE o_orderdate TIMESTAMP }
schema shown { id BIGINT segment STRING both STRING day DATE iso STRING at TIMESTAMP seen TIMESTAMP secret STRING random STRING state STRING (default "unknown") }
mapping more_steps {
  source { orders }
  target { shown }
  o_orderkey -> id { error_if_null }
  o_orderstatus -> segment { lowercase | prepend("status ") | title_case }
  o_orderstatus, stamp -> both { concat | concat("!") }
  stamp -> day { parse(YYYYMMDD) }
  o_orderdate -> iso { to_iso8601 }
  o_orderdate -> at { assume_utc }
  -> seen { now_utc() }
  o_orderstatus -> secret { encrypt(key) }
  o_orderkey -> random { uuid_v4 }
  missing -> state
}
schema per_customer { customer BIGINT latest STRING earliest STRING kinds ANY }
mapping by_customer (group_by o_custkey) {
  source { orders }
  target { per_customer }
  o_custkey -> customer
  o_orderstatus -> latest { last }
  o_orderstatus -> earliest { first }
}
schema nested { key BIGINT orders list_of record { key BIGINT tags list_of STRING } }
schema copied { id BIGINT orders list_of record { id BIGINT tags list_of STRING } }
mapping copy_lists { source { nested } target { copied } key -> id each orders -> orders { .key -> .id .tags -> .tags } }
""")])


@query("map_more_steps", """SELECT o_orderkey AS id, 'Status ' || upper(o_orderstatus) AS segment, o_orderstatus || strftime(o_orderdate, '%Y%m%d') || '!' AS both, o_orderdate::DATE AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso,
    o_orderdate AS at, TIMESTAMP '2024-01-01' AS seen, o_orderstatus AS secret, 36 AS random, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'unknown' END AS state FROM orders""")
def map_more_steps(spark: SparkSession, d: str) -> DataFrame:
    """What is encrypted is shown decrypted again, and of random ids their length."""
    key = "0123456789abcdef"
    o = _t(spark, d, "orders").withColumns({"stamp": F.date_format("o_orderdate", "yyyyMMdd"), "missing": F.when(F.col("o_orderkey") % 2 == 0, "even")})
    got = compile_mapping(_MORE, "more_steps", {"orders": o}, Options(now=F.lit("2024-01-01").cast("timestamp_ntz"), bindings={"key": key})).rows
    return got.withColumns({"secret": F.aes_decrypt(F.unbase64("secret"), F.lit(key), F.lit("GCM")).cast("string"), "random": F.length("random")})


@query("group_first_last", """SELECT o_custkey AS customer, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS latest, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS earliest FROM orders GROUP BY 1""")
def group_first_last(spark: SparkSession, d: str) -> DataFrame:
    return compile_mapping(_MORE, "by_customer", {"orders": _t(spark, d, "orders")}, Options(order=F.struct("o_orderdate", "o_orderkey"))).rows


@query("each_scalar_lists", """SELECT o_custkey AS id, o_orderkey AS order_id, o_orderstatus || '/' || o_orderpriority AS tags FROM orders""")
def each_scalar_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of records with lists of texts, copied as they are."""
    order = F.struct(F.col("o_orderkey").alias("key"), F.array("o_orderstatus", "o_orderpriority").alias("tags"))
    nested = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.collect_list(order).alias("orders"))
    got = compile_mapping(_MORE, "copy_lists", {"nested": nested}).rows
    return got.select("id", F.explode("orders").alias("x")).select("id", F.col("x.id").alias("order_id"), F.array_join("x.tags", "/").alias("tags"))


@query("dq_format", r"""SELECT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]*@[^\x20\x09-\x0D]*')) AS w FROM documents) WHERE NOT regexp_matches(w, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$')""")
def dq_format(spark: SparkSession, d: str) -> DataFrame:
    """All words with an at sign in all texts that are no addresses."""
    words = _t(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]*@[^\x20\x09-\x0D]*"), F.lit(0))).alias("w"))
    return quality.formatted(words, "w", "email")


# ---- lineage over edges that tables hold
@query("lineage_of_rows", """WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem),
    r AS (SELECT 'c' || c_custkey AS start, 'c' || c_custkey AS node, 0 AS depth FROM customer WHERE c_nationkey = 3 UNION SELECT start, dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 10)
    SELECT start, node, min(depth)::INT AS depth FROM r WHERE depth > 0 GROUP BY 1, 2""")
def lineage_of_rows(spark: SparkSession, d: str) -> DataFrame:
    """What the customers of a nation reach: their orders and the parts in these; all starts in one walk."""
    o, line = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edges = o.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")).union(line.select(name("o", "l_orderkey"), name("p", "l_partkey")))
    starts = _t(spark, d, "customer").where("c_nationkey = 3").select(name("c", "c_custkey").alias("start"), name("c", "c_custkey").alias("node"))
    return graph.reach_from(edges, starts)
