"""Registered queries: a specification over the driver's tables, compiled, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.catalog.tables import Catalog
from weftline.lang.names import Workspace
from weftline.lang.syntax import parse
from weftline.operators import aggregate, describe, extend, graph, load, quality, validate
from weftline.plans.compile import Compiled, Options, compile_mapping, compile_metric, compile_target
from weftline.plans.registry import example, query
from weftline.sources.formats import column_lineage, fixed_length, selected

SPEC = '''
schema orders {
  o_orderkey BIGINT (pk, required)
  o_custkey BIGINT (required, ref @customer.c_custkey)
  o_orderstatus STRING(1) (enum {F, O, P})
  o_totalprice DOUBLE
  o_orderdate TIMESTAMP
  o_orderpriority STRING (note "a number, a dash and a word")
}
schema customer {
  c_custkey BIGINT (pk, required)
  c_name STRING (pii, classification "CONFIDENTIAL", mask last_four)
  c_nationkey INT
  c_acctbal DOUBLE (classification "RESTRICTED", retention "3y")
  c_mktsegment STRING
}
schema nation { n_nationkey INT (pk) n_name STRING n_regionkey INT }
schema part { p_partkey BIGINT (pk) p_name STRING p_brand STRING p_type STRING p_size INT p_retailprice DOUBLE }
schema lineitem { l_orderkey BIGINT l_partkey BIGINT l_quantity DOUBLE l_extendedprice DOUBLE l_discount DOUBLE l_returnflag STRING l_linestatus STRING }
schema events { event_id BIGINT ts TIMESTAMP user_id BIGINT event_type STRING value DOUBLE props JSON }
schema nested_orders {
  o_orderkey BIGINT
  customer record { key BIGINT status STRING }
  lines list_of record (filter returnflag != "A") {
    number INT
    quantity DOUBLE
    price DOUBLE
    returnflag STRING
  }
}

transform clean { trim | lowercase | null_if_empty }

schema order_labels { order_id BIGINT priority STRING status STRING tier STRING }
mapping `order labels` {
  source { orders }
  target { order_labels }
  o_orderkey -> order_id
  o_orderpriority -> priority { trim | lowercase }
  o_orderstatus -> status { map { F: "finished" O: "open" default: "pending" } }
  o_totalprice -> tier { map { < 50000: "small" < 150000: "medium" < 300000: "large" default: "huge" } }
}

schema customer_copy { id BIGINT name STRING balance DECIMAL(12,2) segment STRING }
mapping customer_rename {
  source { customer }
  target { customer_copy }
  c_custkey -> id
  c_name -> name
  c_acctbal -> balance
  c_mktsegment -> segment { ...clean }
}

schema part_strings { id BIGINT a STRING b STRING c STRING d STRING e STRING f STRING g STRING }
mapping part_strings_map {
  source { part }
  target { part_strings }
  p_partkey -> id
  p_name -> a { uppercase | truncate(6) }
  p_brand -> b { prepend("<") | append(">") | escape_html }
  p_type -> c { lowercase | replace(" ", "_") }
  p_partkey -> d { to_string | pad_left(8, "0") }
  p_partkey -> e { to_string | pad_right(8, "x") }
  p_name -> f { max_length(3) | null_if_empty }
  p_brand -> g { split("#") | last }
}

schema order_priority { id BIGINT level INT word STRING bad DECIMAL(10,2) }
mapping priority_split {
  source { orders }
  target { order_priority }
  o_orderkey -> id
  o_orderpriority -> level { split("-") | first | to_number }
  o_orderpriority -> word { split("-") | last | lowercase }
  o_orderstatus -> bad { to_decimal(10,2) | null_if_invalid }
}

schema numbers { id BIGINT cents BIGINT half DECIMAL(18,4) plus DOUBLE whole DOUBLE year DATE }
mapping arithmetic {
  source { orders (filter "o_orderstatus = `F` AND o_totalprice >= 1000") }
  target { numbers }
  o_orderkey -> id
  o_totalprice -> cents { * 100 | round }
  o_totalprice -> half { / 2 | round(3) }
  o_totalprice -> plus { + 10 | - 3 | round(2) }
  o_totalprice -> whole { round }
  o_orderdate -> year { truncate_to_date }
}

schema hashed { id BIGINT key STRING sha STRING uuid STRING }
mapping customer_hash {
  source { customer }
  target { hashed }
  c_custkey -> id
  c_name -> key { md5 }
  c_name -> sha { hash(sha256) }
  c_name -> uuid { uuid_v5("6ba7b810-9dad-11d1-80b4-00c04fd430c8") }
}

schema checked { id BIGINT email STRING label STRING }
mapping email_check {
  source { documents }
  target { checked }
  doc_id -> id { drop_if_null }
  contact -> email { trim | lowercase | validate_email | drop_if_invalid | drop_if_null }
  lang -> label { coalesce("none") | warn_if_null }
}

schema enriched { order_id BIGINT customer STRING nation STRING total DOUBLE }
mapping enrich {
  source { orders customer nation "Join on @orders.o_custkey = @customer.c_custkey, then nation" }
  target { enriched }
  orders.o_orderkey -> order_id
  customer.c_name -> customer
  nation.n_name -> nation
  orders.o_totalprice -> total
}

schema order_line { order_id BIGINT status STRING number INT amount DOUBLE flag STRING }
mapping flatten_lines {
  source { nested_orders }
  target { order_line }
  flatten lines -> order_line {
    o_orderkey -> order_id
    customer.status -> status
    .number -> number
    .price -> amount
    .returnflag -> flag { lowercase }
  }
}
schema each_out { id BIGINT rows list_of record { n INT q DOUBLE } }
mapping each_lines {
  source { nested_orders }
  target { each_out }
  o_orderkey -> id
  each lines -> rows { .number -> n .quantity -> q { * 2 } }
}

schema profile { user BIGINT first_seen TIMESTAMP last_seen TIMESTAMP n BIGINT total DOUBLE best DOUBLE bought BOOLEAN }
mapping user_profile (group_by user_id) {
  source { events }
  target { profile }
  user_id -> user
  ts -> first_seen { min }
  ts -> last_seen { max }
  event_id -> n { count }
  value -> total { sum | round(2) }
  value -> best { max }
  event_type -> bought { map { purchase: true, _: false } | any }
}
mapping implied_groups {
  source { lineitem }
  target { by_flag }
  l_returnflag -> flag
  l_linestatus -> status
  l_orderkey -> n { count }
  l_quantity -> quantity { sum | round(2) }
  l_extendedprice -> price { avg | round(4) }
}
schema by_flag { flag STRING status STRING n BIGINT quantity DOUBLE price DOUBLE }

schema parties { id BIGINT name STRING kind STRING }
mapping parties_customers { source { customer } target { parties } c_custkey -> id c_name -> name -> kind { "customer" } }
mapping parties_nations { source { nation } target { parties } n_nationkey -> id n_name -> name -> kind { "nation" } }

schema revenue (metric, metric_name "Revenue", source orders, grain monthly, slice {o_orderstatus}, filter "o_totalprice > 1000 AND NOT o_orderstatus IN (`P`)") {
  o_totalprice DOUBLE (measure additive)
  o_orderstatus STRING
}
schema balance (metric, source events, grain monthly, slice {event_type}) { value DOUBLE (measure semi_additive) }
schema discount_rate (metric, source lineitem, slice {l_returnflag}) { rate DOUBLE (measure non_additive) }
'''


def workspace() -> Workspace:
    return Workspace([parse(SPEC, "driver.spec")])


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _compiled(spark: SparkSession, d: str, mapping: str, options: Options | None = None, **given: DataFrame) -> Compiled:
    w = workspace()
    inputs = {s.name: given[s.name] if s.name in given else _t(spark, d, s.name) for s in w.mappings[mapping].sources if not s.is_prose}
    return compile_mapping(w, mapping, inputs, options)


def _mapped(spark: SparkSession, d: str, mapping: str, options: Options | None = None, **given: DataFrame) -> DataFrame:
    return _compiled(spark, d, mapping, options, **given).rows


# ---- projection, value maps, steps
@query("map_values", """SELECT o_orderkey AS order_id, lower(trim(o_orderpriority)) AS priority, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'pending' END AS status,
    CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 150000 THEN 'medium' WHEN o_totalprice < 300000 THEN 'large' ELSE 'huge' END AS tier FROM orders""")
def map_values(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, "order labels")


@query("map_direct_rename", "SELECT c_custkey AS id, c_name AS name, c_acctbal::DECIMAL(12,2) AS balance, nullif(lower(trim(c_mktsegment)), '') AS segment FROM customer")
def map_direct_rename(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, "customer_rename")


@query("map_pipe_strings", """SELECT p_partkey AS id, left(upper(p_name), 6) AS a, replace(replace(replace('<' || p_brand || '>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS b, replace(lower(p_type), ' ', '_') AS c,
    lpad(p_partkey::VARCHAR, 8, '0') AS d, rpad(p_partkey::VARCHAR, 8, 'x') AS e, nullif(left(p_name, 3), '') AS f, string_split(p_brand, '#')[-1] AS g FROM part""")
def map_pipe_strings(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, "part_strings_map")


@query("map_split_first_last", "SELECT o_orderkey AS id, split_part(o_orderpriority, '-', 1)::INT AS level, lower(string_split(o_orderpriority, '-')[-1]) AS word, try_cast(o_orderstatus AS DECIMAL(10,2)) AS bad FROM orders")
def map_split_first_last(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, "priority_split")


@query("map_arithmetic", """SELECT o_orderkey AS id, round(o_totalprice * 100)::BIGINT AS cents, round(o_totalprice / 2, 3)::DECIMAL(18,4) AS half, round(o_totalprice + 10 - 3, 2) AS plus, round(o_totalprice) AS whole,
    o_orderdate::DATE AS year FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000""")
def map_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, "arithmetic")


_UUID = "sha1(unhex('6BA7B8109DAD11D180B400C04FD430C8') || encode(c_name))"


@query("map_hash_key", f"""WITH h AS (SELECT *, {_UUID} AS s FROM customer) SELECT c_custkey AS id, md5(c_name) AS key, sha256(c_name) AS sha,
    substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', (position(substr(s, 17, 1) IN '0123456789abcdef')::INT - 1) % 4 + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS uuid FROM h""")
def map_hash_key(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, "customer_hash")


@query("map_validity_email", r"""WITH e AS (SELECT doc_id, lang, nullif(regexp_extract(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+', 0), '') AS contact FROM documents)
    SELECT doc_id AS id, lower(trim(contact)) AS email, coalesce(lang, 'none') AS label FROM e WHERE contact IS NOT NULL AND regexp_matches(lower(trim(contact)), '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$')""")
def map_validity_email(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "lang", F.nullif(F.regexp_extract("text", "[A-Za-z0-9._]+@[A-Za-z0-9.]+", 0), F.lit("")).alias("contact"))
    return _mapped(spark, d, "email_check", documents=docs)


@query("map_null_handling", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def map_null_handling(spark: SparkSession, d: str) -> DataFrame:
    spec = 'schema out { doc_id BIGINT quality INT state STRING } mapping m { source { documents labels } target { out } doc_id -> doc_id quality -> quality { coalesce(-1) } toxic -> state { map { null: "unlabelled" 1: "toxic" _: "clean" } } }'
    join = lambda f: f["documents"].select("doc_id").join(f["labels"], "doc_id", "left")
    w = Workspace([parse(spec)])
    return compile_mapping(w, "m", {"documents": _t(spark, d, "documents"), "labels": _t(spark, d, "labels")}, Options(join=join)).rows


# ---- joins
@query("join_lookup", "SELECT o_orderkey AS order_id, c_name AS customer, n_name AS nation, o_totalprice AS total FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def join_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The lookup side is left to Catalyst, which broadcasts it while its size allows."""
    join = lambda f: f["orders"].join(f["customer"], F.col("o_custkey") == F.col("c_custkey")).join(f["nation"], F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return _mapped(spark, d, "enrich", Options(join=join))


@query("join_left_agg", "SELECT c_custkey, coalesce(n, 0) AS n, round(total, 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def join_left_agg(spark: SparkSession, d: str) -> DataFrame:
    per = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return _t(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.round("total", 2).alias("total"))


@query("join_asof_effective", """WITH v AS (SELECT user_id, value, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events WHERE event_type = 'purchase')
    SELECT e.event_id, v.value AS price FROM (SELECT * FROM events WHERE event_type <> 'purchase') e LEFT JOIN v ON e.user_id = v.user_id AND v.valid_from <= e.ts AND (v.valid_to IS NULL OR e.ts < v.valid_to)""")
def join_asof_effective(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = e.where("event_type = 'purchase'").select("user_id", F.col("value").alias("price"), F.col("ts").alias("valid_from"), F.lead("ts").over(by).alias("valid_to"))
    return load.as_of(e.where("event_type <> 'purchase'"), v, ["user_id"], "ts").select("event_id", "price")


@query("union_targets", "SELECT c_custkey AS id, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT n_nationkey, n_name, 'nation' FROM nation")
def union_targets(spark: SparkSession, d: str) -> DataFrame:
    return compile_target(workspace(), "parties", {"customer": _t(spark, d, "customer"), "nation": _t(spark, d, "nation")}, Options(bindings={"constants": "on"})).rows


# ---- nested data
def _nested(spark: SparkSession, d: str) -> DataFrame:
    line = F.struct(F.col("l_linenumber").alias("number"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("returnflag"))
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    orders = _t(spark, d, "orders").select("o_orderkey", F.struct(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("customer"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))


@query("flatten_lines", "SELECT o_orderkey AS order_id, o_orderstatus AS status, l_linenumber AS number, l_extendedprice AS amount, lower(l_returnflag) AS flag FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag <> 'A'")
def flatten_lines(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, "flatten_lines", nested_orders=_nested(spark, d))


@query("each_lines", """SELECT o_orderkey AS id, count(l_linenumber) FILTER (l_returnflag <> 'A') AS n, round(coalesce(sum(l_quantity * 2) FILTER (l_returnflag <> 'A'), 0), 2) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def each_lines(spark: SparkSession, d: str) -> DataFrame:
    got = _mapped(spark, d, "each_lines", nested_orders=_nested(spark, d))
    total = F.aggregate("rows", F.lit(0.0), lambda a, e: a + e["q"])
    return got.select("id", F.size("rows").cast("long").alias("n"), F.round(total, 2).alias("q"))


@query("json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# ---- deeper targets, rows that steps drop before groups, mixed measures
_DEEP = Workspace([parse("""
schema shipped { id BIGINT to record { place record { nation INT segment STRING (default "none") } name STRING(6) } }
mapping deep { source { customer } target { shipped }
  c_custkey -> id
  c_nationkey -> to.place.nation
  c_mktsegment -> to.place.segment { lowercase }
  c_name -> to.name { prepend("c ") }
}
schema best { status STRING least DOUBLE known BIGINT }
mapping best_of (group_by status) { source { s } target { best }
  status -> status
  price -> least { drop_if_null | min }
  price -> known { warn_if_null | count }
}
schema levels (metric, grain daily) {
  stock DOUBLE (measure semi_additive)
  sold DOUBLE (measure additive)
  mean DOUBLE (measure non_additive)
}
""")])


@query("nested_targets", "SELECT c_custkey AS id, c_nationkey AS nation, coalesce(lower(c_mktsegment), 'none') AS segment, 'c ' || c_name AS name FROM customer")
def nested_targets(spark: SparkSession, d: str) -> DataFrame:
    got = compile_mapping(_DEEP, "deep", {"customer": _t(spark, d, "customer")}).rows
    return got.select("id", "to.place.nation", "to.place.segment", "to.name")


@query("group_dropped_rows", "SELECT o_orderstatus AS status, min(o_totalprice) AS least, count(o_totalprice) AS known FROM orders WHERE o_custkey % 7 <> 0 GROUP BY 1")
def group_dropped_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose price is null, as every seventh customer's is made here, are dropped before they are grouped."""
    rows = _t(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice")).alias("price"))
    return compile_mapping(_DEEP, "best_of", {"s": rows}).rows


@query("metric_mixed_measures", """WITH f AS (SELECT l_returnflag AS flag, CAST(l_shipdate AS TIMESTAMP) AS moment, l_quantity AS stock, l_quantity AS sold FROM lineitem),
    t AS (SELECT flag, moment, sum(stock) AS stock FROM f GROUP BY 1, 2), k AS (SELECT flag, date_trunc('day', moment)::DATE AS day, max_by(stock, moment) AS stock FROM t GROUP BY 1, 2),
    s AS (SELECT flag, date_trunc('day', moment)::DATE AS day, sum(sold) AS sold, sum(sold) / count(*) AS mean FROM f GROUP BY 1, 2)
    SELECT flag, day, stock, sold, round(mean, 6) AS mean FROM k JOIN s USING (flag, day)""")
def metric_mixed_measures(spark: SparkSession, d: str) -> DataFrame:
    fact = _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("at"), F.col("l_quantity").alias("stock"), F.col("l_quantity").alias("sold"))
    return compile_metric(_DEEP, "levels", fact, time="at", slices=["flag"], components={"mean": "sum(sold) / count(1)"}).withColumn("mean", F.round("mean", 6))


# ---- groups and metrics
@query("group_session_profile", """SELECT user_id AS user, min(ts) AS first_seen, max(ts) AS last_seen, count(event_id) AS n, round(sum(value), 2) AS total, max(value) AS best, bool_or(event_type = 'purchase') AS bought FROM events GROUP BY user_id""")
def group_session_profile(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, "user_profile")


@query("group_implied", "SELECT l_returnflag AS flag, l_linestatus AS status, count(l_orderkey) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY 1, 2")
def group_implied(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, "implied_groups")


@query("cond_aggregates", """SELECT l_returnflag, count(*) FILTER (l_quantity > 25) AS many, round(sum(CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE 0 END), 2) AS discounted, count(DISTINCT l_partkey) AS parts,
    round(sum(l_extendedprice) / count(DISTINCT l_orderkey), 2) AS per_order FROM lineitem GROUP BY 1""")
def cond_aggregates(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem")
    sums = aggregate.counted_if(lines, ["l_returnflag"], {"many": F.col("l_quantity") > 25}, {"discounted": (F.col("l_discount") > 0.05, F.col("l_extendedprice"))})
    told = lines.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.round(F.sum("l_extendedprice") / F.count_distinct("l_orderkey"), 2).alias("per_order"))
    return sums.withColumn("discounted", F.round("discounted", 2)).join(told, "l_returnflag")


@query("mode_tie_break", """SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1""")
def mode_tie_break(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.mode(_t(spark, d, "events"), ["user_id"], "event_type")


@query("rfm_quintiles", """WITH t AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total, o_custkey) AS place, count(*) OVER () AS n FROM t)
    SELECT o_custkey, (((place - 1) * 5) // n + 1)::BIGINT AS quintile FROM r""")
def rfm_quintiles(spark: SparkSession, d: str) -> DataFrame:
    total = _t(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return aggregate.tiles(total, ["total", "o_custkey"], 5, "quintile").drop("total")


@query("trailing_30d", """WITH days AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, day, (sum(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW))::BIGINT AS trailing FROM days""")
def trailing_30d(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return aggregate.trailing(events, ["user_id"], "day", {"trailing": F.count(F.lit(1))}, 30)


@query("metric_monthly_revenue", "SELECT o_orderstatus, date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice), 2) AS o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus NOT IN ('P') GROUP BY 1, 2")
def metric_monthly_revenue(spark: SparkSession, d: str) -> DataFrame:
    return compile_metric(workspace(), "revenue", _t(spark, d, "orders"), "o_orderdate").withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("metric_semi_additive", """WITH d AS (SELECT event_type, ts, sum(value) AS v FROM events GROUP BY 1, 2) SELECT event_type, date_trunc('month', ts)::DATE AS month, round(arg_max(v, ts), 4) AS value FROM d GROUP BY 1, 2""")
def metric_semi_additive(spark: SparkSession, d: str) -> DataFrame:
    return compile_metric(workspace(), "balance", _t(spark, d, "events"), "ts").withColumn("value", F.round("value", 4))


@query("metric_non_additive", "SELECT l_returnflag, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) AS rate FROM lineitem GROUP BY 1")
def metric_non_additive(spark: SparkSession, d: str) -> DataFrame:
    parts = {"rate": "round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6)"}
    return compile_metric(workspace(), "discount_rate", _t(spark, d, "lineitem"), components=parts)


# ---- loads
def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Existing customers, and incoming ones with another balance; every customer is in one of them, some in both."""
    c = _t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0 OR c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)


_OLD, _NEW = "(SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0)", "(SELECT c_custkey, c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0)"


@query("merge_upsert", f"SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal ELSE o.c_acctbal END AS c_acctbal FROM {_OLD} o FULL JOIN {_NEW} n ON o.c_custkey = n.c_custkey")
def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    return load.upsert(*_halves(spark, d), ["c_custkey"])


@query("merge_append", f"SELECT * FROM {_OLD} UNION ALL SELECT * FROM {_NEW}")
def merge_append(spark: SparkSession, d: str) -> DataFrame:
    return load.append(*_halves(spark, d))


@query("merge_refresh", f"SELECT * FROM {_NEW}")
def merge_refresh(spark: SparkSession, d: str) -> DataFrame:
    return load.full_refresh(*_halves(spark, d))


@query("merge_soft_delete", f"SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(o.c_name, n.c_name) AS c_name, n.c_custkey IS NOT NULL AS is_deleted, CASE WHEN n.c_custkey IS NOT NULL THEN DATE '2024-01-01' END AS deleted_at FROM {_OLD} o FULL JOIN {_NEW} n ON o.c_custkey = n.c_custkey")
def merge_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    target = old.select("c_custkey", "c_name", F.lit(False).alias("is_deleted"), F.lit(None).cast("date").alias("deleted_at"))
    return load.soft_delete(target, new.select("c_custkey", "c_name"), ["c_custkey"], "is_deleted", "deleted_at", F.lit("2024-01-01").cast("date"))


_SNAPSHOTS = "(SELECT user_id, ts::DATE AS day, max(event_type) AS state FROM events GROUP BY 1, 2)"


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.max("event_type").alias("state"))


_SCD2 = f"""WITH c AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY day) AS was FROM {_SNAPSHOTS}), s AS (SELECT * FROM c WHERE was IS NULL OR was <> state),
    v AS (SELECT user_id, state, day AS valid_from, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS valid_to FROM s)"""


@query("scd2_history", f"{_SCD2} SELECT user_id, state, valid_from, valid_to, valid_to IS NULL AS is_current, sha256(user_id || '|' || valid_from) AS surrogate_key FROM v")
def scd2_history(spark: SparkSession, d: str) -> DataFrame:
    return load.scd2_history(_snapshots(spark, d), ["user_id"], "day", ["state"]).drop("row_hash")


@query("scd6_overlay", f"{_SCD2} SELECT user_id, state, valid_from, last_value(state) OVER (PARTITION BY user_id ORDER BY valid_from ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS current_state FROM v")
def scd6_overlay(spark: SparkSession, d: str) -> DataFrame:
    history = load.scd2_history(_snapshots(spark, d), ["user_id"], "day", ["state"])
    return load.scd6(history, ["user_id"], ["state"]).select("user_id", "state", "valid_from", "current_state")


@query("vault_hub", "SELECT sha256(upper(trim(c_name))) AS customer_hk, c_name, 'crm' AS record_source, min(o_orderdate) AS load_date FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_name")
def vault_hub(spark: SparkSession, d: str) -> DataFrame:
    source = _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return load.hub(source, ["c_name"], "customer", "o_orderdate", F.lit("crm"))


@query("vault_satellite", f"""WITH c AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY day) AS was FROM {_SNAPSHOTS}), s AS (SELECT * FROM c WHERE was IS NULL OR was <> state)
    SELECT sha256(upper(trim(user_id::VARCHAR))) AS user_hk, state, day AS load_date, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS load_end_date FROM s""")
def vault_satellite(spark: SparkSession, d: str) -> DataFrame:
    return load.satellite(_snapshots(spark, d), ["user_id"], "user", ["state"], "day").drop("hash_diff")


@query("vault_link", "SELECT sha256(upper(trim(o_custkey::VARCHAR)) || '||' || upper(trim(o_orderkey::VARCHAR))) AS sale_hk, sha256(upper(trim(o_custkey::VARCHAR))) AS customer_hk, sha256(upper(trim(o_orderkey::VARCHAR))) AS order_hk, min(o_orderdate) AS load_date FROM orders GROUP BY o_custkey, o_orderkey")
def vault_link(spark: SparkSession, d: str) -> DataFrame:
    return load.link(_t(spark, d, "orders"), {"customer": ["o_custkey"], "order": ["o_orderkey"]}, "sale", "o_orderdate")


# ---- quality and governance
@query("dq_checks", """SELECT 'required' AS rule, 'o_orderkey' AS field, count(*) FILTER (o_orderkey IS NULL) AS n FROM orders UNION ALL SELECT 'required', 'o_custkey', count(*) FILTER (o_custkey IS NULL) FROM orders
    UNION ALL SELECT 'enum', 'o_orderstatus', count(*) FILTER (o_orderstatus NOT IN ('F', 'O', 'P')) FROM orders
    UNION ALL SELECT 'unique', 'o_orderkey', coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey IS NOT NULL GROUP BY o_orderkey HAVING count(*) > 1)
    UNION ALL SELECT 'ref', 'o_custkey', count(*) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def dq_checks(spark: SparkSession, d: str) -> DataFrame:
    return quality.checks(workspace(), "orders", _t(spark, d, "orders"), {"customer": _t(spark, d, "customer")})


@query("dq_referential", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IS NOT NULL AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def dq_referential(spark: SparkSession, d: str) -> DataFrame:
    return quality.referential(_t(spark, d, "lineitem"), "l_suppkey", _t(spark, d, "supplier").where("s_acctbal > 0"), "s_suppkey").select("l_orderkey", "l_linenumber")


@query("gov_mask", "SELECT c_custkey, '****' || right(c_name, 4) AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def gov_mask(spark: SparkSession, d: str) -> DataFrame:
    return quality.masked(workspace(), "customer", _t(spark, d, "customer"))


@query("gov_access", "SELECT c_custkey, '****' || right(c_name, 4) AS c_name, c_nationkey, c_mktsegment FROM customer")
def gov_access(spark: SparkSession, d: str) -> DataFrame:
    return quality.access_view(workspace(), "customer", _t(spark, d, "customer"), "INTERNAL")


@query("gov_retention", "SELECT o_orderkey, CASE WHEN NOT (o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 2 YEAR) THEN o_totalprice END AS o_totalprice FROM orders")
def gov_retention(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("1998-01-01").cast("timestamp_ntz")
    return quality.retain(_t(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), "o_orderdate", "2y", now, ["o_totalprice"]).drop("o_orderdate")


@query("filter_source", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND NOT o_orderpriority LIKE '1-%' AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderdate >= DATE '1995-01-01'")
def filter_source(spark: SparkSession, d: str) -> DataFrame:
    spec = "schema out { o_orderkey BIGINT } mapping m { source { orders (filter \"o_orderstatus IN (`F`, `O`) AND NOT o_orderpriority LIKE '1-%' AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderdate >= DATE '1995-01-01'\") } target { out } o_orderkey -> o_orderkey }"
    return compile_mapping(Workspace([parse(spec)]), "m", {"orders": _t(spark, d, "orders")}).rows


# ---- questions about specifications
GRAPH = '''
schema raw { id INT amount DECIMAL(10,2) country STRING (pii) note_text STRING }
schema base { id INT amount DECIMAL(10,2) region STRING extra STRING }
schema mart { id INT total DECIMAL(12,2) label STRING }
schema loop_a { x INT }
schema loop_b { x INT }
schema hidden { secret STRING }
mapping m1 { source { raw } target { base } id -> id amount -> amount { round(2) } country -> region { map { NL: "EU" default: "other" } } -> extra { "built from @raw.note_text and @country" } }
mapping m2 { source { base } target { mart } id -> id amount -> total region -> label { uppercase } missing -> label }
mapping m3 { source { raw } target { mart } -> label { "see @hidden.secret, and @nowhere.field" } }
mapping c1 { source { loop_a } target { loop_b } x -> x }
mapping c2 { source { loop_b } target { loop_a } x -> x }
schema raw_copy (metric, source {raw, base}, grain daily) { Amount_ DECIMAL(10,2) (measure) ID INT }
schema mart { label STRING }
'''


def _catalog(spark: SparkSession, text: str = GRAPH) -> Catalog:
    return Catalog(spark, Workspace([parse(text, "graph.spec")]))


@example("lineage_down", "SELECT * FROM (VALUES ('base', 1), ('mart', 1), ('raw_copy', 1)) t(node, depth)")
def lineage_down(spark: SparkSession, d: str) -> DataFrame:
    return graph.lineage(_catalog(spark), "raw").select("node", "depth")


@example("lineage_up", "SELECT * FROM (VALUES ('base', 1), ('raw', 1), ('hidden', 1)) t(node, depth)")
def lineage_up(spark: SparkSession, d: str) -> DataFrame:
    return graph.lineage(_catalog(spark), "mart", upstream=True).select("node", "depth")


@example("lineage_cycle", "SELECT * FROM (VALUES ('loop_b', 1)) t(node, depth)")
def lineage_cycle(spark: SparkSession, d: str) -> DataFrame:
    return graph.lineage(_catalog(spark), "loop_a").select("node", "depth")


@example("field_lineage", "SELECT * FROM (VALUES ('::base.region', 1, 'm1', 'nl'), ('::base.extra', 1, 'm1', 'nl-derived'), ('::mart.label', 2, 'm2', 'nl')) t(node, depth, mapping, classification)")
def field_lineage(spark: SparkSession, d: str) -> DataFrame:
    return graph.field_lineage(_catalog(spark), "::raw.country")


@example("upstream_paths", "SELECT * FROM (VALUES ('raw>mart'), ('raw>base>mart'), ('hidden>mart')) t(path)")
def upstream_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.upstream_paths(spark, graph.schema_edges(_catalog(spark)), "mart").select(F.array_join("path", ">").alias("path"))


@example("coverage_unmapped", "SELECT 'raw' AS owner, 'note_text' AS path")
def coverage_unmapped(spark: SparkSession, d: str) -> DataFrame:
    return describe.unmapped(_catalog(spark), "raw", "m1")


@example("match_fields", "SELECT * FROM (VALUES ('id', 'ID', 'matched'), ('amount', 'Amount_', 'matched'), ('country', NULL, 'source-only'), ('note_text', NULL, 'source-only')) t(source_path, target_path, state)")
def match_fields(spark: SparkSession, d: str) -> DataFrame:
    return describe.match_fields(_catalog(spark), "raw", "raw_copy")


@example("validate_rules", """SELECT * FROM (VALUES ('duplicate-definition', 'mart'), ('unresolved-nl-ref', 'm3'), ('nl-ref-not-in-source', 'm3'), ('field-not-in-schema', 'm2')) t(rule, subject)""")
def validate_rules(spark: SparkSession, d: str) -> DataFrame:
    return validate.validate(_catalog(spark)).select("rule", "subject")


@example("spec_diff", """SELECT * FROM (VALUES ('block', 'mapping c2', 'removed'), ('arrow', 'c2: x -> x', 'removed'), ('arrow', 'm1: amount -> amount', 'changed'), ('field', 'base.region', 'changed'), ('field', 'base.added', 'added')) t(what, key, change)""")
def spec_diff(spark: SparkSession, d: str) -> DataFrame:
    new = "\n".join(x for x in GRAPH.split("\n") if not x.startswith("mapping c2")).replace("round(2)", "round(3)").replace("region STRING extra STRING", "region VARCHAR(3) extra STRING added INT")
    return describe.diff(_catalog(spark), _catalog(spark, new)).select("what", "key", "change")


@example("where_used", "SELECT * FROM (VALUES ('m1', 'mapping'), ('m3', 'mapping'), ('m1', 'nl_ref'), ('raw_copy', 'metric')) t(user, kind)")
def where_used(spark: SparkSession, d: str) -> DataFrame:
    return describe.where_used(_catalog(spark), "raw").select("user", "kind").distinct()


@example("find_tag", "SELECT 'raw' AS owner, 'country' AS field")
def find_tag(spark: SparkSession, d: str) -> DataFrame:
    return describe.find(_catalog(spark), "PII").select("owner", "field")


@example("spec_summary", "SELECT * FROM (VALUES ('schema', 7), ('metric', 1), ('mapping', 5), ('fields', 16), ('files', 1), ('declared_arrows', 11), ('arrows', 14)) t(kind, n)")
def spec_summary(spark: SparkSession, d: str) -> DataFrame:
    return describe.summary(_catalog(spark))


@example("schema_rollup", "SELECT * FROM (VALUES ('::raw', '::base', 'm1'), ('::base', '::mart', 'm2'), ('::hidden', '::mart', 'm3'), ('::loop_a', '::loop_b', 'c1'), ('::loop_b', '::loop_a', 'c2')) t(src, dst, mapping)")
def schema_rollup(spark: SparkSession, d: str) -> DataFrame:
    return graph.schema_rollup(_catalog(spark)).select("src", "dst", "mapping")


@example("context_search", "SELECT 'm1' AS block UNION ALL SELECT 'raw'")
def context_search(spark: SparkSession, d: str) -> DataFrame:
    return describe.context(_catalog(spark), "the country").select("block")


# ---- stars, lists and selectors
def _dimension(spark: SparkSession, d: str) -> DataFrame:
    first = _t(spark, d, "customer").select("c_custkey", "c_mktsegment", F.lit("1990-01-01").cast("date").alias("day"))
    return load.scd2_history(first, ["c_custkey"], "day", ["c_mktsegment"])


@query("fact_dimension_keys", "SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN sha256(c_custkey || '|1990-01-01') END AS customer_key, 'b1' AS etl_batch_id, DATE '2024-01-01' AS loaded_at FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def fact_dimension_keys(spark: SparkSession, d: str) -> DataFrame:
    facts = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return load.with_dimension_keys(facts, {"customer": (_dimension(spark, d), "c_custkey", "o_custkey")}, "b1", F.lit("2024-01-01").cast("date")).drop("o_custkey")


@query("fact_grain", "SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def fact_grain(spark: SparkSession, d: str) -> DataFrame:
    return load.grain_violations(_t(spark, d, "lineitem"), ["l_orderkey", "l_returnflag"])


@query("snapshot_accumulating", """SELECT user_id, min(ts) FILTER (event_type = 'view') AS view, min(ts) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1""")
def snapshot_accumulating(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    none = e.limit(0).select("user_id", F.col("ts").alias("view"), F.col("ts").alias("purchase"))
    return load.accumulating_snapshot(none, e, ["user_id"], "event_type", "ts", ["view", "purchase"])


@query("list_positional", """WITH o AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity, l_returnflag) AS q, list(l_returnflag ORDER BY l_linenumber, l_quantity, l_returnflag) AS f FROM lineitem GROUP BY 1)
    SELECT l_orderkey, i::INT AS place, q[i] AS quantity, f[i] AS flag FROM (SELECT *, unnest(range(1, len(q) + 1)) AS i FROM o)""")
def list_positional(spark: SparkSession, d: str) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag")))
    o = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(lines.alias("x")).select("l_orderkey", F.transform("x", lambda e: e["l_quantity"]).alias("q"), F.transform("x", lambda e: e["l_returnflag"]).alias("f"))
    return aggregate.by_position({"quantity": F.col("q"), "flag": F.col("f")}, o, ["l_orderkey"])


@query("list_earliest", "SELECT l_orderkey, min(l_shipdate) AS first_ship, sum(l_quantity) AS total, count(*) AS n FROM lineitem GROUP BY 1")
def list_earliest(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_shipdate", "l_quantity")).alias("x"))
    return o.select("l_orderkey", F.array_min(F.transform("x", lambda e: e["l_shipdate"])).alias("first_ship"), F.aggregate("x", F.lit(0.0), lambda a, e: a + e["l_quantity"]).alias("total"), F.size("x").cast("long").alias("n"))


@query("select_jsonpath", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def select_jsonpath(spark: SparkSession, d: str) -> DataFrame:
    fields = parse('schema p { k INT (jsonpath "$.k") }').blocks[0].fields
    return _t(spark, d, "events").select("event_id", *selected(F.col("props"), fields))


@query("fixed_length", "SELECT o_orderkey, o_orderstatus AS status, (round(o_totalprice * 100) / 100)::DECIMAL(12,2) AS price FROM orders")
def fixed_length_records(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as fixed-length records and read back by their offsets."""
    line = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, " "), F.rpad("o_orderstatus", 3, " "), F.lpad(F.round(F.col("o_totalprice") * 100).cast("long").cast("string"), 12, "0"))
    fields = parse("schema r (format fixed-length) { o_orderkey BIGINT (offset 0, length 10) status STRING (offset 10, length 3) price DECIMAL(12,2) (offset 13, length 12, scale 2) }").blocks[0].fields
    return _t(spark, d, "orders").select(line.alias("value")).select(*fixed_length(F.col("value"), fields))


@example("gov_propagation", "SELECT * FROM (VALUES ('::copy.who', 'CONFIDENTIAL', NULL, true), ('::copy.balance', 'RESTRICTED', 1095, false), ('::copy.both', 'RESTRICTED', 1095, true)) t(field, classification, retention_days, pii)")
def gov_propagation(spark: SparkSession, d: str) -> DataFrame:
    more = "schema copy { who STRING balance DOUBLE both STRING } mapping cp { source { customer } target { copy } c_name -> who c_acctbal -> balance c_name, c_acctbal -> both { concat } }"
    return quality.propagated(_catalog(spark, SPEC + more)).where("field LIKE '::copy.%'")


@example("gov_impact", "SELECT * FROM (VALUES ('raw.country', '::base.region', 1), ('raw.country', '::base.extra', 1), ('raw.country', '::mart.label', 2)) t(field, node, depth)")
def gov_impact(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact(_catalog(spark), "pii")


@example("facet_column_lineage", """SELECT * FROM (VALUES ('::loop_b', '{"fields":{"x":{"inputFields":[{"name":"::loop_a","field":"x","transformationType":"IDENTITY"}]}}}')) t(dataset, facet)""")
def facet_column_lineage(spark: SparkSession, d: str) -> DataFrame:
    return column_lineage(_catalog(spark).fedges).where("dataset = '::loop_b'")


@example("coverage_sides", "SELECT * FROM (VALUES ('source', 4, 3), ('target', 4, 4)) t(side, n, mapped)")
def coverage_sides(spark: SparkSession, d: str) -> DataFrame:
    """Prose references do not count as coverage, so one source field of m1 is open."""
    c = describe.coverage(_catalog(spark)).where("mapping = 'm1'")
    return c.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_if("mapped").alias("mapped"))


@example("arrows_at_field", "SELECT * FROM (VALUES ('::raw.id', '::base.id', 'none'), ('::base.id', '::mart.id', 'none')) t(src, dst, classification)")
def arrows_at_field(spark: SparkSession, d: str) -> DataFrame:
    return describe.arrows(_catalog(spark), "::base.id").select("src", "dst", "classification")


@example("metric_definition", "SELECT 'revenue' AS key, 'Revenue' AS metric_name, 'orders' AS source, 'monthly' AS grain, 'o_totalprice' AS measure, 'o_orderstatus' AS slice")
def metric_definition(spark: SparkSession, d: str) -> DataFrame:
    m = describe.metric(_catalog(spark, SPEC), "revenue")
    return m.select("key", "metric_name", "source", "grain", F.array_join("measures", ",").alias("measure"), F.array_join("slices", ",").alias("slice"))


@example("governance_gaps", "SELECT * FROM (VALUES ('pii-without-classification', 'raw.country'), ('pii-without-retention', 'raw.country'), ('pii-without-protection', 'raw.country')) t(rule, subject)")
def governance_gaps(spark: SparkSession, d: str) -> DataFrame:
    return validate.governance_rules(_catalog(spark)).select("rule", "subject")


@example("prose_references", "SELECT * FROM (VALUES ('raw.note_text', 'raw', 'note_text'), ('country', 'raw', 'country'), ('hidden.secret', 'hidden', 'secret'), ('nowhere.field', NULL, NULL)) t(ref, schema, field)")
def prose_references(spark: SparkSession, d: str) -> DataFrame:
    return describe.prose_refs(_catalog(spark)).select("ref", "schema", "field")


@example("lint_rules", "SELECT * FROM (VALUES ('hidden-source-in-nl', 'm3'), ('unresolved-nl-ref', 'm3'), ('duplicate-definition', 'mart')) t(rule, subject)")
def lint_rules(spark: SparkSession, d: str) -> DataFrame:
    return validate.lint(_catalog(spark)).select("rule", "subject")


@example("graph_nodes", "SELECT * FROM (VALUES ('schema', 6), ('metric', 1), ('mapping', 5)) t(kind, n)")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(_catalog(spark)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# ---- extensions
@query("ext_cube", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS \"grouping\", count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark: SparkSession, d: str) -> DataFrame:
    return extend.cube(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], [F.count(F.lit(1)).alias("n")])


@query("ext_rollup", "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority)::BIGINT AS \"grouping\", round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def ext_rollup(spark: SparkSession, d: str) -> DataFrame:
    return extend.rollup(_t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], [F.round(F.sum("o_totalprice"), 2).alias("total")])


@query("ext_sessions", """WITH g AS (SELECT *, CASE WHEN epoch(ts)::BIGINT - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))::BIGINT > 86400 OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
    s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS session FROM g) SELECT user_id, session, count(*) AS n FROM s GROUP BY 1, 2""")
def ext_sessions(spark: SparkSession, d: str) -> DataFrame:
    return extend.sessions(_t(spark, d, "events"), ["user_id"], "ts", 86400).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))


@query("ext_top", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def ext_top(spark: SparkSession, d: str) -> DataFrame:
    return extend.top(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).drop("o_totalprice")


@query("ext_range_join", "SELECT p_partkey, b.low FROM part JOIN (SELECT DISTINCT floor(s_acctbal / 50) * 50 AS low FROM supplier) b ON b.low <= p_retailprice AND p_retailprice < b.low + 120")
def ext_range_join(spark: SparkSession, d: str) -> DataFrame:
    low = (F.floor(F.col("s_acctbal") / 50) * 50).cast("double")
    bands = _t(spark, d, "supplier").select(low.alias("low")).distinct().withColumn("high", F.col("low") + 120)
    return extend.range_join(_t(spark, d, "part").select("p_partkey", "p_retailprice"), bands, "p_retailprice", "low", "high", 100.0).select("p_partkey", "low")


@query("ext_range_join_wide", """WITH b AS (SELECT s_suppkey, s_acctbal AS low, s_acctbal + power(10, s_suppkey % 5) / 10 AS high FROM supplier WHERE s_suppkey % 7 <> 0) SELECT p_partkey, s_suppkey FROM part JOIN b ON low <= p_retailprice AND p_retailprice < high""")
def ext_range_join_wide(spark: SparkSession, d: str) -> DataFrame:
    """Intervals from a tenth to a thousand: each stands in two cells of its own width at most."""
    s = _t(spark, d, "supplier").where("s_suppkey % 7 <> 0")
    bands = s.select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + F.pow(F.lit(10.0), F.col("s_suppkey") % 5) / 10).alias("high"))
    return extend.range_join(_t(spark, d, "part").select("p_partkey", "p_retailprice"), bands, "p_retailprice", "low", "high", 0.05).select("p_partkey", "s_suppkey")


@query("ext_heavy_join", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN (SELECT DISTINCT o_orderstatus AS s FROM orders) ON o_orderstatus = s GROUP BY 1")
def ext_heavy_join(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return extend.heavy_join(o, o.select("o_orderstatus").distinct(), ["o_orderstatus"], 8).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("ext_set_operations", "(SELECT c_nationkey AS k FROM customer EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0) UNION (SELECT s_nationkey FROM supplier INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def ext_set_operations(spark: SparkSession, d: str) -> DataFrame:
    zero = _t(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("k"))
    a = _t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(zero)
    return a.union(_t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).intersect(zero)).distinct()


@example("merge_rules", "SELECT * FROM (VALUES ('merge-needs-match-on', 'a'), ('merge-unknown', 'b'), ('merge-append-match-on', 'c'), ('merge-needs-delete-flag', 'd')) t(rule, subject)")
def merge_rules(spark: SparkSession, d: str) -> DataFrame:
    text = "schema s { i INT } " + " ".join(f"mapping {n} ({m}) {{ source {{ s }} target {{ s }} i -> i }}" for n, m in (("a", "merge upsert"), ("b", "merge wrong"), ("c", "merge append, match_on i"), ("d", "merge soft_delete, match_on i"), ("e", "merge upsert, match_on i")))
    return validate.merge_rules(_catalog(spark, text)).select("rule", "subject")
