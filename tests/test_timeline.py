"""Time lines: as-of joins of hot keys, late versions in every order, snapshots without gaps, nulls and empty tables."""

import itertools
import re
import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from weftline.operators import load, timeline


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_as_of_costs_the_sum_of_both_sides(spark):
    """One key with 200,000 facts and as many versions: pairs would be 4 * 10 ** 10."""
    n = 200_000
    at = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    facts = spark.range(n).select(F.lit(1).alias("k"), "id", at(F.col("id") * 60 + 30).alias("at"))
    versions = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("v"), at(F.col("id") * 60).alias("valid_from"), at(F.col("id") * 60 + 45).alias("valid_to"))
    began = time.perf_counter()
    got = timeline.as_of(facts, versions, ["k"], "at", days=10)
    assert got.where("v = id").count() == n
    assert time.perf_counter() - began < 60
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoop", plan)


def test_as_of_edges(spark):
    t = lambda text: datetime.fromisoformat(text) if text else None
    facts = [(1, 1, t("2024-01-01")), (2, 1, t("2023-12-31")), (3, 1, t("2024-03-01")), (4, 1, t("2024-02-01")), (5, None, t("2024-03-01")), (6, 1, None), (7, 2, t("2024-03-01"))]
    versions = [(1, t("2024-01-01"), t("2024-02-01"), "a"), (1, t("2024-02-15"), None, "b"), (None, t("2020-01-01"), None, "n"), (1, None, None, "x")]
    f = spark.createDataFrame(facts, "id int, k int, at timestamp_ntz")
    v = spark.createDataFrame(versions, "k int, valid_from timestamp_ntz, valid_to timestamp_ntz, what string")
    for days in (1, 7, 1000):
        assert {r.id: r.what for r in timeline.as_of(f, v, ["k"], "at", days=days).collect()} == {1: "a", 2: None, 3: "b", 4: None, 5: None, 6: None, 7: None}
    assert timeline.as_of(f.limit(0), v, ["k"], "at").count() == 0
    assert timeline.as_of(f, v.limit(0), ["k"], "at").where("what IS NULL").count() == 7
    dated = v.withColumns({"valid_from": F.col("valid_from").cast("date"), "valid_to": F.col("valid_to").cast("date")})
    assert rows(timeline.as_of(f, dated, ["k"], "at").select("id", "what")) == rows(timeline.as_of(f, v, ["k"], "at").select("id", "what"))
    with pytest.raises(TypeError, match="no time"):
        timeline.slot(v, "what", 1)


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_versions_do_not_depend_on_the_order_of_loads(spark, order):
    seen = [("k", date(2024, 1, d), v) for d, v in ((1, "a"), (3, "a"), (5, "b"), (5, "c"), (8, "c"), (9, "a"))] + [(None, date(2024, 1, 2), "n"), (None, date(2024, 1, 1), "n"), ("l", None, "z")]
    table = lambda part: spark.createDataFrame(part, "k string, at date, v string")
    want = load.scd2_history(table(seen).where("at IS NOT NULL"), ["k"], "at", ["v"])
    loads = [table(seen[i::3]) for i in order]
    versions, sightings = load.scd2_history(table([]), ["k"], "at", ["v"]), table([])
    for part in loads:
        versions, sightings = load.scd2_arrivals(versions, sightings, part, ["k"], "at", ["v"])
    names = ["k", "v", "valid_from", "valid_to", "is_current"]
    assert rows(versions.select(names)) == rows(want.select(names))
    again, _ = load.scd2_arrivals(versions, sightings, loads[0], ["k"], "at", ["v"])
    assert rows(again.select(names)) == rows(want.select(names))


def test_levels_have_no_gaps(spark):
    changes = [("a", datetime(2024, 1, 1, 5), 1), ("a", datetime(2024, 1, 1, 9), 2), ("a", datetime(2024, 1, 4), None), ("b", datetime(2024, 1, 5), 7), (None, datetime(2024, 1, 1), 1), ("c", None, 1)]
    df = spark.createDataFrame(changes, "k string, at timestamp_ntz, v int")
    got = timeline.levels(df, ["k"], "at", ["v"], F.lit("2024-01-05").cast("date"))
    assert rows(got) == sorted(("a", f"2024-01-0{d}", v) for d, v in zip(range(1, 6), ("2", "2", "2", "None", "None"), strict=True)) + [("b", "2024-01-05", "7")]
    balance = timeline.running_levels(df, ["k"], "at", "v", F.lit("2024-01-05").cast("date"))
    assert [r[2] for r in rows(balance)] == ["3", "3", "3", "3", "3", "7"]
    assert timeline.levels(df, ["k"], "at", ["v"], F.lit("2023-01-05").cast("date")).count() == 0


def test_a_load_of_null_keys_can_be_run_again(spark):
    t = spark.createDataFrame([(None, 1, "a"), (1, None, "b")], "x int, y int, v string")
    s = spark.createDataFrame([(None, 1, "c"), (None, None, "d")], "x int, y int, v string")
    once = load.upsert(t, s, ["x", "y"])
    assert rows(once) == rows(load.upsert(once, s, ["x", "y"])) == [("1", "None", "b"), ("None", "1", "c"), ("None", "None", "d")]


def test_versions_in_force_move_once(spark):
    """What point-in-time table and equi joins give, with one shuffle for each satellite and those of the hub."""
    t = lambda text: datetime.fromisoformat(text) if text else None
    seen = [("k", t("2024-01-01"), "a", 1), ("k", t("2024-01-31 00:00"), "b", 1), ("k", t("2024-01-31 00:01"), "c", 1), ("l", t("2024-02-01"), None, 3), ("l", t("2024-03-01"), "e", None), (None, t("2024-01-01"), "n", 4), ("k", None, "z", 5)]
    source = spark.createDataFrame(seen, "id string, load_date timestamp_ntz, x string, y int")
    hub = load.hub(source.unionByName(spark.createDataFrame([("m", t("2024-01-01"), "q", 1)], source.schema)), ["id"], "id", "load_date", F.lit("s"))
    satellites = {c: load.satellite(source.where("load_date IS NOT NULL"), ["id"], "id", [c], "load_date") for c in ("x", "y")}
    dates = [F.lit(d).cast("date") for d in ("2023-12-31", "2024-01-31", "2024-02-01", "2025-01-01")]
    got = timeline.in_force(hub, "id_hk", satellites, dates)
    want = timeline.with_satellites(timeline.point_in_time(hub, "id_hk", satellites, dates), "id_hk", satellites)
    assert got.count() == 12 and sorted(got.columns) == sorted(want.columns)
    assert rows(got.select(sorted(got.columns))) == rows(want.select(sorted(got.columns)))
    assert timeline.in_force(hub, "id_hk", {n: s.limit(0) for n, s in satellites.items()}, dates).where("x_load_date IS NULL").count() == 12


def test_point_in_time_query_moves_each_row_once(spark):
    from weftline.plans import registry

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()["vault_point_in_time"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= 4
