"""Modes, tiles, trailing sums, lists by position and range joins of any width: ties, nulls, empty tables, against plain Python."""

import random
from datetime import date, timedelta

import duckdb
from pyspark.sql import functions as F

from weftline.operators import aggregate, extend
from weftline.plans import registry


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_mode(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, None), (2, None), (None, "z"), (3, "c"), (3, "d"), (3, "d")], "k int, v string")
    assert rows(aggregate.mode(df, ["k"], "v")) == [("1", "a"), ("2", "None"), ("3", "d"), ("None", "z")]
    assert aggregate.mode(df.limit(0), ["k"], "v").count() == 0


def test_tiles(spark):
    draw = random.Random(1)
    values = [(i, draw.choice([1.0, 2.0, None, 5.5])) for i in range(103)]
    df = spark.createDataFrame(values, "id int, v double").repartition(5)
    ordered = sorted(values, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    want = {r[0]: i * 4 // 103 + 1 for i, r in enumerate(ordered)}
    assert {r.id: r.tile for r in aggregate.tiles(df, ["v", "id"], 4).collect()} == want
    assert aggregate.tiles(df.limit(0), ["v", "id"], 4).count() == 0


def test_trailing_and_conditions(spark):
    days = [(k, date(2024, 1, 1) + timedelta(d), v) for k, d, v in ((1, 0, 1), (1, 0, 2), (1, 2, 4), (1, 3, None), (2, 1, 8))]
    df = spark.createDataFrame(days, "k int, day date, v int")
    got = aggregate.trailing(df, ["k"], "day", {"n": F.count("*"), "v": F.sum("v")}, 3)
    assert rows(got) == [("1", "2024-01-01", "2", "3"), ("1", "2024-01-03", "3", "7"), ("1", "2024-01-04", "2", "4"), ("2", "2024-01-02", "1", "8")]
    told = aggregate.counted_if(df, ["k"], {"many": F.col("v") > 1}, {"few": (F.col("v") < 2, F.col("v"))})
    assert rows(told) == [("1", "2", "1"), ("2", "1", "0")]


def test_lists_by_position(spark):
    df = spark.createDataFrame([(1, [1, 2], ["a"]), (2, [], []), (3, None, ["x"])], "id int, a array<int>, b array<string>")
    assert rows(aggregate.by_position({"a": F.col("a"), "b": F.col("b")}, df, ["id"])) == [("1", "1", "1", "a"), ("1", "2", "2", "None")]


def test_range_joins_of_any_width(spark):
    draw = random.Random(2)
    bands = [(i, low, low + 10 ** draw.uniform(-2, 5)) for i, low in enumerate(draw.uniform(-500, 500) for _ in range(120))] + [(900, 5.0, 5.0), (901, 6.0, 5.0), (902, None, 5.0), (903, 1.0, None)]
    points = [(i, draw.uniform(-600, 600)) for i in range(200)] + [(999, None), (1000, bands[0][1]), (1001, bands[0][2])]
    b, p = spark.createDataFrame(bands, "b int, low double, high double"), spark.createDataFrame(points, "p int, x double")
    want = sorted((str(i), str(j)) for i, x in points for j, low, high in bands if None not in (x, low, high) and low <= x < high)
    assert rows(extend.range_join(p, b, "x", "low", "high", 0.5).select("p", "b")) == want
    assert extend.range_join(p, b.limit(0), "x", "low", "high", 0.5).count() == 0


def test_sessions_count_times_by_the_nearest_second(spark):
    """Gaps of a day, give or take parts of a second, against the registered query's SQL."""
    starts = ["00:00:00.4", "00:00:00.5", "00:00:01.5", "00:00:00.6", "00:00:00"]
    after = ["00:00:00.6", "00:00:00.9", "00:00:01.4", "00:00:01.1", "00:00:00.5"]
    at = [(u, f"2024-01-0{1 + i} {x[u]}") for i, x in enumerate((starts, after, starts)) for u in range(5)]
    df = spark.createDataFrame(at, "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = extend.sessions(df, ["user_id"], "ts", 86400).groupBy("user_id", "session").agg(F.count("*"))
    con = duckdb.connect()
    con.execute("CREATE TABLE events (user_id INT, ts TIMESTAMP)")
    con.executemany("INSERT INTO events VALUES (?, ?)", at)
    assert rows(got) == sorted(tuple(map(str, r)) for r in con.execute(registry.oracle_sql()["ext_sessions"]).fetchall())


def test_a_cell_with_all_rows_is_many_tasks_work(spark):
    """20,000 points and as many intervals in one cell, each point in one interval; all points in one partition."""
    n = 20_000
    p = spark.range(0, n, 1, 1).select("id", ((F.col("id") + 0.5) / n).alias("x"))
    b = spark.range(0, n, 1, 1).select(F.col("id").alias("b"), (F.col("id") / n).alias("low"), ((F.col("id") + 1) / n).alias("high"))
    got = extend.range_join(p, b, "x", "low", "high", 1.0)
    parts = [r["count"] for r in got.where("id = b").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == got.count() == n and len(parts) > 3 and max(parts) < 0.6 * n
