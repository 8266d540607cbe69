"""Late rows: corrections by revision, rows that come twice, windows that close, rows past the watermark, nulls."""

import time
from datetime import datetime

from pyspark.sql import functions as F

from weftline.streaming import late


def test_late_rows_correct_what_was_said(spark):
    t = datetime.fromisoformat
    sent = [
        (0, 1, "a", t("2024-01-01 10:00"), 1.0), (0, 2, "a", t("2024-01-01 11:00"), 2.0), (0, 2, "a", t("2024-01-01 11:00"), 2.0), (0, 3, None, t("2024-01-01 12:00"), None), (0, 4, "a", None, 9.0),
        (1, 5, "a", t("2024-01-02 09:00"), 5.0), (1, 1, "a", t("2024-01-01 10:00"), 1.0),
        (2, 6, "a", t("2024-01-01 23:00"), 4.0),
        (3, 7, "a", t("2024-01-09 00:00"), 1.0),
        (5, 8, "a", t("2024-01-01 05:00"), 100.0), (4, 9, "a", t("2024-01-09 01:00"), 1.0),
    ]
    df = spark.createDataFrame(sent, "batch int, id int, k string, at timestamp_ntz, v double")
    stream = late.corrected(late.replayed(df, "batch", 6), ["k"], "at", "v", "id", "1 day", "2 days")
    assert stream.isStreaming
    emitted = late.settled(stream, "test")
    first = emitted.where("k = 'a' AND window_start = TIMESTAMP '2024-01-01 00:00:00'").orderBy("revision").collect()
    # the second batch's repeated row says nothing new; the third corrects; the watermark closes; the last batch's row comes too late,
    # two batches after the watermark has passed it
    assert [(r.n, r.total, r.low, r.high, r.revision, r.closed) for r in first] == [(2, 3.0, 1.0, 2.0, 1, False), (3, 7.0, 1.0, 4.0, 2, False), (3, 7.0, 1.0, 4.0, 3, True)]
    held = {(r.k, str(r.window_start)[:10]): (r.n, r.total, r.closed) for r in late.holding(emitted, ["k"]).collect()}
    assert held == {("a", "2024-01-01"): (3, 7.0, True), ("a", "2024-01-02"): (1, 5.0, True), (None, "2024-01-01"): (1, None, True), ("a", "2024-01-09"): (2, 2.0, False)}
    assert emitted.where(F.col("n") <= 0).count() == 0


def test_many_keys_in_files_of_a_batch(spark, monkeypatch):
    """Thousands of keys of two columns, with nulls and numbers that no double holds, are updated in time; batches of several files, one of them empty."""
    monkeypatch.setattr(late, "FILE_ROWS", 5_000)
    big = F.lit(9007199254740993).cast("long")
    e = spark.range(30_000).select("id", F.when(F.col("id") % 3001 != 0, big + F.col("id") % 3001).alias("k"), (F.col("id") % 2).cast("string").alias("j"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).cast("timestamp_ntz").alias("at"), F.when(F.col("id") % 5 != 0, (F.col("id") % 97).cast("double")).alias("v"))
    sent = e.withColumn("batch", (F.col("id") % 2 * 2).cast("int")).unionByName(e.where("id % 7 = 0").withColumn("batch", F.lit(2)))
    began = time.perf_counter()
    held = late.holding(late.settled(late.corrected(late.replayed(sent, "batch", 3), ["k", "j"], "at", "v", "id", "1 day", "9 days"), "many"), ["k", "j"])
    got = held.select("k", "j", "window_start", "n", "total", "low", "high")
    want = e.groupBy("k", "j", F.window("at", "1 day").start.cast("timestamp").alias("window_start")).agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))
    told, true = (sorted(map(str, df.collect())) for df in (got, want))
    assert told == true and len(told) > 6_000
    assert time.perf_counter() - began < 60
