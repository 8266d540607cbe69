import pytest
from pyspark.sql import functions as F

from weftline.operators import graph, load, quality
from weftline.streaming.loads import deduplicated, upsert_stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_is_idempotent_and_refuses_repeated_keys(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = load.upsert(t, s, ["k"])
    assert rows(once) == [(1, "a"), (2, "c"), (3, "d")] == rows(load.upsert(once, s, ["k"]))
    assert rows(load.upsert(t, s, ["k"], on_match="skip")) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(load.upsert(t, s, ["k"], on_no_match="skip")) == [(1, "a"), (2, "c")]
    with pytest.raises(Exception, match="twice"):
        load.upsert(t, s.union(s), ["k"]).collect()
    with pytest.raises(Exception, match="matches"):
        load.upsert(t, s, ["k"], on_match="error").collect()


def test_scd2_merge_keeps_one_current_version(spark):
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    history = load.scd2_history(first.withColumn("at", F.lit("2024-01-01").cast("timestamp_ntz")), ["k"], "at", ["v"])
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    merged = load.scd2_merge(history, new, ["k"], ["v"], F.lit("2024-02-01").cast("timestamp_ntz"))
    assert rows(merged.select("k", "v", "is_current")) == [(1, "a", True), (2, "b", False), (2, "c", True), (3, "d", True)]
    assert merged.where("is_current").groupBy("k").count().where("count > 1").count() == 0
    assert merged.where("valid_to <= valid_from").count() == 0


def test_masks_and_threshold(spark):
    df = spark.createDataFrame([("ann@x.io", "4111222233334444"), (None, None)], "e string, c string")
    got = df.select(quality.mask(F.col("e"), "partial_email"), quality.mask(F.col("c"), "last_four"), quality.mask(F.col("e"), "redact")).collect()
    assert tuple(got[0]) == ("a***@x.io", "****4444", "REDACTED") and tuple(got[1]) == (None, None, None)
    good, bad = quality.with_threshold(df, F.col("e").isNull(), 0.6)
    assert good.count() == 1 and bad.count() == 1
    with pytest.raises(Exception, match="rejected"):
        quality.with_threshold(df, F.col("e").isNull(), 0.1)[0].collect()


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", "2024-01-01"), (1, "b", "2024-01-02"), (2, "c", "2024-01-01")], "k int, v string, d string").withColumn("t", F.col("d").cast("timestamp")).drop("d").write.parquet(src)
    stream = spark.readStream.schema("k int, v string, t timestamp").parquet(src)
    out = {}
    empty = spark.createDataFrame([], "k int, v string, t timestamp")
    query = upsert_stream(stream, ["k"], "t", lambda: empty, lambda df, n: out.update({n: rows(df.select("k", "v"))}), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert out[0] == [(1, "b"), (2, "c")]
    assert deduplicated(stream, ["k"], "t", "1 day").isStreaming


def test_hashes_tell_values_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a\\", "|b|c"), (None, "c"), ("\\N", "c"), ("", "c"), ("a||b", "c"), ("a", "|b||c")]
    df = spark.createDataFrame(rows, "x string, y string")
    for of in (load.row_hash, load.hash_key):
        assert df.select(of(["x", "y"]).alias("h")).distinct().count() == len(rows)


def test_everything_reached_from_several_starts(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "c")], "src string, dst string")
    starts = spark.createDataFrame([("1", "a"), ("2", "x"), ("3", "c")], "start string, node string")
    got = sorted(tuple(r) for r in graph.reach_from(edges, starts).collect())
    assert got == [("1", "b", 1), ("1", "c", 2), ("2", "a", 2), ("2", "b", 3), ("2", "c", 1), ("3", "a", 1), ("3", "b", 2)]


def test_columns_by_convention(spark):
    from weftline.catalog.tables import Catalog
    from weftline.lang.names import Workspace
    from weftline.lang.syntax import parse
    from weftline.operators import validate

    text = """
    schema src { a STRING }
    schema sat (satellite, parent customer) { a STRING }
    schema lnk (link, link_hubs {customer, product}) { a STRING }
    schema hist (dimension, scd 2) { a STRING }
    schema plain (dimension, scd 1) { a STRING }
    mapping m1 { source { src } target { sat } a -> customer_hk a -> hash_diff a -> other_hk }
    mapping m2 { source { src } target { lnk } a -> product_hk a -> lnk_hk a -> load_end_date }
    mapping m3 { source { src } target { hist } a -> row_hash }
    mapping m4 { source { src } target { plain } a -> row_hash }
    """
    got = validate.fields_not_in_schema(Catalog(spark, Workspace([parse(text, "t.spec")])))
    assert sorted((r.subject, r.message) for r in got.collect()) == [("m1", "sat.other_hk"), ("m2", "lnk.load_end_date"), ("m4", "plain.row_hash")]
