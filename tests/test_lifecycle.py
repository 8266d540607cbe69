"""Retention along references, cycles included, and rejection in one pass."""

import pytest
from pyspark.sql import functions as F

from weftline.lang.names import Workspace
from weftline.lang.syntax import parse
from weftline.operators import lifecycle


def ids(tables):
    return {n: sorted((r[0] for r in t.collect()), key=str) for n, t in tables.items()}


def test_cycles_and_self_references(spark):
    """Staff reference their head, a team its lead, and staff a team: who goes takes along what depends on them."""
    staff = spark.createDataFrame([(1, None, 1), (2, 1, 1), (3, 2, 2), (4, 3, 2), (5, None, 3), (6, 5, None)], "id int, head int, team int")
    team = spark.createDataFrame([(1, 5), (2, 2), (3, 6), (4, 99)], "id int, lead int")
    w = Workspace([parse("schema staff { id INT (pk) head INT (ref @staff.id) team INT (ref @team.id) } schema team { id INT (pk) lead INT (ref @staff.id) }")])
    keys, refs = lifecycle.references(w, ["staff", "team"])
    assert keys == {"staff": "id", "team": "id"} and len(refs) == 3
    got = lifecycle.retain_whole({"staff": staff, "team": team}, keys, refs, {"staff": F.col("id") == 2})
    assert ids(got) == {"staff": [1, 5, 6], "team": [1, 3, 4]}
    got = lifecycle.retain_whole({"staff": staff, "team": team}, keys, refs, {"staff": F.col("id") == 5})
    assert ids(got) == {"staff": [], "team": [4]}  # 5 takes 6 and team 1, which takes 1, 2, then 3 and team 2, 4
    assert ids(lifecycle.retain_whole({"staff": staff, "team": team}, keys, refs, {})) == {"staff": [1, 2, 3, 4, 5, 6], "team": [1, 2, 3, 4]}
    keys, refs = lifecycle.references(w, ["staff", "team"], {("staff", "head"): "null", ("staff", "team"): "null", ("team", "lead"): "restrict"})
    got = lifecycle.retain_whole({"staff": staff, "team": team}, keys, refs, {"staff": F.col("id").isin(2, 3, 5)})
    assert sorted(map(str, got["staff"].collect())) == sorted(map(str, staff.where("id <> 3").withColumn("head", F.when(F.col("head") != 3, F.col("head"))).collect()))
    assert ids(got)["team"] == [1, 2, 3, 4]  # 2 and 5 stay as leads
    with pytest.raises(ValueError, match="not known"):
        lifecycle.references(w, ["staff", "team"], {("staff", "head"): "forget"})


def test_restrict_holds_what_would_cascade(spark):
    """a <- b by cascade, b <- c by restrict: a c that lives keeps its b, and so the a of that b, though both have expired."""
    a, b = spark.createDataFrame([(1,), (2,), (3,)], "id int"), spark.createDataFrame([(10, 1), (20, 2), (30, None)], "id int, up int")
    c = spark.createDataFrame([(100, 10, True), (200, 20, False)], "id int, up int, live boolean")
    refs = [lifecycle.Reference("b", "up", "a"), lifecycle.Reference("c", "up", "b", "restrict")]
    got = lifecycle.retain_whole({"a": a, "b": b, "c": c}, {t: "id" for t in "abc"}, refs, {"a": F.lit(True), "b": F.lit(None).cast("boolean"), "c": ~F.col("live")})
    assert ids(got) == {"a": [1], "b": [10, 30], "c": [100]}


def test_rows_are_checked_in_one_pass(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(100).select("id", F.when(F.col("id") % 10 != 0, F.col("id")).alias("v")).write.parquet(path)
    df = spark.read.parquet(path)
    rules = {"no v": F.col("v").isNull(), "large": F.col("v") > 94}
    got = lifecycle.checked(df, rules, 0.2)
    assert got.counts == {"rows": 100, "rejected": 15, "no v": 10, "large": 5}
    assert got.good.count() == 85 and got.good.columns == ["id", "v"]
    assert {tuple(r.reasons) for r in got.rejected.collect()} == {("no v",), ("large",)} and got.rejected.count() == 15
    with pytest.raises(lifecycle.TooManyRejected, match="15 of 100"):
        lifecycle.checked(df, rules, 0.1)
    none = lifecycle.checked(df.limit(0), rules, 0.0)
    assert none.counts["rows"] == 0 and none.good.count() == 0 and none.rejected.count() == 0
