import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftline.lang.names import Workspace
from weftline.lang.syntax import parse
from weftline.plans.compile import Options, compile_mapping, compile_metric
from weftline.plans.predicate import NotAPredicate, predicate


def run(spark, steps, rows, kind="string", options=None, target="STRING"):
    w = Workspace([parse(f"schema o {{ y {target} }} mapping m {{ source {{ s }} target {{ o }} x -> y {{ {steps} }} }}")])
    return compile_mapping(w, "m", {"s": spark.createDataFrame([(r,) for r in rows], f"x {kind}")}, options)


def values(compiled):
    return [r[0] for r in compiled.rows.collect()]


@pytest.mark.parametrize(
    ("steps", "given", "wanted"),
    [
        ("trim | uppercase", " ab ", "AB"), ("title_case", "ann lee", "Ann Lee"), ('prepend("<") | append(">")', "x", "<x>"), ('split(",") | first', "a,b", "a"), ('split(",") | last', "a,b", "b"),
        ("truncate(2)", "abc", "ab"), ('pad_left(4, "0")', "7", "0007"), ('replace("a", "b")', "aa", "bb"), ("escape_html", "<a&b>", "&lt;a&amp;b&gt;"), ("null_if_empty", "", None), ("coalesce(none)", None, "none"),
        ("validate_email | null_if_invalid", "no", None), ("validate_email | null_if_invalid", "a@b.io", "a@b.io"), ("to_number | round(1)", "1.26", "1.3"), ("to_number | null_if_invalid | coalesce(0)", "x", "0.000000000000000000"),
        ('uuid_v5("6ba7b810-9dad-11d1-80b4-00c04fd430c8")', "python.org", "886313e1-3b8a-5372-9b90-0c9aee199e5d"), ("md5", "a", "0cc175b9c0f1b6a831c399e269772661"), ('parse("MM/DD/YYYY") | to_iso8601', "02/03/2024", "2024-02-03T00:00:00Z"),
        ('map { a: "1", null: "2", _: "3" }', None, "2"), ('map { a: "1" }', "b", None), ('to_number | map { < 5: "few" >= 5: "many" }', "7", "many"),
    ],
)
def test_steps(spark, steps, given, wanted):
    assert values(run(spark, steps, [given])) == [wanted]


def test_row_steps(spark):
    assert values(run(spark, "validate_email | drop_if_invalid", ["a@b.io", "bad", None])) == ["a@b.io", None]
    assert values(run(spark, "drop_if_null", ["a", None])) == ["a"]
    warned = run(spark, "warn_if_null", ["a", None])
    assert values(warned) == ["a", None] and [r["warnings"] for r in warned.warnings.collect()] == [["y: warn_if_null"]]
    with pytest.raises(Exception, match="error_if_null"):
        values(run(spark, "error_if_null", [None]))


def test_prose_is_reported_and_runs_when_bound(spark):
    free = run(spark, '"make it nice"', ["a"])
    assert values(free) == [None] and free.unresolved == ['"make it nice"']
    bound = run(spark, '"make it nice" | uppercase', ["a"], options=Options(bindings={"make it nice": lambda c: F.concat(c, F.lit("!"))}))
    assert values(bound) == ["A!"] and not bound.unresolved


def test_named_transforms_and_their_cycles(spark):
    w = Workspace([parse("transform t { trim | ...u } transform u { lowercase | ...t } schema o { y STRING } mapping m { source { s } target { o } x -> y { ...t } }")])
    got = compile_mapping(w, "m", {"s": spark.createDataFrame([("A",)], "x string")})
    assert got.unresolved == ["...t"]


def test_flatten_drops_empty_lists_unless_asked(spark):
    w = Workspace([parse("schema o { k INT v INT } mapping m { source { s } target { o } flatten xs -> o { k -> k .v -> v } }")])
    s = spark.createDataFrame([(1, [(5,), (6,)]), (2, []), (3, None)], "k int, xs array<struct<v:int>>")
    assert sorted(tuple(r) for r in compile_mapping(w, "m", {"s": s}).rows.collect()) == [(1, 5), (1, 6)]
    assert compile_mapping(w, "m", {"s": s}, Options(outer=True)).rows.count() == 4


def test_predicates():
    for bad in ("a = ", "drop table x; --", "f(x) = 1", "a IN 3"):
        with pytest.raises(NotAPredicate):
            predicate(bad)


def test_filter_text_cannot_reach_sql(spark):
    df = spark.createDataFrame([("x' OR '1'='1",), ("y",)], "a string")
    assert df.where(predicate("a = \"x' OR '1'='1\"")).count() == 1


def test_non_additive_measures_need_components(spark):
    w = Workspace([parse("schema m (metric) { v DOUBLE (measure non_additive) }")])
    with pytest.raises(ValueError, match="not additive"):
        compile_metric(w, "m", spark.createDataFrame([(1.0,)], "v double"))


def test_dates(spark):
    got = run(spark, "now_utc", ["a"], options=Options(now=F.lit(dt.datetime(2024, 1, 1))), target="TIMESTAMP")
    assert values(got) == [dt.datetime(2024, 1, 1)]


def test_grouped_rows_are_dropped_and_warned_of(spark):
    w = Workspace([parse("schema o { k STRING hi INT lo INT } mapping m (group_by k) { source { s } target { o } k -> k x -> hi { warn_if_null | max } x -> lo { drop_if_null | min } }")])
    got = compile_mapping(w, "m", {"s": spark.createDataFrame([("a", 1), ("a", None), ("b", None), ("c", 3)], "k string, x int")})
    assert sorted(tuple(r) for r in got.rows.collect()) == [("a", 1, 1), ("c", 3, 3)]
    assert sorted((r.k, r["warnings"]) for r in got.warnings.collect()) == [("a", ["hi: warn_if_null"]), ("b", ["hi: warn_if_null"])]
    late = Workspace([parse("schema o { k STRING hi INT } mapping m (group_by k) { source { s } target { o } k -> k x -> hi { max | drop_if_null } }")])
    got = compile_mapping(late, "m", {"s": spark.createDataFrame([("a", 1), ("a", None), ("b", None)], "k string, x int")})
    assert [tuple(r) for r in got.rows.collect()] == [("a", 1)]


def test_targets_below_two_levels_are_structs(spark):
    w = Workspace([parse("schema o { r record { u record { v INT w STRING } x INT } } mapping m { source { s } target { o } i -> r.u.v i -> r.x i -> r.u.w }")])
    got = compile_mapping(w, "m", {"s": spark.createDataFrame([("7",)], "i string")}).rows
    assert got.schema.simpleString() == "struct<r:struct<u:struct<v:int,w:string>,x:int>>" and got.first().r.u.v == 7
