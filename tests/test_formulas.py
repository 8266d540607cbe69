"""Arithmetic between targets and several lists: what is a formula, stages and cycles, alignment, empty and null lists."""

import pytest
from pyspark.sql import functions as F

from weftline.lang.names import Workspace
from weftline.lang.syntax import parse
from weftline.plans.compile import Options, compile_mapping
from weftline.plans.formula import NotAFormula, formula, stages


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_what_is_a_formula(spark):
    for text in ("@a", "@a plus 1", "@a times (@b minus 2.5)", "-@a / @b", "@s.x multiplied by 2", "@a minus @b."):
        assert formula(text).refs
    for text in ("", "5", "a plus b", "@a plus", "sum of @a", "@a plus @b for each year", "@a @b", "(@a", "@a plus plus @b", "@a % 2"):
        with pytest.raises(NotAFormula):
            formula(text)
    one = spark.range(1).select(F.lit(7).alias("a"), F.lit(2).alias("b"))
    for text, want in (("@a minus @b minus 1", 4), ("@a minus @b times 3", 1), ("@a divided by @b times 2", 7.0), ("(@a plus 1) / (@b - 2)", None), ("-@a + @b", -5)):
        assert one.select(formula(text).column(F.col)).first()[0] == want, text


def test_stages_and_cycles():
    assert stages({"c": {"b", "x"}, "a": {"x"}, "b": {"a"}}) == [["a"], ["b"], ["c"]]
    with pytest.raises(ValueError, match="a -> b -> a|b -> a -> b"):
        stages({"a": {"b"}, "b": {"a"}, "z": set()})


SPEC = """
schema s { k INT a DOUBLE xs list_of record { v INT } ys list_of record { v INT w STRING } }
schema t { k INT p DOUBLE q DOUBLE r DOUBLE }
mapping cycle { source { s } target { t } k -> k -> p { "@q plus 1" } -> q { "@p minus 1" } }
mapping chain { source { s } target { t } k -> k -> r { "@q times 2" | round(1) } -> q { "@p plus @a" } a -> p { * 10 } }
mapping prose { source { s } target { t } k -> k -> p { "@a for each @k" } -> q { "@nothing plus 1" } }
schema z { k INT x INT y INT w STRING }
mapping zip { source { s } target { z } flatten xs -> z { k -> k .v -> x } flatten ys -> z { .v -> y .w -> w { uppercase } } }
"""


def test_targets_in_stages(spark):
    w = Workspace([parse(SPEC)])
    s = spark.createDataFrame([(1, 0.25), (2, None)], "k int, a double")
    with pytest.raises(ValueError, match="need each other"):
        compile_mapping(w, "cycle", {"s": s})
    got = compile_mapping(w, "chain", {"s": s})
    assert got.rows.columns == ["k", "p", "q", "r"] and rows(got.rows) == [("1", "2.5", "2.75", "5.5"), ("2", "None", "None", "None")]
    left = compile_mapping(w, "prose", {"s": s})
    assert len(left.unresolved) == 2 and rows(left.rows) == [("1", "None", "None"), ("2", "None", "None")]


def test_lists_beside_each_other(spark):
    w = Workspace([parse(SPEC)])
    ddl = "k int, xs array<struct<v:int>>, ys array<struct<v:int,w:string>>"
    s = spark.createDataFrame([(1, [(1,), (2,), (3,)], [(7, "a")]), (2, [], [(8, "b"), (9, "c")]), (3, None, None), (4, [None], [])], ddl)
    got = compile_mapping(w, "zip", {"s": s}).rows
    inner = [("1", "1", "7", "A"), ("1", "2", "None", "None"), ("1", "3", "None", "None"), ("2", "None", "8", "B"), ("2", "None", "9", "C"), ("4", "None", "None", "None")]
    assert rows(got) == inner
    assert rows(compile_mapping(w, "zip", {"s": s}, Options(outer=True)).rows) == sorted([*inner, ("3", "None", "None", "None")])
