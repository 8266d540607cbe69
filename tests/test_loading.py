"""Load strategies from tokens: what they need, what contradicts, keys that come twice."""

import pytest
from pyspark.sql import functions as F

from weftline.lang.names import Workspace
from weftline.lang.syntax import parse
from weftline.plans.compile import Options
from weftline.plans.loading import load_mapping, strategy


def made(header, target="schema t { k INT v STRING }"):
    return Workspace([parse(f"schema s {{ k INT v STRING }} {target} mapping m {header} {{ source {{ s }} target {{ t }} k -> k v -> v }}")])


def test_what_tokens_say():
    how = strategy(made("(merge upsert, match_on {k, v}, on_match skip, on_no_match error)"), "m")
    assert (how.merge, how.keys, how.on_match, how.on_no_match) == ("upsert", ["k", "v"], "skip", "error")
    how = strategy(made("", "schema t (scd 2, natural_key k, ignore {v}) { k INT v STRING }"), "m")
    assert (how.merge, how.scd, how.keys, how.ignore) == ("upsert", 2, ["k"], ["v"])
    assert strategy(made(""), "m").merge == "full_refresh"
    bad = ["(merge wrong)", "(merge upsert)", "(merge soft_delete, match_on k)", "(merge upsert, match_on k, on_match insert)", "(merge upsert, match_on k, on_no_match drop)"]
    for header in bad:
        with pytest.raises(ValueError):
            strategy(made(header), "m")
    with pytest.raises(ValueError, match="scd 3"):
        strategy(made("", "schema t (scd 3, natural_key k) { k INT }"), "m")


def test_what_loads_need(spark):
    s = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="twice"):
        load_mapping(made("(merge upsert, match_on k)"), "m", {"s": s}).rows.collect()
    with pytest.raises(ValueError, match="nothing is mapped"):
        load_mapping(made("(merge upsert, match_on z)"), "m", {"s": s})
    versions = made("", "schema t (scd 2, natural_key k) { k INT v STRING }")
    with pytest.raises(ValueError, match="time of the load"):
        load_mapping(versions, "m", {"s": s})
    at = lambda day: Options(now=F.lit(day).cast("timestamp_ntz"))
    one = load_mapping(versions, "m", {"s": s.limit(1)}, None, at("2024-01-01")).rows
    assert [(r.k, r.v, r.is_current) for r in one.collect()] == [(1, "a", True)]
    same = load_mapping(versions, "m", {"s": s.limit(1)}, one, at("2024-02-01")).rows
    assert sorted(map(str, same.collect())) == sorted(map(str, one.collect()))
    nulls = spark.createDataFrame([(None, "n")], "k int, v string")
    again = load_mapping(versions, "m", {"s": nulls}, load_mapping(versions, "m", {"s": nulls}, one, at("2024-02-01")).rows, at("2024-03-01")).rows
    assert again.where("k IS NULL").count() == 1
    with pytest.raises(Exception, match="does not match"):
        load_mapping(made("(merge upsert, match_on k, on_no_match error)"), "m", {"s": nulls}, s.limit(1)).rows.collect()
