"""Lookups, bounded payloads, namespaces, modules, call files."""

import json

import pytest

from graphloom.operators import lookups, text
from graphloom.sources import files


def test_first_of_a_name_and_bounded_rows(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("c", 4)], "name string, ord int")
    found = lookups.first_named(rows, spark.createDataFrame([("a",), ("a",), ("zz",)], "x string"))
    assert [tuple(r) for r in found.collect()] == [("a", 1)]
    few, total = lookups.bounded(rows, most=3, shown=2)
    assert (few.count(), total) == (2, 4) and [r["ord"] for r in few.collect()] == [1, 2]
    assert lookups.bounded(rows, most=4)[0].count() == 4


def test_namespaces_of_deep_and_odd_scopes(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None, "namespace", f"x{i}" if i % 5 else "") for i in range(40)] + [("c", "n39", "class", "C"), ("m", "c", "method", "f"), ("lost", "gone", "class", "L"), ("r", "s", "namespace", "r"), ("s", "r", "namespace", "s")]
    got = {r["id"]: r["namespace"] for r in lookups.qualified(spark.createDataFrame(rows, "id string, parent string, kind string, name string")).collect()}
    chain = "::".join(f"x{i}" for i in range(40) if i % 5)
    assert got["c"] == got["m"] == chain and got["n3"] == "x1::x2" and got["n0"] == got["lost"] == got["r"] == ""


def test_highlights_reach_both_ways(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "a"), ("c", "a")], "src string, dst string")
    got = {tuple(r) for r in lookups.highlighted(spark.createDataFrame([("a",)], "name string"), edges).collect()}
    assert got == {("b", 1, "upstream"), ("c", 2, "upstream"), ("x", 1, "downstream"), ("c", 1, "downstream"), ("b", 2, "downstream")}


def test_index_stats(spark):
    index = text.build_index(spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "")], "doc int, text string"))
    r = lookups.index_stats(index).first()
    assert (r["docs"], r["terms"], r["postings"]) == (2, 3, 4)


def test_calls_come_from_a_graph_or_from_backtraces(spark, tmp_path):
    (tmp_path / "calls.json").write_text(json.dumps([{"caller": "A::f", "callee": "B::g", "args": "x", "return": "int"}, {"caller": "B::g", "callee": "C::h"}]))
    got = files.read_calls(spark, call_graph=str(tmp_path / "calls.json")).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [("calls", 0, "A::f", "B::g", "x", "int"), ("calls", 1, "B::g", "C::h", "", "")]
    (tmp_path / "bt").mkdir()
    (tmp_path / "bt" / "one.txt").write_text("#0  A::f (this=0x1, n=2) at a.cpp:1\n#1  B::g () at b.cpp:2\n")
    (tmp_path / "bt" / "two.txt").write_text("#0  0x12 in C::h (x=1)\n#1  main ()\n")
    got = files.read_calls(spark, backtraces=str(tmp_path / "bt")).orderBy("group").collect()
    assert [(r["group"], r["caller"], r["callee"], r["args"], r["returns"]) for r in got] == [("one.txt", "B::g", "A::f", "n=2", ""), ("two.txt", "global::main", "C::h", "x=1", "")]
    for kw in ({}, {"call_graph": "a", "backtraces": "b"}):
        with pytest.raises(ValueError, match="either"):
            files.read_calls(spark, **kw)
