"""Calls by class and method against recursive brute force on a small index."""

import re

import pytest

from graphloom.operators import methods

CLASSES = [("a::X", "a/x.h", 1), ("b::X", "b/x.h", 2), ("Y", "y.h", 3), ("c::Y", "c/y.h", 4), ("d::Z", "d/z.h", 5), ("Lone", "l.h", 6)]
METHODS = [
    ("a::X", "void go(int)", 0, True, ["Y", "d::Z"]), ("a::X", "int get()", 1, True, []), ("a::X", "void go(long)", 2, False, ["Z", "Z"]),
    ("b::X", "void forget(int)", 0, True, []), ("b::X", "int get()", 1, False, []),
    ("Y", "void run()", 0, True, ["X"]), ("c::Y", "void run()", 0, True, []), ("d::Z", "operator", 0, True, None), ("d::Z", "~Z()", 1, True, []), ("Lone", "void go()", 0, True, []),
]
STEPS = [
    ("a::X", "void go(int)", 1, "Y", "run", "call", None, 10), ("a::X", "void go(int)", 2, "_self_", "get", "call", None, 11), ("a::X", "void go(int)", 3, "Z", "size", "field", True, 12),
    ("a::X", "void go(int)", 4, "_meta_", "truncated", "call", None, None), ("a::X", "void go(long)", 1, "Lone", "go", "call", None, 13), ("a::X", "int get()", 1, "_self_", "n", "field", None, 14),
    ("b::X", "void forget(int)", 1, "a::X", "go", "call", None, 15), ("b::X", "int get()", 1, "c::Y", "run", "call", None, 16),
    ("Y", "void run()", 1, "X", "go", "call", None, 17), ("Y", "void run()", 2, "b::X", "get", "call", None, 18), ("Y", "void run()", 3, "nowhere", "f", "call", None, 19),
    ("c::Y", "void run()", 1, "d::Z", "operator", "call", None, 20), ("c::Y", "void run()", 2, "Y", "run", "call", None, 21), ("d::Z", "operator", 1, "Z", "~Z", "call", None, 22), ("d::Z", "~Z()", 1, "d::Z", "size", "field", False, 23),
]
ROOTS = [("a::X", "go"), ("X", "get"), ("Y", "run"), ("b::X", "forget"), ("c::Y", "run"), ("none", "f"), ("a::X", "void go(long)")]


@pytest.fixture(scope="module")
def index(spark):
    classes = spark.createDataFrame(CLASSES, "class string, file string, ord long")
    held = spark.createDataFrame(METHODS, "class string, signature string, place int, is_public boolean, used_types array<string>")
    steps = spark.createDataFrame(STEPS, "class string, signature string, step int, target string, member string, kind string, is_write boolean, line int")
    return classes, held, steps


def name_of(signature):
    found = re.search(r"\b([a-zA-Z_~]\w*)\s*\(", signature)
    return found[1] if found else signature


def last(name):
    return name.split("::")[-1]


def class_of(name):
    exact = [c for c in CLASSES if c[0] == name]
    return (exact or [c for c in CLASSES if last(c[0]) == name] or [None])[0]


def steps_of(name, method):
    owner = class_of(name)
    held = [m for m in METHODS if owner and m[0] == owner[0] and method in (name_of(m[1]), m[1])]
    return sorted([s for s in STEPS if s[:2] == held[0][:2]], key=lambda s: s[2]) if held else []


def tree(root, max_depth):
    out = []

    def grow(name, method, step, path, seen, depth):
        owner = class_of(name)
        out.append((*root, path, depth, name, method, step[5] if step else "call", step[6] if step else None, step[7] if step else None, owner[1] if owner else None))
        if (name, method) in seen or depth >= max_depth or (step and step[5] == "field"):
            return
        for s in steps_of(name, method):
            if s[3] != "_meta_":
                grow(name if s[3] == "_self_" else s[3], s[4], s, (*path, s[2]), seen | {(name, method)}, depth + 1)

    grow(*root, None, (), frozenset(), 0)
    return out


def refs(key, field):
    out = []
    for c in CLASSES:
        for m in METHODS:
            for s in sorted(STEPS, key=lambda s: s[2]):
                if m[0] == c[0] and s[:2] == m[:2] and s[3] != "_meta_" and (s[5] == "field") == field and f"{last(c[0]) if s[3] == '_self_' else s[3]}::{s[4]}" == key:
                    out.append((c, m, s))
    return out


def found_refs(name, member, field):
    return refs(f"{name}::{member}", field) or refs(f"{last(name)}::{member}", field)


def caller_rows(root, max_depth):
    out = []

    def grow(name, method, path, seen, depth):
        if depth < max_depth:
            for i, (c, m, s) in enumerate(found_refs(name, method, False), 1):
                out.append((*root, (*path, i), depth, c[0], m[1], s[7], c[1]))
                visit = (c[0], name_of(m[1]))
                if visit not in seen:
                    grow(*visit, (*path, i), seen | {visit}, depth + 1)

    grow(*root, (), frozenset(), 0)
    return out


def rows(df):
    return sorted([tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("depth", [0, 1, 3, 10])
def test_call_tree_is_the_recursion(spark, index, depth):
    starts = spark.createDataFrame(ROOTS, "root_class string, root_method string")
    assert rows(methods.call_tree(starts, *index, depth)) == sorted([r for x in ROOTS for r in tree(x, depth)], key=repr)


@pytest.mark.parametrize("depth", [1, 6])
def test_caller_tree_is_the_recursion(spark, index, depth):
    asked = [*ROOTS, ("q::Y", "run"), ("d::Z", "~Z")]
    starts = spark.createDataFrame(asked, "root_class string, root_method string")
    assert rows(methods.caller_tree(starts, *index, depth)) == sorted([r for x in asked for r in caller_rows(x, depth)], key=repr)


def test_accessors_use_the_last_part_only_where_the_name_has_none(spark, index):
    asked = [("d::Z", "size"), ("e::Z", "size"), ("a::X", "n"), ("Y", "size")]
    found = methods.field_accessors(spark.createDataFrame(asked, "class string, field string"), *index)
    want = [(*a, c[0], m[1], bool(s[6]), s[7], c[1], i) for a in asked for i, (c, m, s) in enumerate(found_refs(*a, True), 1)]
    assert rows(found) == sorted(want, key=repr) and {r[0] for r in want} == {"d::Z", "e::Z", "a::X"}


def test_type_usage_tells_classes_and_methods(spark, index):
    classes, held, _ = index
    deps = spark.createDataFrame([("a::X", "Z", "composition"), ("a::X", "Z", "association"), ("Y", "Z", "association"), ("Y", "d::Z", "dependency"), ("q::Z", "d::Z", "inheritance"), ("Lone", "d::Z", "inheritance"), ("d::Z", "Z", "dependency"), ("Y", "Z", "unheard")], "class string, target string, dep_type string")
    found = methods.type_usage(spark.createDataFrame([("d::Z",)], "type string"), deps, held, classes)
    assert rows(found.select("use", "class", "dep_type", "signature")) == sorted([("field", "a::X", "composition", None), ("param", "a::X", "association", None), ("param", "Y", "association", None), ("local", "Y", "dependency", None), ("inherit", "Lone", "inheritance", None), ("param", "a::X", "association", "void go(int)"), ("param", "a::X", "association", "void go(long)")], key=repr)


def test_focal_chain_goes_by_the_whole_signature(spark, index):
    _, held, steps = index
    asked = spark.createDataFrame([("a::X", "void go(long)"), ("a::X", "go"), ("Lone", "void go()")], "class string, signature string")
    assert [r["target"] for r in methods.focal_chain(asked, held, steps).collect()] == ["Lone"]


def flow_of(start, max_depth=10):
    out, seen = [], set()

    def enter(name, method, depth):
        if depth > max_depth or (name, method) in seen:
            return
        seen.add((name, method))
        if name not in {c[0] for c in CLASSES}:
            return
        out.append((name, method, "call"))
        held = [m for m in METHODS if m[0] == name and method + "(" in m[1]]
        for s in sorted([s for s in STEPS if held and s[:2] == held[0][:2]], key=lambda s: s[2]):
            if s[3] == "_self_":
                out.append((name, s[4], "write" if s[6] else "call" if s[5] == "call" else "read"))
            elif s[5] == "call":
                enter(s[3], s[4], depth + 1)
            else:
                out.append((s[3], s[4], "write" if s[6] else "read"))

    enter(*start, 0)
    return out if len(out) > 1 else []


@pytest.mark.parametrize("depth", [0, 1, 10])
def test_flows_are_the_walk_from_each_start(spark, index, depth):
    starts = [("a::X", "go"), ("b::X", "get"), ("Y", "run"), ("c::Y", "run"), ("Lone", "go"), ("none", "f"), ("X", "go")]
    members = spark.createDataFrame([("a::X", "a"), ("Y", "y")], "class string, module string")
    found = methods.flows(spark.createDataFrame(starts, "start_class string, start_method string"), *index, members, depth)
    want = [(*s, i, c, m, {"a::X": "a", "Y": "y"}.get(c, "_ungrouped"), action) for s in starts for i, (c, m, action) in enumerate(flow_of(s, depth))]
    assert rows(found) == sorted(want, key=repr) and want


def test_flow_queries_and_key_flows(spark, index):
    classes, held, steps = index
    members = classes.selectExpr("class", "substr(class, 1, 1) AS module")
    matches = spark.createDataFrame([("q", c[0], c[2]) for c in CLASSES], "query string, class string, rank long")
    found = methods.flow_query(matches, classes, held, steps, members).orderBy("place").collect()
    starts = [(c[0], re.search(r"\b([a-zA-Z_]\w*)\s*\(", m[1])) for c in CLASSES for m in METHODS if m[0] == c[0] and m[3]]
    flows = [(s, flow_of((s, m[1]))) for s, m in starts if m]
    flows = [(f"{s}::{f[0][1]} → {f[-1][0]}::{f[-1][1]}", len(f)) for s, f in flows if f][:5]
    assert [(r["name"], r["n_steps"]) for r in found] == sorted(flows, key=lambda f: -f[1])
    entries = spark.createDataFrame([("Y", "root", 1), ("a::X", "hub", 2), ("Lone", "main", 1)], "class string, kind string, ord long")
    best = methods.key_flows(entries, classes, held, steps, members).orderBy("place").collect()
    assert best and best[0]["n_modules"] == max(r["n_modules"] for r in best) and all(r["n_steps"] >= 3 for r in best)


def test_nothing_asked_gives_nothing(spark, index):
    none = spark.createDataFrame([], "root_class string, root_method string")
    assert methods.call_tree(none, *index).isEmpty() and methods.caller_tree(none, *index).isEmpty()
    assert methods.flows(none.toDF("start_class", "start_method"), *index, spark.createDataFrame([], "class string, module string")).isEmpty()
