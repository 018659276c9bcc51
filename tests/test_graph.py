"""Golden cases for the graph operators."""

import random

from pyspark.sql import functions as F

from graphloom import queries
from graphloom.functions import extraction, naming
from graphloom.operators import diff, filters, flows, graph, grouping, render, text, trace
from graphloom.sources import files, incremental


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "composition", i) for i, (a, b) in enumerate(pairs)], "src string, dst string, type string, pos long")


def test_reverse_deps_drops_self_and_empty(spark):
    rows = graph.reverse_deps(edges(spark, [("a", "b"), ("c", "b"), ("a", "b"), ("b", "b"), ("a", "")])).collect()
    assert [(r.name, r.dependents) for r in rows] == [("b", ["a", "c"])]


def test_reach_matches_plain_search(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(60)]
    found = {r.name: r.hop for r in graph.reach(spark.createDataFrame([("n0",)], "name string"), edges(spark, pairs)).collect()}
    want, front, hop = {"n0": 0}, {"n0"}, 0
    while front:
        hop += 1
        front = {b for a, b in pairs if a in front} - want.keys()
        want |= dict.fromkeys(front, hop)
    assert found == want


def test_impact_stops_at_hops(spark):
    e = edges(spark, [("b", "a"), ("c", "b"), ("d", "c"), ("e", "d")])
    seeds = spark.createDataFrame([("a",)], "name string")
    assert {r.name: r.kind for r in graph.impact(seeds, e).collect()} == {"b": "direct", "c": "indirect", "d": "indirect"}
    assert graph.impact(seeds, e, None).count() == 4


def test_call_paths_repeat_is_a_leaf(spark):
    rows = graph.call_paths(spark.createDataFrame([("a",)], "root string"), edges(spark, [("a", "b"), ("b", "a")])).collect()
    assert {(">".join(r.path), r.repeat) for r in rows} == {("a", False), ("a>b", False), ("a>b>a", True)}


def test_modules_and_risk(spark):
    n = spark.createDataFrame([("DiskManager", "core", "src/a", "x", 1), ("NVMeDriver", "io::hw", "src/b", "y", 2), ("string", "std", "s", "", 3), ("Logger", "", "util/l", "", 4), ("Main", "", "m", "", 5)], "name string, namespace string, file string, responsibility string, ord long")
    m = grouping.with_module(n)
    assert {r.name: r.module for r in m.collect()} == {"DiskManager": "core", "NVMeDriver": "io", "Logger": "util", "Main": "_ungrouped"}
    e = edges(spark, [("DiskManager", "NVMeDriver"), ("Logger", "DiskManager")])
    assert {(r.source, r.target, r.weight) for r in grouping.module_edges(m, e).collect()} == {("core", "io", 1), ("util", "core", 1)}
    risks = spark.createDataFrame([(k,) for k in (5, 3, 1, 0)], "k int").select(naming.change_risk(F.col("k")).alias("r")).collect()
    assert [r.r for r in risks] == ["high", "medium", "low", "low"]


def test_names(spark):
    df = spark.createDataFrame([("EventObserver",), ("DiskManager",), ("NVMeDriver",)], "n string")
    rows = df.select(naming.design_pattern(F.col("n")).alias("p"), naming.intent(F.col("n"), F.lit("")).alias("i"), naming.expand_camel(F.col("n")).alias("e")).collect()
    assert [r.p for r in rows] == ["Observer", None, None]
    assert rows[1].i == "Manages disk"
    assert rows[2].e == "nv medriver"


def test_field_types(spark):
    df = spark.createDataFrame([("std::unique_ptr<Disk>",), ("std::vector<Disk *>",), ("int",), ("Disk",), ("Disk &",)], "t string")
    got = [tuple(r.d) if r.d else None for r in df.select(extraction.field_dependency(F.col("t")).alias("d")).collect()]
    assert got == [("Disk", "composition", None), ("Disk", "aggregation", "1..*"), None, ("Disk", "composition", None), ("Disk", "aggregation", None)]


def test_diff_of_equal_snapshots_is_empty(spark):
    snap = spark.createDataFrame([("a", ["f"], "low", "h")], "name string, interfaces array<string>, risk string, hash string")
    assert diff.diff_classes(snap, snap).isEmpty()


def test_backtrace(spark):
    t = "#0  Disk::read (this=0x1, lba=0) at d.cpp:5\n#1  0x7f in Fs::open (path=x) at f.cpp:9\n#2  main () at m.cpp:1"
    rows = trace.call_edges(trace.frames(spark.createDataFrame([("t", t)], "trace string, text string"))).orderBy("pos").collect()
    assert [(r.caller, r.callee, r.args) for r in rows] == [("global::main", "Fs::open", "path=x"), ("Fs::open", "Disk::read", "lba=0")]


def test_state_machine(spark):
    src = "enum class S { A, B };\nswitch (s) { case S::A: s = S::B; break; case S::B: break; }"
    rows = trace.state_machines(spark.createDataFrame([("f", src)], "file string, text string")).collect()
    assert [(r.enum, r.states, r.source, r.target) for r in rows] == [("S", "A,B", "A", "B")]


def test_state_machines_of_several_blocks(spark):
    enums = "enum E { One = 1, Two, bad value, }; enum class F { Three };"
    quiet = "switch (x) { case Two: return; default: break; }"
    nested = "switch(m.mode) {case 1:} switch (f) { case F::Three : { if (f == Four) { f=F::Four; } this->f = Three; } case Five: f = g(); ff = Six; f = ns::Seven ; }"
    unknown = "switch (k) { case Ten: k = Ten; k = Eleven; }"
    df = spark.createDataFrame([("a", enums + quiet + nested), ("b", unknown + " switch (open) { case X: "), ("c", None), ("d", "switch (e) { }")], "file string, text string")
    machines = trace.state_machines(df)
    rows = [(r.key, r.enum, r.states, r.source, r.target) for r in machines.collect()]
    assert sorted(rows, key=str) == sorted([("a", "E", "One,Two", None, None), ("a", "F", "Three", "Three", "Four"), ("a", "F", "Three", "Five", "Seven"), ("b", "k", "Ten", "Ten", "Eleven")], key=str)
    shown = {r.enum: r.value for r in render.state_diagram(machines).collect()}
    assert shown["E"].endswith("[*] --> One") and "Ten --> Eleven" in shown["k"]


def test_class_changes(spark):
    def snap(rows):
        df = spark.createDataFrame(rows, "name string, interfaces array<string>, attributes array<string>, deps array<struct<target:string,type:string>>, risk string, file string")
        return df.withColumn("hash", diff.structural_hash(F.col("deps"), F.col("interfaces"), F.col("attributes")))

    base = (["i"], ["a"], [("T", "x")], "low", "f")
    old = snap([(n, *base) for n in ("same", "attribute", "dependency", "moved", "both", "gone")] + [("none", None, ["a"], None, "", None)])
    new = snap([
        ("same", *base), ("attribute", ["i"], ["b"], *base[2:]), ("dependency", ["i"], ["a"], [("T", "y"), ("T", "z"), ("U", "x")], "low", "f"),
        ("moved", *base[:3], "high", "g"), ("both", ["i"], ["b"], [("T", "x")], "high", "g"), ("new", *base), ("none", ["a"], None, None, "high", None),
    ])
    rows = {r.name: r for r in diff.diff_classes(old, new).collect()}
    assert set(rows) == {"dependency", "both", "gone", "new", "none"}
    assert [tuple(x) for x in rows["dependency"].dep_changes] == [("T", "retyped", "x", "z"), ("U", "added", None, "x")]
    assert (rows["both"].risk_change, rows["both"].file_change) == ("low->high", "f->g")
    assert (rows["none"].interfaces_added, rows["none"].risk_change, rows["none"].file_change) == (["a"], None, None)
    assert {n: r.change for n, r in rows.items() if r.change != "modified"} == {"gone": "removed", "new": "added"}


def test_entry_text(spark):
    df = spark.createDataFrame([("DiskManager", "core::io", ["void readBlock(int n)"], [("void go(DiskPath p)", ["fs::DiskPath"])]), (None, None, None, None)], "name string, namespace string, interfaces array<string>, methods array<struct<signature:string,used_types:array<string>>>")
    first, empty = (r.t for r in df.select(text.entry_text(df).alias("t")).collect())
    assert first.startswith("DiskManager " * 5 + "Disk Manager " + text.ALIASES["DiskManager"]) and " 磁 " in first
    assert first.endswith("core io void readBlock int n  read block void go DiskPath p  DiskPath disk path") and empty == ""
    names = ["MyDiskManager", "XManager", "Poolside", "Cache"]
    said = spark.createDataFrame([(n,) for n in names], "n string").select(text.aliases(F.col("n")).alias("a")).collect()
    assert [r.a for r in said] == [text.ALIASES["DiskManager"], text.ALIASES["Manager"], None, text.ALIASES["Cache"]]


def test_search_and_limits(spark):
    docs = spark.createDataFrame([(1, "disk manager reads blocks"), (2, "event handler"), (3, "提交 queue")], "doc long, text string")
    index = text.build_index(docs)
    q = spark.createDataFrame([(7, "read disk manager"), (8, "提交")], "query long, text string")
    top = {r.query: r.doc for r in text.search(index, q, 1).collect()}
    assert top == {7: 1, 8: 3}
    for bad in ("", " ", "x" * 1001):
        try:
            text.checked_query(bad)
            raise AssertionError
        except ValueError:
            pass


def test_excludes(spark):
    df = spark.createDataFrame([("src/a.cpp",), ("build/x/a.cpp",), ("src/gen/a.cpp",), ("src/a_test.cpp",)], "p string")
    assert [r.p for r in df.filter(~filters.excluded(F.col("p"), ["build/", "gen", "*_test.cpp"])).collect()] == ["src/a.cpp"]


def test_incremental(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, hash string")
    assert {r.path: r.status for r in incremental.classify(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "changed"}


def test_index_versions(spark, tmp_path):
    for name, body in (("v1", '[{"className": "A"}]'), ("v4", '{"version": 4, "classes": [{"className": "A", "dependencies": [{"target": "B", "type": "composition"}]}]}')):
        (tmp_path / name).write_text(body)
        rows = files.read_index(spark, str(tmp_path / name)).collect()
        assert [r.className for r in rows] == ["A"]
    files.write_index(files.read_index(spark, str(tmp_path / "v4")), str(tmp_path / "out"))
    assert files.read_index(spark, str(tmp_path / "out")).first().dependencies[0].target == "B"


def test_discover_and_parse(spark, tmp_path):
    for p in ("src/a.cpp", "src/b.TXT", "build/c.cpp", "src/D.HPP"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(p)
    found = files.discover(spark, str(tmp_path))
    assert {r.path for r in found.collect()} == {"src/a.cpp", "src/D.HPP"}
    rows = files.parse(found, lambda path, content: [{"className": path}]).collect()
    assert {r.entry.className for r in rows} == {"src/a.cpp", "src/D.HPP"}


def test_flow_order(spark):
    calls = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "d", 1)], "src string, dst string, pos int")
    assert flows.flow("a", calls) == ["a", "b", "d", "c"]


def user_tables(spark, path, each=12):
    """Small events, customer, nation and region tables: three users with ``each`` events, user 50 never called."""
    kinds = ["view", "error", "purchase", "click"]
    users = [1, 2, 50]
    events = [(i, f"2024-01-01 00:00:{i:02d}", users[i % 3], kinds[i * 5 % 4]) for i in range(3 * each)]
    spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string").write.parquet(f"{path}/events.parquet")
    spark.createDataFrame([(i, i % 4) for i in range(60)], "c_custkey long, c_nationkey long").withColumn("c_mktsegment", F.lit("A")).write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame([(i, f"N{i}", i % 2) for i in range(4)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{path}/nation.parquet")
    spark.createDataFrame([(0, "East"), (1, "West")], "r_regionkey long, r_name string").write.parquet(f"{path}/region.parquet")
    steps, place = [], {}
    for i, _, u, kind in events:
        place[u] = place.get(u, 0) + 1
        steps.append((f"U{u}", place[u], "_self_" if kind == "error" else f"U{i * 7 % 50}", kind, kind in ("view", "click", "error"), kind == "purchase"))
    return steps


def brute_paths(start, out, depth):
    found, level = [], [([start], False)]
    for d in range(depth + 1):
        found += [(p, d, r) for p, r in level]
        level = [(p + [n], n in p) for p, r in level if not r for n in out.get(p[-1], ())]
    return found


def test_queries_use_every_step(spark, tmp_path):
    steps = user_tables(spark, tmp_path)
    q, d = queries.queries(), str(tmp_path)
    out, back = {}, {}
    for c, _, t, _, call, _ in steps:
        if call:
            t = c if t == "_self_" else t
            out.setdefault(c, set()).add(t)
            back.setdefault(t, set()).add(c)
    assert any(n > 5 for _, n, *_ in steps)
    tree = sorted((r.path, r.depth, r.repeat) for r in q["H4_call_tree"](spark, d).collect())
    assert tree == sorted((">".join(p), n, r) for p, n, r in brute_paths("U1", out, 4))
    tree = sorted((r.path, r.depth, r.repeat) for r in q["H5_caller_tree"](spark, d).collect())
    assert tree == sorted(("<".join(p), n, r) for p, n, r in brute_paths("U1", back, 3))
    ordered = {}
    for c, n, t, _, call, _ in sorted(steps, key=lambda x: x[:2]):
        if call and t != "_self_" and t not in ordered.setdefault(c, []):
            ordered[c].append(t)

    def walk(node, depth, seen):
        if node not in seen and depth <= 10:
            seen.append(node)
            for n in ordered.get(node, ()):
                walk(n, depth + 1, seen)
        return seen

    assert [r.name for r in sorted(q["H6_flow"](spark, d).collect())] == walk("U1", 0, [])
    assert {(r["class"], r.step) for r in q["J22_explain_chain"](spark, d).collect()} == {(c, n) for c, n, *_ in steps}
    edges_ = {(r.trace, r.pos, r.caller, r.callee) for r in q["J4_J5_backtrace"](spark, d).collect()}
    name = {(c, n): f"N{t}::{m}" for c, n, t, m, *_ in steps}
    assert edges_ == {(c, -(n - 1), name[c, n + 1], name[c, n]) for c, n in name if (c, n + 1) in name}
    flow_starts = {r.flow.split()[0] for r in q["H7_key_flows"](spark, d).collect()}
    assert "U50" in flow_starts


def test_key_flows_rank_by_modules(spark):
    calls = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("x", "y", 1), ("x", "z", 2)], "src string, dst string, pos int")
    members = spark.createDataFrame([(n, "m") for n in "abcd"] + [(n, n) for n in "xyz"], "name string, module string")
    assert flows.key_flows(["a", "x"], calls, members) == [["x", "y", "z"], ["a", "b", "c", "d"]]
    assert flows.key_flows([], calls, members) == []
    entries = spark.createDataFrame([("r", "root", 9), ("h", "hub", 2), ("k", "hub", 3), ("m", "main", 0)], "name string, kind string, degree long")
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate("rhkm")], "name string, ord long")
    assert flows.ranked_starts(entries, nodes) == ["m", "k", "h", "r"]


def test_field_types_of_shared_pointers(spark, tmp_path):
    df = spark.createDataFrame([("std::shared_ptr<Disk>",), ("std::weak_ptr<Disk>",), ("std::shared_ptr<const Disk>",), ("std::shared_ptr<int>",)], "t string")
    got = [tuple(r.d) if r.d else None for r in df.select(extraction.field_dependency(F.col("t")).alias("d")).collect()]
    assert got == [("Disk", "aggregation", None), ("Disk", "aggregation", None), None, None]
    spark.createDataFrame([(i, i) for i in range(6)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    rows = {r.p_partkey: (r.target, r.type, r.cardinality) for r in queries.queries()["X2_X3_X9_field_types"](spark, str(tmp_path)).collect()}
    assert set(rows) == set(range(6)) and rows[1] == (None, None, None) and rows[2] == ("Disk", "aggregation", "1..*")


def test_search_one_sets_cjk_apart(spark):
    docs = spark.createDataFrame([(1, "ab reads blocks"), (2, "event handler"), (3, "提 交 queue")], "doc long, text string")
    index = text.build_index(docs)
    assert {r.doc for r in text.search_one(index, "  提交ab ").collect()} == {1, 3}
    for bad in ("", " ", "x" * 1001):
        try:
            text.search_one(index, bad)
            raise AssertionError
        except ValueError:
            pass


def test_suggestions_name_frequent_targets(spark):
    visible = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    members = spark.createDataFrame([(n, "m") for n in "abcdef"] + [("g", "o")], "name string, module string")
    module_edges = spark.createDataFrame([("m", "o", 2), ("o", "m", 9)], "source string, target string, weight long")
    entries = spark.createDataFrame([("f", "hub", 5), ("a", "root", 9)], "name string, kind string, degree long")
    deps = edges(spark, [("a", "d"), ("b", "d"), ("c", "d"), ("a", "e"), ("b", "e"), ("a", "g"), ("a", "b"), ("c", "b"), ("a", "zz"), ("b", "zz"), ("f", "g"), ("d", "g"), ("a", "f"), ("b", "f"), ("c", "f")])
    found = [tuple(r) for r in flows.suggestions(visible, members, module_edges, entries, deps, 6).collect()]
    assert found == [("module", "o", 2), ("entry", "f", 5), ("target", "d", 3), ("target", "e", 2)]
    assert [tuple(r) for r in flows.suggestions(visible, members, module_edges, entries, deps).collect()] == found[:3]


def test_incremental_scan(spark, tmp_path):
    """A second scan without changes parses no file, one changed file is the only one parsed, and lost files go."""
    from graphloom.sources import incremental

    schema = "location string, ordinal long, name string"
    entry = spark.createDataFrame([], schema).schema
    stored, folder, seen = incremental.state_schema(entry), f"file://{tmp_path}/state", []

    def parse(files):
        rows = sorted(files.collect())
        seen.append([r.path for r in rows])
        return spark.createDataFrame([(r.path.removeprefix("/p/"), i, name) for r in rows for i, name in enumerate(r.content.split())] + [("", 9, "Lost")], schema)

    def scan(files):
        save = lambda df: incremental.save_state(df, folder) if "entries" in df.columns else spark.createDataFrame(df.collect(), df.schema)
        found, _ = incremental.scan(incremental.load_state(spark, folder, stored), spark.createDataFrame(files, "path string, content string"), parse, ["name"], save)
        return {(r.name, r.location) for r in found.collect()}

    files = [("/p/a.h", "A B"), ("/p/b.h", "C"), ("/p/c/a.h", "D B"), ("/p/d.h", None), ("/p/e.h", "")]
    first = {("A", "a.h"), ("B", "c/a.h"), ("C", "b.h"), ("D", "c/a.h"), ("Lost", "")}
    assert scan(files) == first and seen.pop() == ["/p/a.h", "/p/b.h", "/p/c/a.h", "/p/e.h"]
    assert scan(files) == first and seen.pop() == []
    files[0] = ("/p/a.h", "B E")
    assert scan(files) == (first - {("A", "a.h"), ("B", "c/a.h")}) | {("B", "a.h"), ("E", "a.h")} and seen.pop() == ["/p/a.h"]
    assert scan(files[:1]) == {("B", "a.h"), ("E", "a.h"), ("Lost", "")} and seen.pop() == []
    state = incremental.load_state(spark, folder, stored)
    assert [r.path for r in state.collect()] == ["/p/a.h"] and incremental.cache_stats(state).first().entries == 2
    incremental.invalidate(spark, folder, stored)
    assert scan(files[:1]) and seen.pop() == ["/p/a.h"]
    assert incremental.load_state(spark, folder, incremental.state_schema(spark.createDataFrame([], "x int").schema)).isEmpty()
