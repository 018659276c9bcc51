"""Stored refs, enrichment with a memo, bodies and declarations, containment."""

import hashlib
import json
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from graphloom.operators import backfill, contain, diff, enrich, graph
from graphloom.sources.snapshots import UNKNOWN, Store, load_graph, save_graph


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/{uuid.uuid4().hex}")


# --- refs


def test_refs_name_whole_snapshots_and_their_past(spark, store):
    assert store.load("main") is None and store.meta("main") == UNKNOWN
    for k in range(3):
        store.publish("main", {"t": spark.range(k + 1)}, {"commit": f"c{k}"})
    assert [store.load(r)["t"].count() for r in ("main", "main~1", "main~2")] == [3, 2, 1]
    assert store.load("main~3") is None and store.load("other") is None
    assert store.meta("main~1") == UNKNOWN | {"commit": "c1"}
    store.publish("main", {"t": spark.range(5)}, append=True)
    assert store.load("main")["t"].count() == 8 and store.load("main~1")["t"].count() == 3


def test_a_lost_write_leaves_the_ref(spark, store):
    first = store.publish("main", {"t": spark.range(2)})
    broken = spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.publish("main", {"ok": spark.range(1), "t": broken})
    assert store.manifest()["refs"] == {"main": first} and store.load("main")["t"].count() == 2


def test_the_later_of_two_writers_goes_on_top(spark, store, monkeypatch):
    store.publish("a", {"t": spark.range(1)})
    stale, fresh = store.manifest(), Store(spark, store.path)
    fresh.publish("b", {"t": spark.range(2)})
    assert not store._move(stale)
    answers = [stale]
    real = Store.manifest
    monkeypatch.setattr(Store, "manifest", lambda self: answers.pop() if answers else real(self))
    store.publish("c", {"t": spark.range(3)})
    assert set(store.manifest()["refs"]) == {"a", "b", "c"}


@pytest.mark.parametrize("text", ["{", "[]", '{"format": 99, "refs": {}, "snapshots": {}}', '{"format": 1}', ""])
def test_a_bad_manifest_reads_as_empty(spark, store, text):
    save_graph(store, spark.createDataFrame([("a", ["b"])], "name string, dependents array<string>"))
    assert load_graph(store).count() == 1
    folder = store.path.removeprefix("file://") + "/manifests"
    with open(f"{folder}/2.json", "w") as f:
        f.write(text)
    assert load_graph(store).count() == 0 and load_graph(store).columns == ["name", "dependents"]
    save_graph(store, spark.createDataFrame([("c", ["d"])], "name string, dependents array<string>"))
    assert load_graph(store).first()["name"] == "c"


SNAP = "name string, interfaces array<string>, risk string, file string, pattern string, hash string, deps array<struct<target:string,type:string>>"


def test_diff_of_refs_is_a_record_or_none(spark, store):
    old = spark.createDataFrame([("A", ["f"], "low", "a.h", None, "1", [("B", "x")]), ("B", [], "low", "b.h", None, "2", []), ("C", [], "low", "c.h", "Proxy", "3", [])], SNAP)
    new = spark.createDataFrame([("A", ["g"], "high", "a.h", None, "9", [("B", "y")]), ("B", [], "low", "b.h", None, "2", []), ("D", [], "low", "d.h", "Factory", "4", [])], SNAP)
    edges = spark.createDataFrame([("B", "A"), ("E", "B"), ("D", "A")], "src string, dst string")
    store.publish("main", {"classes": old}, {"commit": "one"})
    assert diff.diff_refs(store, "main", "main") is None and diff.diff_refs(store, "nothing", "main") is None
    store.publish("main", {"classes": new, "edges": edges}, {"commit": "two"})
    rows = {(r["section"], r["name"]): r for r in diff.diff_refs(store, "main~1", "main").collect()}
    assert set(rows) == {("added", "D"), ("removed", "C"), ("modified", "A"), ("impact_direct", "B"), ("impact_indirect", "E")}
    a, d, c = rows["modified", "A"], rows["added", "D"], rows["removed", "C"]
    assert (a["interfaces_added"], a["interfaces_removed"], a["risk_change"], a["file_change"]) == (["g"], ["f"], "low->high", None)
    assert [tuple(x) for x in a["dep_changes"]] == [("B", "retyped", "x", "y")]
    assert (d["file"], d["pattern"], d["risk"], d["commit"]) == ("d.h", "Factory", "low", "two") and (c["file"], c["pattern"], c["risk"]) == ("c.h", None, None)


# --- enrichment

ENTRY = "name string, responsibility string, interfaces array<string>, bases array<string>, deps array<struct<target:string,type:string>>"


def entries(spark, extra=()):
    rows = [("DiskManager", "Unknown", ["b()", 'a("é\t")'], ["Base"], [("Pool", "aggregation"), ("A", "x")]), ("Pool", None, None, None, None), ("Q", "Runs \\ \x01", [], [], []), ("Q", "Runs \\ \x01", [], [], [])]
    return spark.createDataFrame([*rows, *extra], ENTRY)


def degrees(spark):
    return spark.createDataFrame([("Pool", 5), ("DiskManager", 2)], "name string, in_degree long")


def digest(prefix, key):
    return prefix + hashlib.sha256(json.dumps(key, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def test_hashes_are_of_sorted_json(spark):
    got = [r[0] for r in entries(spark).select(enrich.entry_hash()).collect()]
    want = [digest("", {"className": n, "responsibility": r or "", "interfaces": sorted(i or []), "dependencies": sorted([list(x) for x in d or []]), "baseClasses": sorted(b or [])}) for n, r, i, b, d in entries(spark).collect()]
    assert got == want
    m = spark.createDataFrame([("io", ["b", "a"], ["z", "y"]), ("x", None, None)], "name string, class_names array<string>, external array<string>")
    assert [r[0] for r in m.select(enrich.module_hash()).collect()] == [digest("mod:", {"name": n, "classNames": sorted(c or []), "externalDeps": sorted(e or [])}) for n, c, e in m.collect()]
    p = spark.createDataFrame([(["b", "a"], ["main"])], "modules array<string>, entry_points array<string>")
    assert p.select(enrich.project_hash()).first()[0] == digest("proj:", {"modules": ["a", "b"], "entryPoints": ["main"]})


GOOD = {"intent": "Knows", "tradeoffs": ["t"], "changeRisk": "low", "designPattern": None}


def test_answers_are_checked(spark):
    bad = [None, "", "no", "[1]", '"x"', "{}", *(json.dumps(GOOD | x) for x in ({"intent": " \n"}, {"intent": 3}, {"intent": None}, {"tradeoffs": "t"}, {"tradeoffs": None}, {"changeRisk": "huge"}, {"changeRisk": 1}))]
    good = [json.dumps(GOOD), "```json\n" + json.dumps(GOOD) + "\n```", json.dumps(GOOD | {"tradeoffs": []}), json.dumps({k: v for k, v in GOOD.items() if k != "designPattern"})]
    df = spark.createDataFrame([(x,) for x in [*bad, *good]], "answer string").select(enrich.sound_class(F.col("answer")))
    assert [r[0] for r in df.collect()] == [False] * len(bad) + [True] * len(good)
    texts = ['{"summary": " \\n it\\n"}', '{"summary": 5}', '{"summary": " "}', "x", None, "```\n{\"summary\": \"a\"}```"]
    df = spark.createDataFrame([(x,) for x in texts], "answer string").select(enrich.sound_text(F.col("answer"), "summary"))
    assert [r[0] for r in df.collect()] == ["it", None, None, None, None, "a"]


def model(counted):
    """A model that knows disks, answers nonsense on pools, and notes in a file what it was asked."""

    def ask(prompts):
        with open(counted, "a") as f:
            f.writelines(re.search("Class: (.*)", p)[1] + "\n" for p in prompts)
        return [json.dumps(GOOD | {"intent": "Knows disks"}) if "DiskManager" in p else "nonsense" for p in prompts]

    return ask


def test_only_what_the_memo_lacks_is_asked_for(spark, store, tmp_path):
    log = tmp_path / "asked"
    first = enrich.enrich_classes(entries(spark), degrees(spark), store, model(log))
    assert (first.total, first.asked, first.known) == (4, 3, 1) and sorted(log.read_text().split()) == ["DiskManager", "Pool", "Q"]
    got = {r["name"]: r for r in first.rows.collect()}
    assert got["DiskManager"]["intent"] == "Knows disks" and got["DiskManager"]["by_model"] and got["DiskManager"]["tradeoffs"] == ["t"]
    assert got["Pool"]["intent"] == "Handles pool operations" or got["Pool"]["intent"].startswith("Pools"), got["Pool"]
    assert (got["Pool"]["risk"], got["Pool"]["by_model"]) == ("high", False)
    again = enrich.enrich_classes(entries(spark), degrees(spark), store, model(log))
    assert (again.asked, again.known) == (0, 4) and len(log.read_text().split()) == 3
    assert sorted(map(repr, again.rows.collect())) == sorted(map(repr, first.rows.collect()))
    changed = enrich.enrich_classes(entries(spark, [("New", "", [], [], [])]), degrees(spark), store, model(log))
    assert changed.asked == 1 and log.read_text().split()[3:] == ["New"]


def test_a_model_that_fails_leaves_the_rules(spark, store):
    def fails(prompts):
        raise RuntimeError("down")

    ruled = enrich.heuristics(entries(spark), degrees(spark)).select("name", "intent", "risk")
    for ask in (fails, lambda prompts: [], None):
        got = enrich.enrich_classes(entries(spark), degrees(spark), Store(spark, f"{store.path}/{uuid.uuid4().hex}"), ask)
        assert got.rows.filter("by_model").isEmpty() and sorted(got.rows.select("name", "intent", "risk").collect()) == sorted(ruled.collect())


def test_modules_and_projects_fall_back_to_their_seed_and_ask_again(spark, store):
    modules = spark.createDataFrame([("io", ["A"], ["x"], "seed io"), ("core", ["B"], [], "seed core")], "name string, class_names array<string>, external array<string>, seed string")
    ask = lambda prompts: ['{"summary": "About io"}' if "Module: io" in p else None for p in prompts]
    for asked in (2, 1):
        got = enrich.enrich_modules(modules, store, ask)
        assert got.asked == asked and {r["name"]: r["summary"] for r in got.rows.collect()} == {"io": "About io", "core": "seed core"}
    project = spark.createDataFrame([("p", ["io"], ["main"])], "name string, modules array<string>, entry_points array<string>")
    assert enrich.enrich_project(project, store).rows.first()["summary"] is None
    assert enrich.enrich_project(project, store, lambda p: ['{"projectSummary": "All"}'] * len(p)).rows.first()["summary"] == "All"
    assert enrich.enrich_project(project, store).asked == 0


# --- bodies


def brute_backfill(slots, bodies):
    out = {s: None for s in slots}
    for owner_name, body, _, name, signature in sorted(bodies, key=lambda b: b[2]):
        known = {s[0] for s in slots}
        owner = owner_name if owner_name in known else owner_name.split("::")[-1]
        free = [s for s in sorted(slots, key=lambda s: s[2]) if s[0] == owner and not s[3] and out[s] is None]
        fits = [s for s in free if s[1] == signature] or [s for s in free if name and re.match(r".*?\b(" + re.escape(name) + r")\s*\(", s[1])]
        if fits:
            out[fits[0]] = body
    return [(*s[:3], b) for s, b in out.items()]


def test_bodies_take_free_declarations_in_order(spark):
    rng = random.Random(5)
    slots, bodies = [], []
    for c in ("n::A", "A", "B", "m::C", "Empty"):
        for place in range(0 if c == "Empty" else 6):
            slots.append((c, rng.choice(["int f(int)", "int f(long)", "void g()", "function<void(f)> g (int f)", "~A()", "operator()"]), place, rng.random() < 0.2))
    for i in range(40):
        name = rng.choice(["f", "g", "~A", "h", ""])
        bodies.append((rng.choice(["n::A", "A", "q::A", "B", "x::B", "m::C", "C", "none"]), f"b{i}", i, name, rng.choice([f"int {name}(int)", f"int {name}(long)", f"void {name}()", f"{name}()"])))
    got = backfill.backfill(spark.createDataFrame(slots, "class string, signature string, place int, filled boolean"), spark.createDataFrame(bodies, "class string, body string, ord int, name string, signature string"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_backfill(slots, bodies)))
    none = backfill.backfill(spark.createDataFrame(slots, "class string, signature string, place int, filled boolean"), spark.createDataFrame([], "class string, body string, ord int, name string, signature string"))
    assert none.count() == len(slots) and none.filter("body IS NOT NULL").isEmpty()


# --- containment


@pytest.mark.parametrize("most", [1, 2, 3, 8])
def test_containing_is_the_nested_loop(spark, most, monkeypatch):
    rng = random.Random(most)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    needles = [(i, word(rng.randint(0, 5))) for i in range(60)] + [(60, None), (61, "zzzz"), (62, "a")]
    hays = [(i, word(rng.randint(0, 30))) for i in range(80)] + [(80, None), (81, "a" * 5000)]
    want = sorted((i, k) for i, n in needles for k, h in hays if n and h and n in h)
    for limit in (contain.GRAMS, 0):
        monkeypatch.setattr(contain, "GRAMS", limit)
        got = contain.containing(spark.createDataFrame(needles, "i int, needle string"), spark.createDataFrame(hays, "k int, hay string"), most)
        assert sorted((r["i"], r["k"]) for r in got.collect()) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert contain.containing(spark.createDataFrame([], "needle string"), spark.createDataFrame(hays, "k int, hay string")).isEmpty()


def test_anchors_by_name_and_namespace(spark):
    names = [("Pool", "core::mem", 1), ("PoolManager", "core", 2), ("Lo", "", 3), ("Disk", "storage", 4), ("", "storage", 0)] + [(f"N{i:02}", "storage", 10 + i) for i in range(20)]
    logs = [(1, "PoolManager::run failed"), (2, "storage: x"), (3, "abc xyz"), (4, None), (5, "Load Lo"), (6, "Mana stor core")]
    got = contain.anchors(spark.createDataFrame(logs, "log int, text string"), spark.createDataFrame(names, "name string, namespace string, ord int"))
    want = []
    for log, text in logs:
        words = {w for w in re.split(r"[^a-zA-Z0-9_:]+", text or "") if len(w) >= 4}
        hit = [n for n, s, o in sorted(names, key=lambda x: x[2]) if n and any(w in n or n in w or (s and w in s) for w in words)]
        want += [(log, n) for n in hit[:10]]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and any(x[0] == 6 for x in want)


def test_relevance_is_the_share_of_tokens(spark):
    rows = [("DiskManager", "core::io", "Reads", ["void readBlock(int lba)"], ["BufferPool"], 1), ("BufferPool", "", None, None, [""], 2), ("Xy", None, "", [], None, 3)]
    df = spark.createDataFrame(rows, "name string, namespace string, responsibility string, interfaces array<string>, targets array<string>, ord int")
    e = df.select("name", "ord", contain.entry_tokens(*(F.col(c) for c in ("name", "namespace", "responsibility", "interfaces", "targets"))).alias("tokens"))
    queries = [("q1", "disk blocks"), ("q2", "BufferPool buffers"), ("q3", "a"), ("q4", "xylophone bufferpools disks")]

    def tokens(t):
        t = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub("([a-z])([A-Z])", r"\1 \2", t or ""))
        return list(dict.fromkeys(w.lower() for w in re.split(r"[\s_:,.()\[\]<>]+", t) if len(w) > 1))

    want = []
    for q, text in queries:
        scored = []
        for n, s, r, i, t, o in rows:
            held = tokens(n) + tokens(s) + tokens(r) + [x for y in i or [] for x in tokens(y)] + [x.lower() for x in t or [] if x]
            hit = [a for a in tokens(text) if any(a in b or b in a for b in held)]
            if hit:
                scored.append((-len(hit) / len(tokens(text)), o, n))
        want += [(q, n, -s, k) for k, (s, _, n) in enumerate(sorted(scored), 1)]
    got = contain.relevant(spark.createDataFrame(queries, "query string, text string"), e)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 3


def test_a_cluster_needs_a_named_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        applicationId, master = "app", "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        graph.shared_dir(Session())
    Context.master = "local[2]"
    assert graph.shared_dir(Session()) == graph.shared_dir(Session())
