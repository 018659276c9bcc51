"""Plans that keep their bounds when tables grow, and the results of the steps that were changed for it."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_estimates_broadcast_nothing_in_method_queries(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    found = entry.queries()["H13_method_field_accessors"](spark, SF)
    assert "Broadcast" not in plan(found) and "SortMergeJoin" in plan(found)


def test_passages_are_found_where_their_characters_are(spark):
    from graphloom.operators import contain

    needles = ["a b", "b", "one two three", "ne two thr", "two  three four", " x ", "one two three four five six seven eight nine ten", "", None, "a b c d", "zz yy xx"]
    hays = ["one two three", "zone two threes", "in two  three four", "a x b", "so one two three four five six seven eight nine tenth", "a b c d a b c d", None, "", "one  two three"]
    n = spark.createDataFrame(list(enumerate(needles)), "n int, needle string")
    h = spark.createDataFrame(list(enumerate(hays)), "h int, hay string")
    want = sorted((i, j) for i, x in enumerate(needles) if x for j, y in enumerate(hays) if y and x in y)
    for most in (1, 3, 6):
        assert sorted((r["n"], r["h"]) for r in contain.containing_passages(n, h, most).collect()) == want
    assert sorted((r["n"], r["h"]) for r in contain.containing_passages(n.filter("n < 2"), h).collect()) == [p for p in want if p[0] < 2]


def test_terms_are_counted_where_the_text_is(spark, tmp_path):
    from graphloom.operators import text

    docs = spark.createDataFrame([(1, "red fish blue fish"), (2, "one fish"), (3, None)], "doc long, text string")
    index = text.build_index(docs)
    for rows in (index.weights, text.top_terms(index, 2)):
        assert plan(rows).count("Exchange hashpartitioning(doc") <= 1
    assert {(r["doc"], r["rank"]) for r in text.top_terms(index, 2).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_rows_of_call_trees_do_not_move(spark, monkeypatch):
    from graphloom import method_queries
    from graphloom.operators import methods

    kept, keep = [], methods.keep
    monkeypatch.setattr(methods, "keep", lambda df: kept.append(keep(df)) or kept[-1])
    started, parts = method_queries._made(spark, SF), method_queries._assembly(spark, SF)
    shown = lambda df: sorted((r["root_class"], tuple(r["path"]), r["class"], r["method"]) for r in df.collect())
    whole = shown(methods.call_tree(started, *parts))
    assert sum(df.count() for df in kept if "path" in df.columns) < len(whole) / 2
    for depth in (0, 1, 4):
        assert shown(methods.call_tree(started, *parts, max_depth=depth)) == [r for r in whole if len(r[1]) <= depth]


def test_estimates_broadcast_nothing_in_caller_trees(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    assert "Broadcast" not in plan(entry.queries()["H5_method_caller_tree"](spark, SF))


def test_tasks_of_graph_queries_take_bounded_parts(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128MB")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB")
    entry.queries()["J8_relations"](spark, SF)
    assert [spark.conf.get(f"spark.sql.{k}") for k in ("files.maxPartitionBytes", "adaptive.advisoryPartitionSizeInBytes")] == ["16MB", "16MB"]


def test_enrichment_reads_its_rows_from_where_they_were_kept(spark, tmp_path):
    from graphloom.operators import enrich
    from graphloom.sources.snapshots import Store

    rows = spark.createDataFrame([(i, f"Gear{i}Pool", "Unknown", ["f()"], [], [("A", "aggregation")]) for i in range(4)], "ord int, name string, responsibility string, interfaces array<string>, bases array<string>, deps array<struct<target:string,type:string>>")
    degrees = rows.groupBy("name").count().selectExpr("name", "count AS in_degree")
    found = enrich.enrich_classes(rows, degrees, Store(spark, f"file://{tmp_path}/store"))
    assert (found.total, found.asked, found.rows.count()) == (4, 4, 4)
    assert "Aggregate(keys=[name" not in plan(found.rows)


def test_names_of_a_word_come_to_its_logs_as_one_row(spark):
    from graphloom.operators import contain

    logs = spark.createDataFrame([(i, f"line: P{i} by S{i % 3}00 indo") for i in range(30)], "log int, text string")
    entries = spark.createDataFrame([(f"S{i}00", "indonesia", i) for i in range(15)] + [("line", "", 3)], "name string, namespace string, ord int")
    found = contain.anchors(logs, entries)
    assert "Window" not in plan(found)
    rows = [(r["log"], r["name"]) for r in found.collect()]
    want = sorted([(i, f"S{i}00") for i in range(15)] + [(3, "line")])[:10]
    assert sorted(rows) == sorted((log, name) for log in range(30) for _, name in want)


def test_marks_of_steps_do_not_meet_in_one_task(spark):
    assert "IN (_self_,_meta_)" in plan(entry.queries()["C11_path_subgraphs"](spark, SF))


def test_module_rules_are_one_pattern_each(spark):
    """The rules are evaluated several times a row; as a condition for each name they made one task of a small file slow."""
    import re

    from pyspark.sql import functions as F

    from graphloom.operators import grouping

    names = ["std", "std::a", "stdx", "std:a", "google", "google::protobuf", "google::protobuf::a", "google::protobufx", "fmt", "a::std", "", None]
    rows = spark.createDataFrame([(n, "vendored/a" if i % 2 else "src/vendor") for i, n in enumerate(names)], "name string, path string")
    got = rows.select("name", grouping.third_party_namespace(F.col("name")).alias("ns"), grouping.third_party_directory(F.col("path")).alias("dir")).collect()
    third = {"std", "std::a", "google::protobuf::a", "fmt"}
    assert [r.ns for r in got] == [n in third if n is not None else None for n in names] and [r.dir for r in got] == [bool(i % 2) for i in range(len(names))]
    nodes = spark.range(5).select(F.col("id").cast("string").alias("name"), F.concat(F.lit("n"), "id").alias("namespace"), F.concat(F.lit("d/"), "id").alias("file"))
    plan = grouping.with_module(nodes)._jdf.queryExecution()
    code = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(plan, "codegen")
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 2500


def test_needles_are_broadcast_by_their_own_number(spark, monkeypatch):
    """Many names share few grams, so the number of grams tells nothing about how many needles go through the driver."""
    from pyspark.sql import functions as F

    from graphloom.operators import contain

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(contain, "GRAMS", 1500)
    names = spark.range(1000, 3000).select(F.concat(F.lit("P"), "id").alias("needle"))
    words = spark.range(1000, 3000).select(F.concat(F.lit("xP"), "id", F.lit("0::f")).alias("hay"))
    want = [(f"P{i}", f"xP{i}0::f") for i in range(1000, 3000)]
    for most in (3, contain.WHOLE):
        found = contain.containing(names, words, most)
        assert "Broadcast" not in plan(found)
        assert sorted((r["needle"], r["hay"]) for r in found.collect()) == want


def test_flows_are_no_groups_in_pandas(spark):
    """Each start was a group of its own, however short its walk; names of methods don't move with what a start reaches."""
    import re

    from graphloom.operators import methods

    found = entry.queries()["H6_method_flows"](spark, SF)
    assert "FlatMapGroupsInPandas" not in plan(found) and re.search(r"MapInArrow walked\(start#\d+L, node#\d+, called#\d+\)", plan(found))
    called = {1: [2, methods.SHOWN, 3, 9], 2: [methods.NOTHING, 3, 1, methods.SHOWN], 3: []}
    assert methods.walk(1, called, 10) == [(1, 0), (2, 0), (3, 0), (2, 4), (1, 2)]
    assert methods.walk(1, called, 1) == [(1, 0), (2, 0), (2, 4), (1, 2), (3, 0)]
    assert methods.walk(1, called, 0) == [(1, 0), (1, 2)]


def test_passages_of_too_many_words_go_by_their_grams(spark, monkeypatch):
    from graphloom.operators import contain

    n = spark.createDataFrame([(1, "a bb c dd e"), (2, "b"), (3, "a  c"), (4, None)], "n int, needle string")
    h = spark.createDataFrame([(1, "xa bb c dd ef"), (2, "a bb c dd"), (3, "a  c a  c"), (4, None), (5, "")], "h int, hay string")
    for limit in (contain.GRAMS, 1):
        monkeypatch.setattr(contain, "GRAMS", limit)
        found = contain.containing_passages(n, h)
        assert sorted((r["n"], r["h"]) for r in found.collect()) == [(1, 1), (2, 1), (2, 2), (3, 3)]


def test_texts_are_read_once_for_passages(spark, monkeypatch):
    from graphloom.operators import contain

    kept, keep = [], contain.keep
    monkeypatch.setattr(contain, "keep", lambda df: kept.append(plan(df)) or keep(df))
    h = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text AS hay")
    n = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id", "text AS needle")
    found = contain.containing_passages(n, h)
    assert sum("documents.parquet" in p for p in [*kept, plan(found)]) == 1


def test_best_terms_are_the_same_when_rare_ones_stay_in_their_piece(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from graphloom.operators import text

    rng = random.Random(5)
    said = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(300, None), (7, "w1 w2 w2"), (8, "漢字 w1x")]
    docs = spark.createDataFrame(said, "doc long, text string").repartition(8)
    monkeypatch.setattr(text, "CHARS", 500)
    tallied = []
    monkeypatch.setattr(text, "_tallied", lambda texts, least, f=text._tallied: tallied.append(least) or f(texts, least))
    rows = lambda df: sorted((r["doc"], r["term"], round(r["w"], 9)) for r in df.collect())
    for features, tallies in ((20, {2}), (400, {1, 2})):
        tallied.clear()
        index = text.build_index(docs, max_features=features)
        assert set(tallied) == tallies
        assert "Generate" not in plan(index.idf)
        monkeypatch.setattr(text, "TERMS", 0)
        plain = text.build_index(docs, max_features=features)
        monkeypatch.setattr(text, "TERMS", 200_000)
        assert rows(index.weights) == rows(plain.weights) and index.idf.count() == features
        assert sorted(tuple(r) for r in index.norms.select("doc", F.round("norm", 9)).collect()) == sorted(tuple(r) for r in plain.norms.select("doc", F.round("norm", 9)).collect())


def test_tasks_give_on_their_best_documents_only(spark, monkeypatch):
    import random

    from graphloom.operators import text

    rng = random.Random(3)
    line = lambda n: " ".join(f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(n))
    docs = spark.createDataFrame([(i, line(rng.randint(0, 40))) for i in range(200)] + [(200 + i, "w1 w2 w3 w4") for i in range(20)] + [(300, None)], "doc long, text string")
    asked = spark.createDataFrame([(f"q{i}", line(9)) for i in range(30)] + [("same", "w1 w2 w3 w4"), ("none", "zzz"), ("null", None)], "query string, text string")
    index = text.build_index(docs, max_features=60)
    plain = text.Index(index.weights, index.norms, index.idf)
    rows = lambda df: sorted(tuple(r) for r in df.select("query", "doc", "score", "rank").collect())
    want = rows(text.search(plain, asked, 4))
    for cells in (text.CELLS, 100):
        monkeypatch.setattr(text, "CELLS", cells)
        monkeypatch.setattr(text, "ROWS", 64 if cells == 100 else 1000)
        found = text.search(index, asked, 4)
        assert rows(found) == want and "MapInArrow" in plan(found)
    assert [r[1] for r in want if r[0] == "same"] == [200, 201, 202, 203]
    assert text.search(index, asked.limit(0), 4).isEmpty()
