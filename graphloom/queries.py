"""Queries over the driver's tables, one for each operator or small family, and DuckDB SQL for them.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import extraction, naming
from .operators import contain, diff, filters, flows, graph, grouping, render, text, trace
from .plans.adapters import call_steps, callers, layered_edges, nodes, supply_edges, table
from .sources import incremental

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

EDGES = """edges AS (
  SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst,
         CASE l_returnflag WHEN 'A' THEN 'aggregation' WHEN 'R' THEN 'composition' WHEN 'N' THEN 'association' ELSE 'dependency' END AS type,
         min(l_orderkey * 10 + l_linenumber) AS pos
  FROM lineitem GROUP BY ALL)"""
NODES = """nodes AS (
  SELECT 'S' || s_suppkey AS name, lower(r_name) || '::' || lower(n_name) AS namespace, lower(r_name) || '/' || lower(n_name) || '/' || s_suppkey AS file,
         CASE WHEN s_acctbal < 0 THEN 'Debtor' ELSE 'Creditor' END AS responsibility, s_suppkey AS ord
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 'P' || p_partkey, '', replace(lower(p_brand), '#', '_') || '/' || p_partkey, p_type, p_partkey + 1000000000 FROM part)"""
MEMBERS = """members AS (
  SELECT *, CASE WHEN namespace <> '' THEN split_part(namespace, '::', 1) ELSE split_part(file, '/', 1) END AS module FROM nodes)"""
LAYERS = """layers AS (
  SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
  UNION SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders UNION SELECT 'O' || l_orderkey, 'P' || l_partkey FROM lineitem)"""
STEPS = """steps AS (
  SELECT 'U' || user_id AS class, 'run' AS method, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
         CASE WHEN event_type = 'error' THEN '_self_' ELSE 'U' || (event_id * 7 % 50) END AS target, event_type AS member,
         CASE WHEN event_type IN ('view', 'click', 'error') THEN 'call' ELSE 'field' END AS kind, event_type = 'purchase' AS is_write
  FROM events),
resolved AS (SELECT *, CASE WHEN target = '_self_' THEN class ELSE target END AS owner FROM steps)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def joined(array: str | Column) -> Column:
    return F.array_join(array, ",")


def members(spark: SparkSession, d: str) -> DataFrame:
    return grouping.with_module(nodes(spark, d))


# --- E: aggregation -------------------------------------------------------


@query("E1_reverse_deps", f"WITH {EDGES} SELECT dst AS name, string_agg(DISTINCT src, ',' ORDER BY src) AS dependents FROM edges WHERE src <> dst GROUP BY dst")
def _(s, d):
    return graph.reverse_deps(supply_edges(s, d)).select("name", joined("dependents").alias("dependents"))


@query("E2_degrees", f"WITH {EDGES}, {NODES} SELECT n.name, coalesce(i.k, 0) AS in_degree, coalesce(o.k, 0) AS out_degree FROM nodes n LEFT JOIN (SELECT dst, count(DISTINCT src) AS k FROM edges GROUP BY dst) i ON i.dst = n.name LEFT JOIN (SELECT src, count(*) AS k FROM edges GROUP BY src) o ON o.src = n.name")
def _(s, d):
    return graph.degrees(nodes(s, d), supply_edges(s, d))


@query("E3_modules", f"WITH {EDGES}, {NODES}, {MEMBERS} SELECT m.module, CASE WHEN max(namespace) <> '' THEN m.module END AS namespace, (SELECT x.d FROM (SELECT split_part(file, '/', 1) AS d, count(*) AS c FROM members k WHERE k.module = m.module GROUP BY 1 ORDER BY c DESC, d LIMIT 1) x) AS directory, count(DISTINCT name) AS n_classes, coalesce(any_value(w.k), 0) AS internal_edges FROM members m LEFT JOIN (SELECT a.module, count(*) AS k FROM edges JOIN members a ON a.name = src JOIN members b ON b.name = dst WHERE a.module = b.module GROUP BY 1) w ON w.module = m.module GROUP BY m.module")
def _(s, d):
    return grouping.modules(members(s, d), supply_edges(s, d)).drop("class_names")


@query("E4_third_party", "SELECT p_partkey, CASE WHEN p_type LIKE 'STANDARD%' THEN true ELSE false END AS third_ns, p_size % 2 = 0 AS third_dir FROM part")
def _(s, d):
    p = table(s, d, "part")
    ns = F.when(F.col("p_type").startswith("STANDARD"), F.concat(F.lit("std::"), "p_type")).otherwise(F.concat(F.lit("standard::"), "p_type"))
    path = F.when(F.col("p_size") % 2 == 0, "vendor2").otherwise("src")
    return p.select("p_partkey", grouping.third_party_namespace(ns).alias("third_ns"), grouping.third_party_directory(path).alias("third_dir"))


@query("E5_primary_responsibility", f"WITH {NODES}, {MEMBERS} SELECT module, responsibility AS value FROM (SELECT module, responsibility, row_number() OVER (PARTITION BY module ORDER BY count(*) DESC, responsibility) AS r FROM members GROUP BY 1, 2) WHERE r = 1")
def _(s, d):
    return grouping.most_common(members(s, d), "module", F.col("responsibility"))


MODULE_EDGES = "module_edges AS (SELECT a.module AS source, b.module AS target, count(*) AS weight, string_agg(DISTINCT type, ',' ORDER BY type) AS dep_types FROM edges JOIN members a ON a.name = src JOIN members b ON b.name = dst WHERE a.module <> b.module GROUP BY 1, 2)"


def _module_edges(s, d):
    return grouping.module_edges(members(s, d), supply_edges(s, d))


@query("E6_module_edges", f"WITH {EDGES}, {NODES}, {MEMBERS}, {MODULE_EDGES} SELECT * FROM module_edges")
def _(s, d):
    return _module_edges(s, d).withColumn("dep_types", joined("dep_types"))


@query("E6_external_deps", f"WITH {EDGES}, {NODES}, {MEMBERS}, {MODULE_EDGES} SELECT source AS module, string_agg(target || ':' || weight, ',' ORDER BY weight DESC, target) AS external FROM module_edges GROUP BY 1")
def _(s, d):
    return grouping.external_deps(_module_edges(s, d)).select("module", joined("external").alias("external"))


ENTRIES = """deg AS (
  SELECT n.name, n.ord, coalesce(i.k, 0) AS ind, coalesce(o.k, 0) AS outd FROM nodes n LEFT JOIN (SELECT dst, count(DISTINCT src) AS k FROM edges GROUP BY dst) i ON i.dst = n.name
  LEFT JOIN (SELECT src, count(*) AS k FROM edges GROUP BY src) o ON o.src = n.name),
roots AS (SELECT name, 'root' AS kind, outd AS degree FROM deg WHERE ind = 0 AND outd >= 2 ORDER BY outd DESC, ord LIMIT 20),
hubs AS (SELECT name, 'hub' AS kind, ind AS degree FROM deg ORDER BY ind DESC, ord LIMIT 5),
entries AS (SELECT * FROM roots UNION ALL SELECT * FROM hubs WHERE degree >= 2 AND name NOT IN (SELECT name FROM roots))"""


@query("entry_points", f"WITH {EDGES}, {NODES}, {ENTRIES} SELECT * FROM entries")
def _(s, d):
    return grouping.entry_points(nodes(s, d), supply_edges(s, d))


@query("E9_entry_kinds", "WITH n AS (SELECT DISTINCT p_name AS t FROM part), k AS (SELECT replace(t, ' ', '') || CASE WHEN t LIKE '%ring' THEN 'Server' WHEN t LIKE '%bolt' THEN 'handler' WHEN t LIKE '%gear' THEN 'Serve' ELSE '' END AS name, t FROM n) SELECT name, CASE WHEN t LIKE '%anvil' THEN 'main' ELSE 'server' END AS kind, 0 AS degree FROM k WHERE t LIKE '%ring' OR t LIKE '%bolt' OR t LIKE '%anvil'")
def _(s, d):
    t = table(s, d, "part").select(F.col("p_name").alias("t")).distinct()
    name = F.concat(F.replace("t", F.lit(" "), F.lit("")), F.when(F.col("t").endswith("ring"), "Server").when(F.col("t").endswith("bolt"), "handler").when(F.col("t").endswith("gear"), "Serve").otherwise(""))
    n = t.select(name.alias("name"), F.lit(1).alias("ord"), "t")
    main = n.filter("t LIKE '%anvil'").select("name", F.lit("int main(int argc)").alias("signature"))
    none = s.createDataFrame([], "src string, dst string, type string, pos long")
    return grouping.entry_points(n.select("name", "ord"), none, signatures=main)


@query("E7_summary_seeds", f"""WITH {EDGES}, {NODES}, {MEMBERS}, {ENTRIES},
l AS (SELECT module, string_agg(responsibility, ', ' ORDER BY r) AS labels FROM (SELECT module, responsibility, row_number() OVER (PARTITION BY module ORDER BY count(*) DESC, responsibility) AS r FROM members WHERE responsibility <> '' GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1),
h AS (SELECT module, name, k FROM (SELECT m.module, m.name, i.k, row_number() OVER (PARTITION BY m.module ORDER BY i.k DESC, m.name) AS r FROM members m JOIN (SELECT dst, count(DISTINCT src) AS k FROM edges GROUP BY 1) i ON i.dst = m.name) WHERE r = 1 AND k > 1),
e AS (SELECT module, string_agg(name, ', ' ORDER BY r) AS eps FROM (SELECT m.module, m.name, row_number() OVER (PARTITION BY m.module ORDER BY m.ord) AS r FROM members m JOIN entries USING (name)) WHERE r <= 2 GROUP BY 1)
SELECT g.module, concat_ws('. ', 'Module "' || g.module || '" contains ' || g.n || CASE WHEN g.n = 1 THEN ' class' ELSE ' classes' END, 'primarily responsible for ' || labels, 'Key hub: ' || h.name || ' (used by ' || h.k || ' classes)', 'Entry via ' || eps) || '.' AS seed
FROM (SELECT module, count(DISTINCT name) AS n FROM members GROUP BY 1) g LEFT JOIN l USING (module) LEFT JOIN h USING (module) LEFT JOIN e USING (module)""")
def _(s, d):
    n, e = nodes(s, d), supply_edges(s, d)
    return grouping.summary_seeds(grouping.with_module(n), e, grouping.entry_points(n, e))


@query("E10_key_classes", f"WITH {EDGES}, {NODES}, {MEMBERS} SELECT module, name, k FROM (SELECT m.module, m.name, count(DISTINCT src) AS k, row_number() OVER (PARTITION BY m.module ORDER BY count(DISTINCT src) DESC, m.name) AS r FROM edges JOIN members m ON m.name = dst GROUP BY 1, 2) WHERE r <= 5")
def _(s, d):
    k = supply_edges(s, d).join(members(s, d).select(F.col("name").alias("dst"), "module"), "dst").groupBy("module", F.col("dst").alias("name")).agg(F.countDistinct("src").alias("k"))
    return k.withColumn("r", F.row_number().over(W.partitionBy("module").orderBy(F.desc("k"), "name"))).filter("r <= 5").drop("r")


@query("E12_project_totals", f"WITH {NODES}, {MEMBERS} SELECT count(DISTINCT module) AS modules, count(DISTINCT name) AS classes FROM members")
def _(s, d):
    return members(s, d).agg(F.countDistinct("module").alias("modules"), F.countDistinct("name").alias("classes"))


@query("E14_E15_risk_pivot", f"WITH {EDGES}, {NODES}, {MEMBERS}, g AS (SELECT m.module, coalesce(i.k, 0) AS k FROM members m LEFT JOIN (SELECT dst, count(DISTINCT src) AS k FROM edges GROUP BY 1) i ON i.dst = m.name) SELECT module, count(*) FILTER (WHERE k >= 5) AS high, count(*) FILTER (WHERE k >= 2 AND k < 5) AS medium, count(*) FILTER (WHERE k < 2) AS low FROM g GROUP BY 1")
def _(s, d):
    m = members(s, d)
    r = m.join(graph.degrees(m, supply_edges(s, d)), "name").withColumn("risk", naming.change_risk(F.col("in_degree")))
    return r.groupBy("module").agg(*[F.count_if(F.col("risk") == k).alias(k) for k in ("high", "medium", "low")])


@query("E16_label_totals", "SELECT quality, count(*) AS n, sum(toxic)::BIGINT AS toxic FROM labels GROUP BY 1")
def _(s, d):
    return table(s, d, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"))


@query("F3_top_module_edges", f"WITH {EDGES}, {NODES}, {MEMBERS}, {MODULE_EDGES} SELECT * FROM module_edges ORDER BY weight DESC, source, target LIMIT 20")
def _(s, d):
    return _module_edges(s, d).withColumn("dep_types", joined("dep_types")).orderBy(F.desc("weight"), "source", "target").limit(20)


# --- C, D: predicates, lookups, neighbours --------------------------------


@query("C1_name_filter", f"WITH {NODES} SELECT name, namespace FROM nodes WHERE namespace LIKE 'a%' AND regexp_matches(name, 's.*1', 'i')")
def _(s, d):
    return filters.name_filter(nodes(s, d), "s.*1", "a").select("name", "namespace")


@query("C2_explore", f"WITH {NODES} SELECT name, namespace FROM nodes WHERE namespace = 'asia' OR namespace LIKE 'asia::%'")
def _(s, d):
    return filters.explore(nodes(s, d), "asia").select("name", "namespace")


@query("C3_search_neighbours", f"WITH {EDGES}, {NODES}, hit AS (SELECT name FROM nodes WHERE regexp_matches(name, '^s1$', 'i')) SELECT name, true AS matched FROM hit UNION ALL SELECT DISTINCT dst, false FROM edges WHERE src IN (SELECT name FROM hit) AND dst NOT IN (SELECT name FROM hit)")
def _(s, d):
    return filters.search_with_neighbours(nodes(s, d), supply_edges(s, d), "^s1$")


@query("C4_sidebar", f"WITH {NODES}, {MEMBERS} SELECT module, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (WHERE lower(name) LIKE '%s1%'), '') AS names FROM members GROUP BY 1 HAVING lower(module) LIKE '%s1%' OR count(*) FILTER (WHERE lower(name) LIKE '%s1%') > 0")
def _(s, d):
    return filters.sidebar(members(s, d), "s1").withColumn("names", joined("names"))


@query("C5_unassigned", f"WITH {NODES}, {MEMBERS} SELECT name FROM nodes WHERE name NOT IN (SELECT name FROM members WHERE module = 'asia')")
def _(s, d):
    return filters.unassigned(nodes(s, d), members(s, d).filter("module = 'asia'"))


@query("C7_as_of", "SELECT e.event_id, (SELECT max(x.event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'signup' AND x.ts = (SELECT max(y.ts) FROM events y WHERE y.user_id = e.user_id AND y.event_type = 'signup' AND y.ts <= e.ts)) AS signup FROM events e WHERE e.event_type = 'purchase'")
def _(s, d):
    e = table(s, d, "events")
    starts = e.filter("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("value"))
    return filters.as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), starts, "user_id", "ts", "signup").select("event_id", "signup")


@query("A2_excluded", "SELECT page_id, (regexp_matches(p, '(^|/)fr(/|$)') OR regexp_matches(p, '7(/|$)')) AS excluded FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[#?].*$', '') AS p FROM pages)")
def _(s, d):
    p = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "[#?].*$", "")
    return table(s, d, "pages").select("page_id", p.alias("p")).select("page_id", filters.excluded(F.col("p"), ["fr", "*7"]).alias("excluded"))


@query("D4_drill_down", f"WITH {EDGES}, {NODES}, {MEMBERS}, own AS (SELECT DISTINCT name FROM members WHERE module = 'asia'), near AS (SELECT dst AS name FROM edges WHERE src IN (SELECT name FROM own) UNION SELECT src FROM edges WHERE dst IN (SELECT name FROM own)) SELECT name, true AS inside FROM own UNION ALL SELECT name, false FROM near WHERE name NOT IN (SELECT name FROM own)")
def _(s, d):
    return filters.drill_down(members(s, d), supply_edges(s, d), "asia")


@query("D5_neighbour_modules", f"WITH {EDGES}, {NODES}, {MEMBERS}, {MODULE_EDGES} SELECT target AS module FROM module_edges WHERE source = 'asia' UNION SELECT source FROM module_edges WHERE target = 'asia'")
def _(s, d):
    return filters.neighbour_modules(_module_edges(s, d), "asia")


@query("D6_chat_context", f"WITH {EDGES}, c AS (SELECT 'P1' AS name, 0 AS rank UNION ALL SELECT 'S2', 0 UNION ALL SELECT dst, 1 FROM edges WHERE src IN ('P1', 'S2') UNION ALL SELECT src, 2 FROM edges WHERE dst IN ('P1', 'S2')) SELECT name, min(rank) AS rank FROM c GROUP BY 1")
def _(s, d):
    return filters.dependents_and_dependencies(s.createDataFrame([("P1",), ("S2",)], "name string"), supply_edges(s, d))


@query("D13_entries_by_module", f"WITH {EDGES}, {NODES}, {MEMBERS}, {ENTRIES} SELECT module, kind, count(*) AS n FROM entries JOIN members USING (name) GROUP BY 1, 2")
def _(s, d):
    n, e = nodes(s, d), supply_edges(s, d)
    return grouping.entry_points(n, e).join(grouping.with_module(n), "name").groupBy("module", "kind").agg(F.count(F.lit(1)).alias("n"))


# --- B: change data capture; G: snapshots ---------------------------------

CDC = """old AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 5 <> 0),
new AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS hash FROM documents WHERE doc_id % 11 <> 0)"""


def _cdc(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.col("text").alias("content"))
    files = incremental.with_hash(docs)
    old = files.filter("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("hash")).alias("hash"))
    return old, files.filter("doc_id % 11 <> 0").select("path", "hash")


@query("B2_classify", f"WITH {CDC} SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS status FROM old o FULL JOIN new n ON o.path = n.path")
def _(s, d):
    return incremental.classify(*_cdc(s, d))


@query("B3_evict", f"WITH {CDC} SELECT path, hash FROM old WHERE path IN (SELECT path FROM new)")
def _(s, d):
    return incremental.evict(*_cdc(s, d))


@query("B5_merge", "SELECT o_custkey AS key, max(o_orderkey) FILTER (WHERE fresh = top) AS ordinal FROM (SELECT *, max(fresh) OVER (PARTITION BY o_custkey) AS top FROM (SELECT *, CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 1 ELSE 0 END AS fresh FROM orders)) GROUP BY 1")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ordinal"), "o_orderdate")
    new = F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")
    return incremental.merged(o.filter(~new), o.filter(new), ["key"]).select("key", "ordinal")


@query("B8_incremental_scan", "WITH f AS (SELECT doc_id::VARCHAR AS path, 'K' || doc_id % 97 AS name, lang IS NULL OR n_chars % 2 = 0 AS fresh FROM documents WHERE text IS NOT NULL) SELECT name, path AS location FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY fresh DESC, path DESC) AS r FROM f) WHERE r = 1")
def _(s, d):
    """Files without a language are new in the second scan, those of even length changed."""
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), "doc_id", "lang", "n_chars")
    parse = lambda files: files.select(F.col("path").alias("location"), F.lit(0).cast("long").alias("ordinal"), F.concat(F.lit("K"), (F.col("doc_id") % 97).cast("string")).alias("name"))
    none = s.createDataFrame([], incremental.state_schema(parse(docs).schema))
    _, state = incremental.scan(none, docs.filter("lang IS NOT NULL"), parse, ["name"], graph.keep)
    changed = docs.withColumn("content", F.when(F.col("n_chars") % 2 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return incremental.scan(state, changed, parse, ["name"], graph.keep)[0].select("name", "location")


@query("A8_merge_units", "WITH e AS (SELECT o_custkey AS key, year(o_orderdate) AS unit, o_orderpriority AS signature, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS steps FROM orders GROUP BY 1, 2, 3), f AS (SELECT *, max(unit) OVER (PARTITION BY key) AS top, last_value(steps IGNORE NULLS) OVER (PARTITION BY key, signature ORDER BY unit) AS kept FROM e) SELECT key, signature, kept AS step FROM f WHERE unit = top")
def _(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("key"), F.year("o_orderdate").alias("unit"), F.col("o_orderpriority").alias("signature")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("k"))
    e = o.withColumn("steps", F.when(F.col("k").isNotNull(), F.array("k")).otherwise(F.array().cast("array<bigint>"))).drop("k")
    return incremental.merge_units(e).select("key", "signature", F.get("steps", 0).alias("step"))


@query("A9_trusted", f"WITH {EDGES} SELECT src, dst, type FROM edges WHERE type IN ('composition', 'aggregation', 'inheritance') OR dst IN (SELECT 'P' || p_partkey FROM part WHERE p_size > 25)")
def _(s, d):
    known = table(s, d, "part").filter("p_size > 25").select(F.concat(F.lit("P"), "p_partkey").alias("key"))
    return incremental.trusted(supply_edges(s, d).select("src", "dst", "type"), known)


@query("A10_diagnostics", "SELECT DISTINCT event_type AS severity, props AS spelling FROM events")
def _(s, d):
    return incremental.diagnostics(table(s, d, "events").select(F.col("event_type").alias("severity"), F.col("props").alias("spelling")))


@query("B7_cache_stats", "SELECT count(*) AS files, sum(n)::BIGINT AS entries FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def _(s, d):
    return incremental.cache_stats(table(s, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("entries")))


SNAP = """snap AS (SELECT o_custkey AS name, o_orderpriority, o_orderstatus, year(o_orderdate)::VARCHAR AS y, o_orderdate < TIMESTAMP '1998-01-01' AS early FROM orders),
old_rows AS (SELECT * FROM snap WHERE early AND name % 10 <> 3), new_rows AS (SELECT * FROM snap WHERE name % 10 <> 4),
old AS (SELECT name, list_sort(list(DISTINCT o_orderpriority)) AS i, CASE WHEN count(*) >= 10 THEN 'high' ELSE 'low' END AS risk, list_sort(list(DISTINCT y)) AS a, 'f' || count(*) % 3 AS file FROM old_rows GROUP BY 1),
new AS (SELECT name, list_sort(list(DISTINCT o_orderpriority)) AS i, CASE WHEN count(*) >= 10 THEN 'high' ELSE 'low' END AS risk, list_sort(list(DISTINCT y)) AS a, 'f' || count(*) % 3 AS file FROM new_rows GROUP BY 1),
old_deps AS (SELECT name, o_orderstatus AS target, max(o_orderpriority) AS type FROM old_rows GROUP BY 1, 2),
new_deps AS (SELECT name, o_orderstatus AS target, max(o_orderpriority) AS type FROM new_rows GROUP BY 1, 2),
dep_changes AS (SELECT coalesce(o.name, n.name) AS name, string_agg(coalesce(o.target, n.target) || ' ' || CASE WHEN o.type IS NULL THEN 'added' WHEN n.type IS NULL THEN 'removed' ELSE 'retyped' END || ' ' || coalesce(o.type, '') || '>' || coalesce(n.type, ''), ',' ORDER BY coalesce(o.target, n.target)) AS deps FROM old_deps o FULL JOIN new_deps n ON o.name = n.name AND o.target = n.target WHERE o.type IS DISTINCT FROM n.type GROUP BY 1)"""


def _snapshots(s, d):
    o = table(s, d, "orders").withColumn("early", F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))

    def snap(rows):
        deps = rows.groupBy(F.col("o_custkey").alias("name"), F.col("o_orderstatus").alias("target")).agg(F.max("o_orderpriority").alias("type"))
        deps = deps.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("target", "type"))).alias("deps"))
        file = F.concat(F.lit("f"), (F.count(F.lit(1)) % 3).cast("string"))
        g = rows.groupBy(F.col("o_custkey").alias("name")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("interfaces"), F.sort_array(F.collect_set(F.year("o_orderdate").cast("string"))).alias("attributes"), F.when(F.count(F.lit(1)) >= 10, "high").otherwise("low").alias("risk"), file.alias("file"))
        return g.join(deps, "name").withColumn("hash", diff.structural_hash(F.col("deps"), F.col("interfaces"), F.col("attributes")))

    return snap(o.filter("early AND o_custkey % 10 <> 3")), snap(o.filter("o_custkey % 10 <> 4"))


@query("G1_diff_names", f"WITH {SNAP} SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'common' END AS change FROM old o FULL JOIN new n ON o.name = n.name")
def _(s, d):
    return diff.diff_names(*_snapshots(s, d))


@query("G4_diff_classes", f"""WITH {SNAP}, j AS (SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'modified' END AS change,
CASE WHEN o.name IS NULL OR n.name IS NULL THEN '' ELSE array_to_string(list_filter(n.i, lambda x: NOT list_contains(o.i, x)), ',') END AS interfaces_added,
CASE WHEN o.name IS NULL OR n.name IS NULL THEN '' ELSE array_to_string(list_filter(o.i, lambda x: NOT list_contains(n.i, x)), ',') END AS interfaces_removed,
CASE WHEN o.name IS NULL OR n.name IS NULL THEN '' ELSE coalesce(d.deps, '') END AS dep_changes,
CASE WHEN o.risk <> n.risk THEN o.risk || '->' || n.risk END AS risk_change, CASE WHEN o.file <> n.file THEN o.file || '->' || n.file END AS file_change,
coalesce(o.i <> n.i OR o.a <> n.a OR d.deps IS NOT NULL, true) AS other_hash
FROM old o FULL JOIN new n ON o.name = n.name LEFT JOIN dep_changes d ON d.name = coalesce(o.name, n.name))
SELECT name, change, interfaces_added, interfaces_removed, dep_changes, risk_change, file_change FROM j
WHERE change <> 'modified' OR other_hash AND (interfaces_added || interfaces_removed || dep_changes <> '' OR risk_change IS NOT NULL OR file_change IS NOT NULL)""")
def _(s, d):
    out = diff.diff_classes(*_snapshots(s, d))
    deps = F.transform("dep_changes", lambda x: F.concat(x["target"], F.lit(" "), x["change"], F.lit(" "), F.coalesce(x["old_type"], F.lit("")), F.lit(">"), F.coalesce(x["new_type"], F.lit(""))))
    return out.withColumns({c: joined(c) for c in ("interfaces_added", "interfaces_removed")}).withColumn("dep_changes", F.array_join(deps, ","))


DEPMAP = "dm AS (SELECT src AS name, dst AS target, type FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY pos DESC, type DESC) AS r FROM edges) WHERE r = 1)"


@query("G9_dep_map", f"WITH {EDGES}, {DEPMAP} SELECT * FROM dm")
def _(s, d):
    return diff.dep_map(supply_edges(s, d).select(F.col("src").alias("name"), F.col("dst").alias("target"), "type", "pos"))


@query("D9_diff_deps", f"WITH {EDGES}, {DEPMAP}, o AS (SELECT name, target, CASE WHEN target LIKE '%7' THEN 'inheritance' ELSE type END AS type FROM dm WHERE target NOT LIKE '%3'), n AS (SELECT * FROM dm WHERE target NOT LIKE '%4') SELECT coalesce(o.name, n.name) AS name, coalesce(o.target, n.target) AS target, CASE WHEN o.type IS NULL THEN 'added' WHEN n.type IS NULL THEN 'removed' ELSE 'retyped' END AS change, o.type AS old_type, n.type AS new_type FROM o FULL JOIN n ON o.name = n.name AND o.target = n.target WHERE o.type IS DISTINCT FROM n.type")
def _(s, d):
    m = diff.dep_map(supply_edges(s, d).select(F.col("src").alias("name"), F.col("dst").alias("target"), "type", "pos"))
    old = m.filter("target NOT LIKE '%3'").withColumn("type", F.when(F.col("target").endswith("7"), "inheritance").otherwise(F.col("type")))
    return diff.diff_deps(old, m.filter("target NOT LIKE '%4'"))


@query("G5_diff_modules", "WITH o AS (SELECT n_regionkey AS module, list_sort(list(n_name)) AS c FROM nation WHERE n_nationkey % 4 <> 0 AND n_regionkey <> 1 GROUP BY 1), n AS (SELECT n_regionkey AS module, list_sort(list(n_name)) AS c FROM nation WHERE n_nationkey % 5 <> 0 AND n_regionkey <> 2 GROUP BY 1) SELECT coalesce(o.module, n.module) AS module, CASE WHEN o.c IS NULL THEN 'added' WHEN n.c IS NULL THEN 'removed' ELSE 'modified' END AS change, CASE WHEN o.c IS NULL OR n.c IS NULL THEN '' ELSE array_to_string(list_filter(n.c, lambda x: NOT list_contains(o.c, x)), ',') END AS classes_added, CASE WHEN o.c IS NULL OR n.c IS NULL THEN '' ELSE array_to_string(list_filter(o.c, lambda x: NOT list_contains(n.c, x)), ',') END AS classes_removed FROM o FULL JOIN n ON o.module = n.module WHERE o.c IS DISTINCT FROM n.c")
def _(s, d):
    n = table(s, d, "nation")
    group = lambda rows: rows.groupBy(F.col("n_regionkey").alias("module")).agg(F.sort_array(F.collect_list("n_name")).alias("class_names"))
    out = diff.diff_modules(group(n.filter("n_nationkey % 4 <> 0 AND n_regionkey <> 1")), group(n.filter("n_nationkey % 5 <> 0 AND n_regionkey <> 2")))
    return out.withColumns({c: joined(c) for c in ("classes_added", "classes_removed")})


@query("G7_change_record")
def _(s, d):
    old, new = _snapshots(s, d)
    text_name = lambda df: df.withColumn("name", F.concat(F.lit("C"), "name"))
    classes = text_name(diff.diff_classes(old, new))
    n = table(s, d, "nation").groupBy(F.col("n_regionkey").cast("string").alias("module")).agg(F.sort_array(F.collect_list("n_name")).alias("class_names"))
    out = diff.change_record({"commit": "head"}, classes, diff.diff_modules(n, n.filter("module <> '1'")), layered_edges(s, d))
    return out.withColumns({c: joined(c) for c, t in out.dtypes if t.startswith("array")})


# --- H: traversal ---------------------------------------------------------


@query("H1_impact_bounded", f"WITH RECURSIVE {LAYERS}, r AS (SELECT 'P1' AS name, 0 AS hop UNION SELECT l.src, r.hop + 1 FROM r JOIN layers l ON l.dst = r.name WHERE r.hop < 3), m AS (SELECT name, min(hop) AS hop FROM r GROUP BY 1) SELECT name, hop, CASE WHEN hop = 1 THEN 'direct' ELSE 'indirect' END AS kind FROM m WHERE hop > 0")
def _(s, d):
    return graph.impact(s.createDataFrame([("P1",)], "name string"), layered_edges(s, d), 3)


@query("H2_impact", f"WITH RECURSIVE {LAYERS}, r AS (SELECT 'P1' AS name, 0 AS hop UNION SELECT l.src, r.hop + 1 FROM r JOIN layers l ON l.dst = r.name), m AS (SELECT name, min(hop) AS hop FROM r GROUP BY 1) SELECT name, hop, CASE WHEN hop = 1 THEN 'direct' ELSE 'indirect' END AS kind FROM m WHERE hop > 0")
def _(s, d):
    return graph.impact(s.createDataFrame([("P1",)], "name string"), layered_edges(s, d), None)


@query("H3_neighbourhood", f"WITH RECURSIVE {LAYERS}, b AS (SELECT src, dst FROM layers UNION SELECT dst, src FROM layers), r AS (SELECT 'N1' AS name, 0 AS hop UNION SELECT b.dst, r.hop + 1 FROM r JOIN b ON b.src = r.name WHERE r.hop < 2) SELECT name, min(hop) AS hop FROM r GROUP BY 1")
def _(s, d):
    return graph.neighbourhood(s.createDataFrame([("N1",)], "name string"), layered_edges(s, d), 2)


CALLS = f"{STEPS}, calls AS (SELECT DISTINCT class AS src, owner AS dst FROM resolved WHERE kind = 'call')"


def _calls(s, d):
    return graph.resolved(call_steps(s, d)).filter("kind = 'call'").select(F.col("class").alias("src"), F.col("target").alias("dst")).distinct()


@query("H4_call_tree", f"WITH RECURSIVE {CALLS}, t AS (SELECT 'U1' AS node, ['U1'] AS path, 0 AS depth, false AS repeat UNION ALL SELECT c.dst, list_append(t.path, c.dst), t.depth + 1, list_contains(t.path, c.dst) FROM t JOIN calls c ON c.src = t.node WHERE NOT t.repeat AND t.depth < 4) SELECT array_to_string(path, '>') AS path, depth, repeat FROM t")
def _(s, d):
    out = graph.call_paths(s.createDataFrame([("U1",)], "root string"), _calls(s, d), 4)
    return out.select(F.array_join("path", ">").alias("path"), "depth", "repeat")


@query("H5_caller_tree", f"WITH RECURSIVE {CALLS}, t AS (SELECT 'U1' AS node, ['U1'] AS path, 0 AS depth, false AS repeat UNION ALL SELECT c.src, list_append(t.path, c.src), t.depth + 1, list_contains(t.path, c.src) FROM t JOIN calls c ON c.dst = t.node WHERE NOT t.repeat AND t.depth < 3) SELECT array_to_string(path, '<') AS path, depth, repeat FROM t")
def _(s, d):
    back = _calls(s, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    out = graph.call_paths(s.createDataFrame([("U1",)], "root string"), back, 3)
    return out.select(F.array_join("path", "<").alias("path"), "depth", "repeat")


def _placed_calls(s, d):
    return call_steps(s, d).filter("kind = 'call' AND target <> '_self_'").select(F.col("class").alias("src"), F.col("target").alias("dst"), F.col("step").alias("pos"))


@query("H6_flow")
def _(s, d):
    found = flows.flow("U1", _placed_calls(s, d))
    return s.createDataFrame(list(enumerate(found)), "place long, name string")


@query("H7_key_flows")
def _(s, d):
    n, calls = callers(s, d), _placed_calls(s, d)
    entries = grouping.entry_points(n, calls.select("src", "dst").distinct())
    found = flows.key_flows(flows.ranked_starts(entries, n), calls, grouping.with_module(n))
    return s.createDataFrame([(i, " ".join(f)) for i, f in enumerate(found)], "place long, flow string")


@query("H10_suggestions")
def _(s, d):
    n, e = nodes(s, d), supply_edges(s, d)
    m = grouping.with_module(n)
    return flows.suggestions(n.filter("ord < 5").select("name"), m, grouping.module_edges(m, e), grouping.entry_points(n, e), e, 6)


@query("H11_caller_index", f"WITH {STEPS} SELECT owner || '::' || member AS callee, string_agg(class || '::' || method, ',' ORDER BY class || '::' || method) AS callers FROM resolved WHERE kind = 'call' GROUP BY 1")
def _(s, d):
    return graph.caller_index(call_steps(s, d)).withColumn("callers", joined("callers"))


@query("H13_field_accessors", f"WITH {STEPS} SELECT owner || '::' || member AS field, coalesce(string_agg(DISTINCT class || '::run', ',' ORDER BY class || '::run') FILTER (WHERE NOT is_write), '') AS readers, coalesce(string_agg(DISTINCT class || '::run', ',' ORDER BY class || '::run') FILTER (WHERE is_write), '') AS writers FROM resolved WHERE kind = 'field' GROUP BY 1")
def _(s, d):
    return graph.field_accessors(call_steps(s, d)).withColumns({c: joined(c) for c in ("readers", "writers")})


@query("H14_type_usage", f"WITH {EDGES} SELECT dst AS name, count(*) FILTER (WHERE type IN ('composition', 'aggregation')) AS as_field, count(*) FILTER (WHERE type = 'association') AS as_param, count(*) FILTER (WHERE type = 'inheritance') AS as_base, count(*) FILTER (WHERE type = 'dependency') AS as_local FROM edges GROUP BY 1")
def _(s, d):
    return graph.type_usage(supply_edges(s, d))


@query("X13_truncated_steps", f"WITH {STEPS} SELECT class, method, step, target, member FROM steps WHERE step <= 40 UNION ALL SELECT class, method, 41, '_meta_', 'truncated' FROM steps WHERE step = 40")
def _(s, d):
    return graph.truncated_steps(call_steps(s, d), 40)


@query("J22_explain_chain", f"WITH {STEPS} SELECT class, step, CASE WHEN target = '_self_' THEN CASE WHEN is_write THEN 'writes field `' ELSE 'reads field `' END || member || '`' ELSE CASE WHEN kind = 'call' THEN 'calls `' WHEN is_write THEN 'writes `' ELSE 'reads `' END || target || '::' || member || '`' END AS said FROM steps")
def _(s, d):
    c = call_steps(s, d)
    return c.select("class", F.col("step").cast("long").alias("step"), naming.explain_step(F.col("target"), F.col("member"), F.col("kind"), F.col("is_write")).alias("said"))


# --- I: retrieval ---------------------------------------------------------

TOKENS = r"list_filter(regexp_extract_all(lower(text), '[一-鿿぀-ヿ]|[\p{L}\p{N}\p{M}_]{2,}'), lambda x: x <> '')"
TFIDF = """grams AS (SELECT doc, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM toks),
counts AS (SELECT doc, term, count(*) AS n FROM grams GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df, sum(n) AS total FROM counts GROUP BY 1 ORDER BY total DESC, term LIMIT 50000),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM toks)) / (1 + df)) + 1 AS idf FROM df),
w AS (SELECT doc, term, (1 + ln(n)) * idf AS w FROM counts JOIN idf USING (term)),
postings AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM w)"""
ASCII_DOCS = f"toks AS (SELECT doc_id AS doc, {TOKENS} AS t FROM documents)"


def _index(s, d):
    return text.build_index(table(s, d, "documents").select(F.col("doc_id").alias("doc"), "text"))


SEARCH = f"""WITH {ASCII_DOCS}, {TFIDF},
qt AS (SELECT item_id AS query, {TOKENS} AS t FROM benchmark),
qg AS (SELECT query, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM qt),
qc AS (SELECT query, term, count(*) AS n FROM qg GROUP BY 1, 2),
qw AS (SELECT query, term, (1 + ln(n)) * idf AS w FROM qc JOIN idf USING (term)),
q AS (SELECT query, term, w / sqrt(sum(w * w) OVER (PARTITION BY query)) AS wq FROM qw),
sc AS (SELECT query, doc, round(sum(w * wq), 6) AS score FROM postings JOIN q USING (term) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc)"""


@query("I5_search", SEARCH + " SELECT query, doc, score, rank FROM ranked WHERE rank <= 5 AND score > 0")
def _(s, d):
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    return text.search(_index(s, d), q, 5)


@query("I3_tokens", f"SELECT doc_id, len({TOKENS}) AS n, md5(array_to_string({TOKENS}, ' ')) AS digest FROM documents")
def _(s, d):
    t = text.tokenized(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest"))


@query("F7_top_terms", f"WITH {ASCII_DOCS}, {TFIDF} SELECT doc, term, rank FROM (SELECT doc, term, row_number() OVER (PARTITION BY doc ORDER BY round(w, 9) DESC, term) AS rank FROM postings) WHERE rank <= 3")
def _(s, d):
    return text.top_terms(_index(s, d), 3)


@query("I13_hit_rate", SEARCH + ", truth AS (SELECT item_id AS query, min(doc_id) AS expected FROM benchmark JOIN documents ON contains(documents.text, benchmark.text) GROUP BY 1) SELECT count(*) AS queries, round(avg(CASE WHEN r.rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN r.rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top3 FROM truth t LEFT JOIN ranked r ON r.query = t.query AND r.doc = t.expected AND r.rank <= 5")
def _(s, d):
    b, docs = table(s, d, "benchmark"), table(s, d, "documents")
    found = contain.containing_passages(b.select("item_id", F.col("text").alias("needle")), docs.select("doc_id", F.col("text").alias("hay")))
    truth = found.groupBy(F.col("item_id").alias("query")).agg(F.min("doc_id").alias("expected"))
    q = b.select(F.col("item_id").alias("query"), "text")
    return text.hit_rate(text.search(_index(s, d), q, 5), truth)


@query("I8_relevance", "SELECT p_partkey, round(len(list_filter(['ring', 'bolt', 'gear', 'new'], lambda q: contains(p_name, q))) / 4.0, 6) AS score FROM part WHERE len(list_filter(['ring', 'bolt', 'gear', 'new'], lambda q: contains(p_name, q))) > 0")
def _(s, d):
    q = naming.tokens(F.lit("Ring Bolt,Gear ringNew"))
    own = naming.tokens(F.col("p_name"))
    hit = F.size(F.filter(q, lambda t: F.exists(own, lambda e: e.contains(t) | t.contains(e))))
    p = table(s, d, "part").select("p_partkey", F.round(hit / F.size(q), 6).alias("score"))
    return p.filter("score > 0")


# --- J, X: names, labels, traces, rendering -------------------------------

NAMES = "names AS (SELECT DISTINCT replace(p_type, ' ', '') AS raw, p_size FROM part), camel AS (SELECT p_size, raw, 'Disk' || CASE p_size % 5 WHEN 0 THEN 'Manager' WHEN 1 THEN 'Factory' WHEN 2 THEN 'Observer' WHEN 3 THEN 'Thing' ELSE 'BufferPool' END AS name FROM (SELECT DISTINCT p_size, '' AS raw FROM names))"


def _names(s, d):
    k = F.col("p_size") % 5
    name = F.concat(F.lit("Disk"), F.when(k == 0, "Manager").when(k == 1, "Factory").when(k == 2, "Observer").when(k == 3, "Thing").otherwise("BufferPool"))
    return table(s, d, "part").select("p_size").distinct().withColumn("name", name)


@query("J12_J15_labels", f"WITH {NAMES} SELECT p_size, name, CASE p_size % 5 WHEN 0 THEN 'Manages disk' WHEN 1 THEN 'Creates disk instances' WHEN 2 THEN 'Observes disk changes' WHEN 3 THEN 'Handles disk thing operations' ELSE 'Pools disk buffer resources' END AS intent, CASE p_size % 5 WHEN 1 THEN 'Factory' WHEN 2 THEN 'Observer' END AS pattern, CASE p_size % 5 WHEN 0 THEN 'Disk,Manager' WHEN 1 THEN 'Disk,Factory' WHEN 2 THEN 'Disk,Observer' WHEN 3 THEN 'Disk,Thing' ELSE 'Disk,Buffer,Pool' END AS words, CASE p_size % 5 WHEN 0 THEN 'Resource Lifecycle' WHEN 1 THEN 'Object Creation' WHEN 2 THEN 'Event Observation' WHEN 3 THEN 'Manages DiskThing operations' ELSE 'Resource Pooling' END AS responsibility FROM camel")
def _(s, d):
    n = F.col("name")
    none = F.array().cast("array<string>")
    return _names(s, d).select("p_size", "name", naming.intent(n, F.lit("")).alias("intent"), naming.design_pattern(n).alias("pattern"), joined(naming.split_camel(n)).alias("words"), extraction.responsibility(F.lit(None).cast("string"), n, none).alias("responsibility"))


@query("J13_J14_tradeoffs", f"WITH {EDGES}, {NODES}, g AS (SELECT n.name, (SELECT count(DISTINCT src) FROM edges WHERE dst = n.name) AS i, (SELECT count(*) FROM edges WHERE src = n.name) AS o, (SELECT count(*) FROM edges WHERE src = n.name AND type = 'aggregation') AS a FROM nodes n) SELECT name, CASE WHEN i >= 5 THEN 'high' WHEN i >= 2 THEN 'medium' ELSE 'low' END AS risk, concat_ws('|', CASE WHEN a > 0 THEN 'Shared ownership (' || a || ' shared_ptr/weak_ptr dep' || CASE WHEN a > 1 THEN 's' ELSE '' END || ') may cause lifecycle ambiguity' END, CASE WHEN o > 8 THEN 'High fan-out (' || o || ' dependencies) — potential god-class, consider decomposing' END, CASE WHEN i = 0 AND o > 0 THEN 'Root node — not depended on by others; changes here propagate downward widely' END, CASE WHEN i >= 5 THEN 'High fan-in (' || i || ' dependents) — changes here have wide blast radius' END) AS remarks FROM g")
def _(s, d):
    n, e = nodes(s, d), supply_edges(s, d)
    agg = e.filter("type = 'aggregation'").groupBy(F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("a"))
    g = graph.degrees(n, e).join(agg, "name", "left").withColumn("a", F.coalesce("a", F.lit(0)))
    return g.select("name", naming.change_risk(F.col("in_degree")).alias("risk"), F.array_join(naming.tradeoffs(F.col("a"), F.col("out_degree"), F.col("in_degree"), F.lit(0)), "|").alias("remarks"))


@query("J1_J2_J3_names", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g') AS safe, split_part(url, '/', 3) AS class, 'get(int ' || page_id || ', char b' || CASE WHEN page_id % 2 = 0 THEN ', ...' ELSE '' END || ')' AS label FROM pages")
def _(s, d):
    p = table(s, d, "pages")
    host = F.split_part("url", F.lit("/"), F.lit(3))
    sig = F.concat(F.lit(" std::string  get (int "), "page_id", F.lit(" ,char b"), F.when(F.col("page_id") % 2 == 0, ", x").otherwise(""), F.lit(")"))
    return p.select("page_id", naming.sanitize_id(F.col("url")).alias("safe"), naming.class_of(F.concat(host, F.lit("::m"))).alias("class"), naming.method_label(sig).alias("label"))


@query("J5_adjacent", "SELECT conv_id AS \"group\", turn AS pos, src, role AS dst FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS src FROM conversations) WHERE src IS NOT NULL")
def _(s, d):
    return trace.adjacent(table(s, d, "conversations"), "conv_id", "turn", "role")


@query("J4_J5_backtrace", f"WITH {STEPS}, f AS (SELECT class AS trace, step, 'N' || target || '::' || member AS n FROM steps) SELECT trace, -(step - 1) AS pos, lead_n AS caller, n AS callee, 'a=' || step AS args FROM (SELECT *, lead(n) OVER (PARTITION BY trace ORDER BY step) AS lead_n FROM f) WHERE lead_n IS NOT NULL")
def _(s, d):
    c = call_steps(s, d)
    line = F.concat(F.lit("#"), (F.col("step") - 1).cast("string"), F.lit("  0x1f in N"), "target", F.lit("::"), "member", F.lit(" (this=0x2, a="), F.col("step").cast("string"), F.lit(") at a/b.cpp:5"))
    texts = c.groupBy(F.col("class").alias("trace")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return trace.call_edges(trace.frames(texts)).withColumn("pos", F.col("pos").cast("long"))


@query("J7_sequence", "WITH a AS (SELECT conv_id, turn AS pos, src, role AS dst FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS src FROM conversations) WHERE src IS NOT NULL), p AS (SELECT conv_id, n, min(p) AS p FROM (SELECT conv_id, src AS n, pos * 2 AS p FROM a UNION ALL SELECT conv_id, dst, pos * 2 + 1 FROM a) GROUP BY 1, 2), w AS (SELECT conv_id, string_agg('    participant ' || n, chr(10) ORDER BY p) AS who FROM p GROUP BY 1), b AS (SELECT conv_id, string_agg('    ' || src || '->>+' || dst || ': ' || dst || '(' || pos || ')' || chr(10) || '    ' || dst || '-->>-' || src || ': return', chr(10) ORDER BY pos) AS body FROM a GROUP BY 1) SELECT conv_id AS \"group\", 'sequenceDiagram' || chr(10) || who || chr(10) || chr(10) || body AS value FROM w JOIN b USING (conv_id)")
def _(s, d):
    a = trace.adjacent(table(s, d, "conversations"), "conv_id", "turn", "role")
    return render.sequence_lines(a.select("group", "pos", F.col("src").alias("caller"), F.col("dst").alias("callee"), F.col("pos").cast("string").alias("args")))


@query("J8_relations", f"WITH {EDGES}, {NODES} SELECT DISTINCT src, '    ' || src || ' ' || CASE type WHEN 'composition' THEN '*--' WHEN 'aggregation' THEN 'o--' WHEN 'association' THEN '-->' ELSE '..>' END || ' ' || dst || ' : ' || type AS line FROM edges WHERE src IN (SELECT name FROM nodes) AND dst IN (SELECT name FROM nodes)")
def _(s, d):
    return render.relations(supply_edges(s, d), nodes(s, d))


@query("J8_class_blocks", "SELECT 'R' || r_regionkey AS name, '    class R' || r_regionkey || ' {' || chr(10) || string_agg('        ' || n_name, chr(10) ORDER BY n_name) FILTER (WHERE k <= 3) || chr(10) || '        ... ' || (count(*) - 3) || ' more fields' || chr(10) || '        +get(int)' || chr(10) || '    }' || chr(10) || '    note for R' || r_regionkey || ' \"ns: ' || any_value(r_name) || '\"' AS block FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY r_regionkey")
def _(s, d):
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = n.groupBy(F.concat(F.lit("R"), "r_regionkey").alias("name"), F.col("r_name").alias("namespace")).agg(F.sort_array(F.collect_list("n_name")).alias("attributes")).withColumn("methods", F.array(F.lit("int get(int)")))
    return render.class_blocks(c, max_attributes=3)


@query("J25_module_graph", f"WITH {EDGES}, {NODES}, {MEMBERS}, {MODULE_EDGES}, top AS (SELECT * FROM module_edges ORDER BY weight DESC, source, target LIMIT 20) SELECT 'graph LR' || chr(10) || string_agg('    ' || regexp_replace(source, '[^A-Za-z0-9_]', '_', 'g') || ' -->|' || weight || '| ' || regexp_replace(target, '[^A-Za-z0-9_]', '_', 'g'), chr(10) ORDER BY weight DESC, source, target) AS value FROM top")
def _(s, d):
    return render.module_graph(_module_edges(s, d))


@query("J9_J10_state_machines")
def _(s, d):
    source = F.lit("enum class St { Idle, Run, Done };\nvoid f() { switch (st) { case St::Idle: st = St::Run; break; case St::Run: st = St::Done; break; } }")
    files = table(s, d, "nation").select(F.col("n_name").alias("file"), source.alias("text"))
    return render.state_diagram(trace.state_machines(files))


@query("J17_structural_hash")
def _(s, d):
    g = table(s, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("i"))
    return g.select("o_custkey", diff.structural_hash(F.array(F.struct(F.lit("t").alias("target"), F.lit("d").alias("type"))), F.col("i")).alias("hash"))


@query("J20_method_role", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Parser / Decoder' WHEN 1 THEN 'Data Accessor' END AS role FROM part")
def _(s, d):
    k = F.col("p_size") % 3
    names = F.when(k == 0, F.array(F.lit("parseit"), F.lit("decode"), F.lit("x"))).when(k == 1, F.array(F.lit("getx"), F.lit("sety"))).otherwise(F.array(F.lit("zap"), F.lit("zip")))
    return table(s, d, "part").select("p_partkey", naming.method_role(names).alias("role"))


TYPES = "CASE p_size % 7 WHEN 0 THEN 'std::unique_ptr<Disk>' WHEN 1 THEN 'std::shared_ptr<const Disk>' WHEN 2 THEN 'std::vector<Disk*>' WHEN 3 THEN 'std::map<int, Disk>' WHEN 4 THEN 'const Disk &' WHEN 5 THEN 'int' ELSE 'std::shared_ptr<Disk>' END"


@query("X2_X3_X9_field_types", "SELECT p_partkey, CASE WHEN p_size % 7 NOT IN (1, 5) THEN 'Disk' END AS target, CASE WHEN p_size % 7 = 0 THEN 'composition' WHEN p_size % 7 NOT IN (1, 5) THEN 'aggregation' END AS type, CASE WHEN p_size % 7 IN (2, 3) THEN '1..*' END AS cardinality FROM part")
def _(s, d):
    p = table(s, d, "part").select("p_partkey", F.expr(TYPES).alias("t"))
    dep = extraction.field_dependency(F.col("t"))
    return p.select("p_partkey", dep["target"].alias("target"), dep["type"].alias("type"), dep["cardinality"].alias("cardinality"))


@query("X19_free_functions", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Utility Helpers' WHEN 1 THEN 'Data Transformation' WHEN 2 THEN 'Test Support' ELSE 'Free Functions' END AS bucket FROM part")
def _(s, d):
    k = F.col("p_size") % 4
    name = F.when(k == 0, "util").when(k == 1, "codec").when(k == 2, "mock").otherwise("zzz")
    return table(s, d, "part").select("p_partkey", extraction.free_function_group(name, F.array(F.lit("void f()"))).alias("bucket"))


@query("A4_A5_compiler_arguments", "SELECT p_partkey, '-Wall,-DX=' || p_size AS arguments FROM part")
def _(s, d):
    args = F.array(F.lit("g++"), F.lit("-Wall"), F.lit("-o"), F.lit("-x"), F.lit("a.cpp"), F.lit("b.o"), F.lit("-fvar-tracking-assignments"), F.concat(F.lit("-DX="), "p_size"))
    return table(s, d, "part").select("p_partkey", joined(extraction.known_flags(extraction.compiler_arguments(args, F.lit("a.cpp")))).alias("arguments"))


NAMES = "CASE p_size % 4 WHEN 0 THEN 'DiskManager' WHEN 1 THEN 'MyBufferPool' WHEN 2 THEN 'EventLoop' ELSE p_brand END"


def _spaced(sql: str) -> str:
    return f"regexp_replace({sql}, '([a-z])([A-Z])', '\\1 \\2', 'g')"


@query("I1_D11_entry_text", f"""WITH p AS (SELECT *, {NAMES} AS n FROM part),
a AS (SELECT *, CASE p_size % 4 WHEN 0 THEN '{text.ALIASES["DiskManager"]}' WHEN 1 THEN '{text.ALIASES["BufferPool"]}' END AS said FROM p)
SELECT p_partkey, concat_ws(' ', n, n, n, n, n, CASE WHEN {_spaced("n")} <> n THEN {_spaced("n")} END, said, regexp_replace(said, '([一-鿿぀-ヿ])', ' \\1 ', 'g'), 'a ' || p_size, p_name, p_type || ' int  x', 'void readBlock  ' || p_type || '   n ', 'read block', 'BaseThing', 'Base Thing', p_name, {_spaced("p_name")}, 'aggregation', 'T') AS text FROM a""")
def _(s, d):
    p = table(s, d, "part").withColumns({
        "name": F.expr(NAMES),
        "namespace": F.concat(F.lit("a::"), "p_size"),
        "responsibility": F.col("p_name"),
        "attributes": F.array(F.concat("p_type", F.lit("<int> x"))),
        "interfaces": F.array(F.concat(F.lit("void readBlock( "), "p_type", F.lit(" & n)"))),
        "bases": F.array(F.lit("BaseThing")),
        "deps": F.array(F.struct(F.col("p_name").alias("target"), F.lit("aggregation").alias("type"))),
        "template_params": F.array(F.lit("T")),
    })
    return p.select("p_partkey", text.entry_text(p).alias("text"))


@query("I7_matched_methods", "SELECT p_partkey, array_to_string(list_filter(['void read' || p_type || '(int n)', 'int size()', 'bool open(Path p)'], lambda m: CASE WHEN m LIKE 'void%' THEN p_size % 3 = 0 WHEN m LIKE 'int%' THEN p_size % 3 = 1 ELSE p_size % 3 <> 2 END), ';') AS methods FROM part")
def _(s, d):
    method = lambda sig, *used: F.struct(sig.alias("signature"), F.array(*map(F.lit, used)).cast("array<string>").alias("used_types"))
    methods = F.array(method(F.concat(F.lit("void read"), "p_type", F.lit("(int n)"))), method(F.lit("int size()")), method(F.lit("bool open(Path p)"), "fs::DiskPath"))
    k = F.col("p_size") % 3
    asked = F.when(k == 0, F.concat(F.lit("Read"), "p_type", F.lit(" on disk"))).when(k == 1, F.lit("size of diskpath")).otherwise(F.lit("nothing here"))
    return table(s, d, "part").select("p_partkey", F.array_join(text.matched_methods(methods, text.tokenized(asked)), ";").alias("methods"))


def _measured(f: Query) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        graph.measure_joins(spark)
        return f(spark, d)

    return run


def queries() -> dict[str, Query]:
    from . import document_queries, index_queries, method_queries, summary_queries, text_queries

    found = _QUERIES | method_queries.QUERIES | index_queries.QUERIES | text_queries.QUERIES | summary_queries.QUERIES | document_queries.QUERIES
    return {name: _measured(f) for name, f in found.items()}


def oracle_sql() -> dict[str, str]:
    from . import document_queries, index_queries, method_queries, summary_queries, text_queries

    return _SQL | method_queries.SQL | index_queries.SQL | text_queries.SQL | summary_queries.SQL | document_queries.SQL
