"""Queries over methods: call trees, callers, accessors, usages, focal chains and flows of parts that are made of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import flows, grouping, methods
from .operators.graph import keep
from .plans import adapters
from .queries import ENTRIES

ASSEMBLY = r"""parts AS (
  SELECT p_partkey AS k, p_size AS z, replace(lower(p_brand), '#', '_') AS brand,
         CASE WHEN p_size % 11 = 0 THEN 'P' || p_partkey ELSE replace(lower(p_brand), '#', '_') || '::P' || p_partkey END AS class FROM part),
classes AS (SELECT class, brand || '/' || k || '.h' AS file, k AS ord FROM parts),
methods AS (
  SELECT class, 'void remake(Part p)' AS signature, CASE WHEN z % 3 = 0 THEN 0 ELSE 3 END AS place, ['Part', 'P' || (k // 4)] AS used_types FROM parts
  UNION ALL SELECT class, 'void make(int n)', 1, [] FROM parts UNION ALL SELECT class, 'int cost() const', 2, [] FROM parts
  UNION ALL SELECT class, 'void make(long n)', 4, [] FROM parts WHERE z % 5 = 0 UNION ALL SELECT class, 'void check(int n)', 5, [] FROM parts),
raw_steps AS (
  SELECT class, z, 'void make(int n)' AS signature, 1 AS step, k // 4 AS other, NULL AS target, 'make' AS member, 'call' AS kind, NULL::BOOLEAN AS is_write FROM parts WHERE k // 4 >= 1
  UNION ALL SELECT class, z, 'void make(int n)', 2, k // 6, NULL, 'check', 'call', NULL FROM parts WHERE k // 6 >= 1
  UNION ALL SELECT class, z, 'void make(int n)', 3, NULL, '_self_', 'stock', 'field', z % 4 = 0 FROM parts
  UNION ALL SELECT class, z, 'void make(int n)', 4, k // 4, NULL, 'price', 'field', false FROM parts WHERE k // 4 >= 1
  UNION ALL SELECT class, z, 'void make(int n)', 5, NULL, '_self_', 'cost', 'call', NULL FROM parts
  UNION ALL SELECT class, z, 'void make(int n)', 6, 4 * k + 1, NULL, 'make', 'call', NULL FROM parts WHERE z % 10 = 0
  UNION ALL SELECT class, z, 'int cost() const', 1, NULL, '_self_', 'price', 'field', false FROM parts
  UNION ALL SELECT class, z, 'void check(int n)', 1, k // 5, NULL, 'remake', 'call', NULL FROM parts WHERE k // 5 >= 1
  UNION ALL SELECT class, z, 'void check(int n)', 2, NULL, '_self_', 'make', 'call', NULL FROM parts WHERE z % 7 = 0),
steps AS (
  SELECT s.class, s.signature, s.step, coalesce(s.target, CASE WHEN s.z % 2 = 0 AND o.class IS NOT NULL THEN o.class ELSE 'P' || s.other END) AS target, s.member, s.kind, s.is_write, s.step * 3 + 1 AS line
  FROM raw_steps s LEFT JOIN parts o ON o.k = s.other),
named AS (SELECT class, signature, place, regexp_extract(signature, '\b([a-zA-Z_~]\w*)\s*\(', 1) AS name FROM methods)"""
CALLED = """owners AS (
  SELECT key, class, file FROM (SELECT class AS key, 0 AS rank, * FROM classes UNION ALL SELECT split_part(class, '::', -1), 1, * FROM classes) QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank, ord) = 1),
bodies AS (SELECT class, name, arg_min(signature, place) AS signature FROM (SELECT class, name, signature, place FROM named UNION SELECT class, signature, signature, place FROM named) GROUP BY 1, 2),
called AS (SELECT b.class AS owner, b.name AS method, s.* EXCLUDE (class, signature) FROM bodies b JOIN steps s ON s.class = b.class AND s.signature = b.signature)"""


def callers_sql(kind: str) -> str:
    return f"""refs AS (
  SELECT CASE WHEN target = '_self_' THEN split_part(s.class, '::', -1) ELSE target END || '::' || member AS key, s.class, s.signature, n.name, s.line, c.file, coalesce(s.is_write, false) AS is_write, c.ord, n.place, s.step
  FROM steps s JOIN named n ON n.class = s.class AND n.signature = s.signature JOIN classes c ON c.class = s.class WHERE kind = '{kind}')"""


def _assembly(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return adapters.assembly_classes(s, d), adapters.assembly_methods(s, d), adapters.assembly_steps(s, d)


def _made(s: SparkSession, d: str) -> DataFrame:
    return adapters.assembly_classes(s, d).select(F.col("class").alias("root_class"), F.lit("make").alias("root_method"))


def _path() -> Column:
    return F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path")


def call_tree(s, d):
    out = methods.call_tree(_made(s, d), *_assembly(s, d))
    return out.select("root_class", _path(), "depth", "class", "method", "kind", "is_write", "line", "file")


CALL_TREE = f"""WITH RECURSIVE {ASSEMBLY}, {CALLED},
t AS (
  SELECT class AS root_class, '' AS path, 0 AS depth, class, 'make' AS method, 'call' AS kind, NULL::BOOLEAN AS is_write, NULL::INTEGER AS line, CAST([] AS VARCHAR[]) AS seen FROM classes
  UNION ALL
  SELECT t.root_class, CASE WHEN t.path = '' THEN '' ELSE t.path || '.' END || c.step, t.depth + 1, CASE WHEN c.target = '_self_' THEN t.class ELSE c.target END, c.member, c.kind, c.is_write, c.line, list_append(t.seen, t.class || '::' || t.method)
  FROM t JOIN owners o ON o.key = t.class JOIN called c ON c.owner = o.class AND c.method = t.method
  WHERE t.kind <> 'field' AND t.depth < 10 AND NOT list_contains(t.seen, t.class || '::' || t.method))
SELECT t.root_class, t.path, t.depth, t.class, t.method, t.kind, t.is_write, t.line, o.file FROM t LEFT JOIN owners o ON o.key = t.class"""


def caller_tree(s, d):
    out = methods.caller_tree(_made(s, d), *_assembly(s, d))
    return out.select("root_class", _path(), "depth", "class", "method", "line", "file")


CALLER_TREE = f"""WITH RECURSIVE {ASSEMBLY}, {callers_sql('call')},
idx AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord, class, place, step) AS nth FROM refs),
keys AS (SELECT DISTINCT key FROM idx),
t AS (
  SELECT class AS root_class, '' AS path, -1 AS depth, class, 'make' AS name, '' AS method, NULL::INTEGER AS line, '' AS file, CAST([] AS VARCHAR[]) AS seen, false AS repeat FROM classes
  UNION ALL
  SELECT t.root_class, CASE WHEN t.path = '' THEN '' ELSE t.path || '.' END || i.nth, t.depth + 1, i.class, i.name, i.signature, i.line, i.file, list_append(t.seen, i.class || '::' || i.name), list_contains(t.seen, i.class || '::' || i.name)
  FROM t LEFT JOIN keys k ON k.key = t.class || '::' || t.name JOIN idx i ON i.key = coalesce(k.key, split_part(t.class, '::', -1) || '::' || t.name)
  WHERE NOT t.repeat AND t.depth < 5)
SELECT root_class, path, depth, class, method, line, file FROM t WHERE depth >= 0"""


def field_accessors(s, d):
    asked = adapters.assembly_classes(s, d).select("class", F.explode(F.array(F.lit("price"), F.lit("stock"))).alias("field"))
    return methods.field_accessors(asked, *_assembly(s, d))


ACCESSORS = f"""WITH {ASSEMBLY}, {callers_sql('field')},
asked AS (SELECT class, unnest(['price', 'stock']) AS field FROM classes),
keyed AS (SELECT a.*, CASE WHEN EXISTS (SELECT 1 FROM refs r WHERE r.key = a.class || '::' || a.field) THEN a.class ELSE split_part(a.class, '::', -1) END || '::' || a.field AS key FROM asked a)
SELECT k.class, k.field, r.class AS accessor, r.signature, r.is_write, r.line, r.file, row_number() OVER (PARTITION BY k.class, k.field ORDER BY r.ord, r.class, r.place, r.step)::INTEGER AS nth
FROM keyed k JOIN refs r ON r.key = k.key"""


def type_usage(s, d):
    classes, held, _ = _assembly(s, d)
    return methods.type_usage(classes.select(F.col("class").alias("type")), adapters.assembly_deps(s, d), held, classes)


USAGE = f"""WITH {ASSEMBLY},
deps AS (
  SELECT class, 'P' || (k // 4) AS target, 'composition' AS dep_type FROM parts WHERE k >= 4 UNION ALL SELECT class, 'P' || (k // 6), 'association' FROM parts WHERE k >= 6
  UNION ALL SELECT class, 'P' || (k // 5), 'inheritance' FROM parts WHERE z % 13 = 0 AND k >= 5 UNION ALL SELECT class, 'P' || (k // 7), 'dependency' FROM parts WHERE z % 3 = 0 AND k >= 7),
hits AS (
  SELECT t.class AS type, CASE d.dep_type WHEN 'association' THEN 'param' WHEN 'composition' THEN 'field' WHEN 'dependency' THEN 'local' ELSE 'inherit' END AS use, d.class, d.dep_type, NULL AS signature
  FROM classes t JOIN deps d ON d.target IN (t.class, split_part(t.class, '::', -1))
  UNION ALL
  SELECT t.class, 'param', m.class, 'association', m.signature FROM (SELECT DISTINCT class, signature, unnest(used_types) AS used FROM methods) m JOIN classes t ON m.used IN (t.class, split_part(t.class, '::', -1)))
SELECT type, use, h.class, dep_type, signature, c.file FROM hits h JOIN classes c ON c.class = h.class WHERE h.class <> type AND split_part(h.class, '::', -1) <> split_part(type, '::', -1)"""


def focal_chain(s, d):
    classes, held, steps = _assembly(s, d)
    asked = held.filter("is_public").select("class", "signature")
    return methods.focal_chain(asked, held, steps)


CHAIN = f"WITH {ASSEMBLY} SELECT s.* FROM steps s JOIN methods m ON m.class = s.class AND m.signature = s.signature AND m.place < 4 UNION ALL SELECT class, 'int cost() const', 2, '_meta_', 'truncated', 'call', NULL, 7 FROM parts"


def _members(s: SparkSession, d: str) -> DataFrame:
    return adapters.assembly_classes(s, d).select("class", F.col("namespace").alias("module"))


def method_flows(s, d):
    classes, held, steps = _assembly(s, d)
    starts = classes.select(F.col("class").alias("start_class"), F.lit("make").alias("start_method"))
    return methods.flows(starts, classes, held, steps, _members(s, d))


def _class_edges(classes: DataFrame, steps: DataFrame) -> DataFrame:
    """src, dst, type: which class calls which."""
    called = steps.filter("kind = 'call' AND target <> '_self_' AND target <> '_meta_'")
    found = called.join(methods.class_index(classes).select(F.col("key").alias("target"), F.col("class").alias("dst")), "target")
    return keep(found.select(F.col("class").alias("src"), "dst", F.lit("association").alias("type")).distinct())


def exploration_path(s, d):
    classes, _, steps = _assembly(s, d)
    nodes, edges = classes.select(F.col("class").alias("name"), "ord"), _class_edges(classes, steps)
    members = classes.select(F.col("class").alias("name"), "ord", F.col("namespace").alias("module"))
    found = flows.exploration_path(grouping.module_edges(members, edges), grouping.entry_points(nodes, edges), members)
    return s.createDataFrame(list(enumerate(found)), "place long, module string")


PATH = f"""WITH RECURSIVE {ASSEMBLY}, {CALLED},
edges AS (SELECT DISTINCT s.class AS src, o.class AS dst FROM steps s JOIN owners o ON o.key = s.target WHERE s.kind = 'call' AND s.target <> '_self_'),
nodes AS (SELECT class AS name, k AS ord, brand AS module FROM parts),
{ENTRIES},
module_edges AS (SELECT a.module AS source, b.module AS target, count(*) AS weight FROM edges JOIN nodes a ON a.name = src JOIN nodes b ON b.name = dst WHERE a.module <> b.module GROUP BY 1, 2),
begun AS (SELECT module FROM entries JOIN nodes USING (name) ORDER BY CASE kind WHEN 'hub' THEN 1 ELSE 3 END, ord LIMIT 1),
way AS (
  SELECT module, [module] AS path FROM begun
  UNION ALL
  SELECT e.target, list_append(w.path, e.target) FROM way w, LATERAL (SELECT target FROM module_edges m WHERE m.source = w.module AND NOT list_contains(w.path, m.target) ORDER BY weight DESC, target LIMIT 1) e WHERE len(w.path) < 5)
SELECT len(path) - 1 AS place, module FROM way"""


def key_flows(s, d):
    classes, held, steps = _assembly(s, d)
    edges = _class_edges(classes, steps)
    found = keep(grouping.entry_points(classes.withColumnRenamed("class", "name"), edges))
    entries = found.select(F.col("name").alias("class"), "kind", (-F.col("degree")).alias("ord"))
    return methods.key_flows(entries, classes, held, steps, _members(s, d))


def flow_query(s, d):
    """The brands are the queries; their classes match in the order of their numbers."""
    classes, held, steps = _assembly(s, d)
    matches = classes.select(F.col("namespace").alias("query"), "class", F.col("ord").alias("rank"))
    return methods.flow_query(matches, classes, held, steps, _members(s, d))


QUERIES = {
    "H4_method_call_tree": call_tree, "H5_method_caller_tree": caller_tree, "H6_method_flows": method_flows, "H7_method_key_flows": key_flows, "H8_flow_query": flow_query,
    "H13_method_field_accessors": field_accessors, "H14_type_usage_rows": type_usage, "H15_focal_chain": focal_chain, "H9_exploration_path": exploration_path,
}
SQL = {"H4_method_call_tree": CALL_TREE, "H5_method_caller_tree": CALLER_TREE, "H13_method_field_accessors": ACCESSORS, "H14_type_usage_rows": USAGE, "H15_focal_chain": CHAIN, "H9_exploration_path": PATH}
