"""Queries that tell of classes, modules and the project in words."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries as base
from .method_queries import ASSEMBLY
from .operators import grouping, lookups, summaries
from .plans import adapters


def _assembly_entries(s, d):
    classes, methods, deps = adapters.assembly_classes(s, d), adapters.assembly_methods(s, d), adapters.assembly_deps(s, d)
    public, private = (methods.filter(c).groupBy("class").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "signature"))), lambda m: m["signature"]).alias(n)) for c, n in (("is_public", "interfaces"), ("NOT is_public", "private_methods")))
    held = deps.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("target", F.col("dep_type").alias("type")))).alias("deps"))
    rows = classes.join(public, "class").join(private, "class", "left").join(held, "class", "left")
    known = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("Makes "), "namespace")).otherwise("Unknown")
    return rows.select(F.element_at(F.split("class", "::"), -1).alias("name"), "ord", known.alias("responsibility"), F.when(F.col("ord") % 5 == 4, F.slice("interfaces", 2, 1)).otherwise(F.concat("interfaces", "private_methods", "interfaces")).alias("interfaces"), F.when(F.col("ord") % 5 != 4, F.col("private_methods")).alias("private_methods"), F.when(F.col("ord") % 2 == 0, F.array("namespace")).alias("bases"), "deps")


def class_summaries(s, d):
    out = summaries.class_summaries(_assembly_entries(s, d))
    return out.select("name", "intent", *(F.array_join(c, "|").alias(c) for c in ("responsibilities", "used_by", "depends_on")))


CLASS_SUMMARIES = f"""WITH {ASSEMBLY},
deps AS (
  SELECT 'P' || k AS name, k, 'P' || (k // 4) AS target, 'composition' AS type FROM parts WHERE k >= 4 UNION ALL SELECT 'P' || k, k, 'P' || (k // 6), 'association' FROM parts WHERE k >= 6
  UNION ALL SELECT 'P' || k, k, 'P' || (k // 5), 'inheritance' FROM parts WHERE z % 13 = 0 AND k >= 5 UNION ALL SELECT 'P' || k, k, 'P' || (k // 7), 'dependency' FROM parts WHERE z % 3 = 0 AND k >= 7),
users AS (SELECT target, string_agg(name, '|' ORDER BY k) AS used_by FROM (SELECT DISTINCT target, name, k FROM deps WHERE target <> name QUALIFY dense_rank() OVER (PARTITION BY target ORDER BY k) <= 5) GROUP BY 1),
on_them AS (SELECT name, string_agg(target, '|' ORDER BY target, type) AS depends_on, string_agg(target, ', ' ORDER BY target) FILTER (WHERE type = 'composition') AS made_of FROM deps GROUP BY 1),
p AS (
  SELECT *, 'P' || k AS name, CASE WHEN z % 3 = 0 THEN ['remake(Part p)', 'make(int n)', 'cost()'] ELSE ['make(int n)', 'cost()', 'remake(Part p)'] END AS pub, CASE WHEN z % 5 = 0 THEN ['make(long n)', 'check(int n)'] ELSE ['check(int n)'] END AS priv FROM parts),
listed AS (SELECT *, CASE WHEN k % 5 = 4 THEN [pub[2]] ELSE list_concat(pub, priv, pub) END AS i FROM p)
SELECT l.name, CASE WHEN k % 3 = 0 THEN 'Makes ' || brand || CASE WHEN made_of IS NOT NULL THEN ' — manages ' || made_of ELSE '' END WHEN k % 5 = 4 AND z % 3 <> 0 THEN CASE WHEN k % 2 = 0 THEN l.name || ' — extends ' || brand ELSE l.name END ELSE l.name || ' — Factory / Builder' END AS intent,
array_to_string(i[1:6], '|') || CASE WHEN len(i) > 6 THEN '|… and ' || (len(i) - 6) || ' more methods' ELSE '' END AS responsibilities, coalesce(used_by, '') AS used_by, coalesce(depends_on, '') AS depends_on
FROM listed l LEFT JOIN users u ON u.target = l.name LEFT JOIN on_them o ON o.name = l.name"""


def module_summaries(s, d):
    m = base.members(s, d)
    e = adapters.supply_edges(s, d)
    out = summaries.module_summaries(m, e, grouping.module_edges(m, e))
    return out.select("module", "intent", F.array_join("key_classes", "|").alias("key_classes"), F.array_join("interactions", "|").alias("interactions"))


_MODULES = f"{base.EDGES}, {base.NODES}, {base.MEMBERS}, {base.MODULE_EDGES}"
MODULE_SUMMARIES = f"""WITH {_MODULES},
labels AS (SELECT module, string_agg(responsibility, ', ' ORDER BY c DESC, responsibility) AS l FROM (SELECT module, responsibility, count(*) AS c FROM members GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY module ORDER BY c DESC, responsibility) <= 3) GROUP BY 1),
near AS (SELECT source, string_agg('Depends on module "' || target || '" (' || weight || ' connections via ' || replace(dep_types, ',', ', ') || ')', '|' ORDER BY weight DESC, target) AS t FROM (SELECT * FROM module_edges QUALIFY row_number() OVER (PARTITION BY source ORDER BY weight DESC, target) <= 4) GROUP BY 1),
own AS (SELECT module, string_agg(name, '|' ORDER BY name) AS names FROM (SELECT module, name FROM members QUALIFY row_number() OVER (PARTITION BY module ORDER BY name) <= 3) GROUP BY 1)
SELECT o.module, 'Module "' || o.module || '" — ' || l AS intent, names AS key_classes, coalesce(t, '') AS interactions FROM own o JOIN labels USING (module) LEFT JOIN near ON source = o.module"""


def project(s, d):
    n, e = adapters.nodes(s, d), adapters.supply_edges(s, d)
    m = grouping.with_module(n)
    named = m.select("name").filter("name = 'P1'").withColumn("signature", F.lit("int main()"))
    texts = [summaries.project_summary(m, grouping.entry_points(n, e, signatures=named)), summaries.architecture(m, grouping.module_edges(m, e))]
    return texts[0].withColumn("place", F.lit(0)).unionByName(texts[1].withColumn("place", F.lit(1)))


PROJECT = f"""WITH {_MODULES}, sizes AS (SELECT module, count(DISTINCT name) AS n FROM members GROUP BY 1),
top AS (SELECT *, row_number() OVER (ORDER BY n DESC, module) AS r FROM sizes), heavy AS (SELECT * FROM module_edges ORDER BY weight DESC, source, target LIMIT 3)
SELECT 'Project with ' || (SELECT sum(n)::BIGINT FROM sizes) || ' classes across ' || (SELECT count(*) FROM sizes) || ' modules. core modules: ' || (SELECT string_agg(module, ', ' ORDER BY r) FROM top WHERE r <= 4) || '. entry via P1.' AS text, 0 AS place
UNION ALL SELECT 'This project is organized into ' || (SELECT count(*) FROM sizes) || ' modules. The largest modules are: ' || (SELECT string_agg(module || ' (' || n || ' classes)', ', ' ORDER BY r) FROM top WHERE r <= 5) || '. Key inter-module connections: '
  || (SELECT string_agg(source || ' → ' || target || ' (' || weight || ')', ', ' ORDER BY weight DESC, source, target) FROM heavy) || '.', 1"""


def contexts(s, d):
    m = base.members(s, d)
    return summaries.module_contexts(m, grouping.module_edges(m, adapters.supply_edges(s, d)))


CONTEXTS = f"""WITH {_MODULES}, sizes AS (SELECT module, count(DISTINCT name) AS n FROM members GROUP BY 1)
SELECT module, concat_ws(' ', 'Module "' || module || '" contains ' || n || ' classes.',
  'It depends on: ' || (SELECT string_agg(target || ' (' || weight || ' connections)', ', ' ORDER BY weight DESC, target) FROM module_edges WHERE source = module) || '.',
  'It is depended upon by: ' || (SELECT string_agg(source || ' (' || weight || ' connections)', ', ' ORDER BY weight DESC, source) FROM module_edges WHERE target = module) || '.') AS text FROM sizes"""


def chains(s, d):
    return summaries.explained_chains(adapters.assembly_steps(s, d).filter("target <> '_meta_'"), "class", "signature")


CHAINS = f"""WITH {ASSEMBLY} SELECT class, signature, string_agg(CASE WHEN target = '_self_' THEN CASE WHEN coalesce(is_write, false) THEN 'writes field `' ELSE 'reads field `' END || member || '`'
ELSE CASE WHEN kind = 'call' THEN 'calls `' WHEN coalesce(is_write, false) THEN 'writes `' ELSE 'reads `' END || target || '::' || member || '`' END, ' → ' ORDER BY step) AS text FROM steps GROUP BY 1, 2"""

def class_digests(s, d):
    entries = _assembly_entries(s, d).withColumns({"namespace": F.when(F.col("ord") % 2 == 0, "parts"), "file": F.concat(F.lit("p/"), "name", F.lit(".h")), "line": F.col("ord") % 100})
    return entries.select("name", lookups.class_digest(entries).alias("text"))


CLASS_DIGESTS = f"""WITH {ASSEMBLY},
deps AS (
  SELECT 'P' || k AS name, 'P' || (k // 4) AS target, 'composition' AS type FROM parts WHERE k >= 4 UNION ALL SELECT 'P' || k, 'P' || (k // 6), 'association' FROM parts WHERE k >= 6
  UNION ALL SELECT 'P' || k, 'P' || (k // 5), 'inheritance' FROM parts WHERE z % 13 = 0 AND k >= 5 UNION ALL SELECT 'P' || k, 'P' || (k // 7), 'dependency' FROM parts WHERE z % 3 = 0 AND k >= 7),
on_them AS (SELECT name, string_agg(target || '(' || type || ')', ', ' ORDER BY target, type) AS t FROM deps GROUP BY 1),
p AS (
  SELECT *, 'P' || k AS name, CASE WHEN z % 3 = 0 THEN ['void remake(Part p)', 'void make(int n)', 'int cost() const'] ELSE ['void make(int n)', 'int cost() const', 'void remake(Part p)'] END AS pub,
         CASE WHEN z % 5 = 0 THEN ['void make(long n)', 'void check(int n)'] ELSE ['void check(int n)'] END AS priv FROM parts),
listed AS (SELECT *, CASE WHEN k % 5 = 4 THEN [pub[2]] ELSE list_concat(pub, priv, pub) END AS i FROM p)
SELECT l.name, concat_ws(chr(10), 'class ' || CASE WHEN k % 2 = 0 THEN 'parts::' ELSE '' END || l.name, '  location: p/' || l.name || '.h:' || (k % 100), '  purpose: ' || CASE WHEN k % 3 = 0 THEN 'Makes ' || brand ELSE 'Unknown' END,
  CASE WHEN k % 2 = 0 THEN '  extends: ' || brand END, '  dependencies: ' || t, '  public: ' || array_to_string(i[1:8], '; ') || CASE WHEN len(i) > 8 THEN ' …' ELSE '' END, CASE WHEN k % 5 <> 4 THEN '  internal: ' || array_to_string(priv, '; ') END) AS text
FROM listed l LEFT JOIN on_them o ON o.name = l.name"""


def chain_digests(s, d):
    return lookups.chain_digests(adapters.assembly_steps(s, d).filter("target <> '_meta_'"), "class", "signature")


CHAIN_DIGESTS = f"""WITH {ASSEMBLY} SELECT class, signature, string_agg(CASE WHEN target = '_self_' THEN CASE WHEN coalesce(is_write, false) THEN 'write ' ELSE 'read ' END || member
WHEN kind = 'call' THEN target || '::' || member || '()' ELSE CASE WHEN coalesce(is_write, false) THEN 'write ' ELSE 'read ' END || target || '::' || member END, ' → ' ORDER BY step) AS text FROM steps GROUP BY 1, 2"""


def path_subgraphs(s, d):
    steps = adapters.assembly_steps(s, d).select(F.concat_ws("::", "class", "signature").alias("path"), "target")
    return lookups.path_subgraph(adapters.assembly_classes(s, d).select(F.col("class").alias("name")), steps)


PATHS = f"""WITH {ASSEMBLY} SELECT DISTINCT s.class || '::' || s.signature AS path, c.class AS name FROM steps s JOIN classes c ON s.target = c.class OR s.target = split_part(c.class, '::', -1)"""


def highlights(s, d):
    """From the nations on."""
    seeds = adapters.table(s, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("name"))
    return lookups.highlighted(seeds, adapters.layered_edges(s, d))


HIGHLIGHTS = f"""WITH RECURSIVE {base.LAYERS}, up AS (SELECT 'N' || n_nationkey AS name, 0 AS hop FROM nation UNION SELECT l.dst, u.hop + 1 FROM up u JOIN layers l ON l.src = u.name),
down AS (SELECT 'N' || n_nationkey AS name, 0 AS hop FROM nation UNION SELECT l.src, u.hop + 1 FROM down u JOIN layers l ON l.dst = u.name)
SELECT name, min(hop)::INTEGER AS hop, 'upstream' AS side FROM up GROUP BY 1 HAVING min(hop) > 0 UNION ALL SELECT name, min(hop)::INTEGER, 'downstream' FROM down GROUP BY 1 HAVING min(hop) > 0"""


def namespaces(s, d):
    """Regions and nations as namespaces around customers, and orders within those."""
    t = lambda n: adapters.table(s, d, n)
    rows = [
        t("region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("namespace").alias("kind"), F.col("r_name").alias("name")),
        t("nation").select(F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey"), F.lit("namespace"), F.when(F.col("n_nationkey") % 7 == 0, "").otherwise(F.col("n_name"))),
        t("customer").select(F.concat(F.lit("C"), "c_custkey"), F.concat(F.lit("N"), "c_nationkey"), F.when(F.col("c_custkey") % 2 == 0, "namespace").otherwise("class"), F.col("c_name")),
        t("orders").select(F.concat(F.lit("O"), "o_orderkey"), F.concat(F.lit("C"), "o_custkey"), F.lit("method"), F.lit("run")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return lookups.qualified(out)


NAMESPACES = """WITH n AS (SELECT 'N' || n_nationkey AS id, r_name AS around, CASE WHEN n_nationkey % 7 = 0 THEN r_name ELSE r_name || '::' || n_name END AS inside FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT 'C' || c_custkey AS id, inside AS around, CASE WHEN c_custkey % 2 = 0 THEN inside || '::' || c_name ELSE inside END AS inside FROM customer JOIN n ON n.id = 'N' || c_nationkey)
SELECT 'R' || r_regionkey AS id, '' AS namespace FROM region UNION ALL SELECT id, around FROM n UNION ALL SELECT id, around FROM c UNION ALL SELECT 'O' || o_orderkey, coalesce(c.inside, '') FROM orders LEFT JOIN c ON c.id = 'C' || o_custkey"""


def built_modules(s, d):
    n, e = adapters.nodes(s, d), adapters.supply_edges(s, d)
    found, edges = lookups.build_modules(grouping.with_module(n), e, grouping.entry_points(n, e))
    counts = edges.groupBy(F.col("source").alias("module")).agg(F.count(F.lit(1)).alias("n_edges"))
    return found.join(counts, "module", "left").select("module", "n_classes", "internal_edges", "seed", F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"))


BUILT = f"""SELECT m.module, m.n_classes, m.internal_edges, s.seed, coalesce(e.n, 0)::BIGINT AS n_edges FROM ({base._SQL['E3_modules']}) m LEFT JOIN ({base._SQL['E7_summary_seeds']}) s USING (module)
LEFT JOIN (SELECT source, count(*) AS n FROM ({base._SQL['E6_module_edges']}) GROUP BY 1) e ON e.source = m.module"""

QUERIES = {"J20_J21_class_summaries": class_summaries, "J24_module_summaries": module_summaries, "E12_E13_project": project, "E13_module_contexts": contexts, "J22_explained_chains": chains, "J23_class_digests": class_digests, "J23_chain_digests": chain_digests, "C11_path_subgraphs": path_subgraphs, "H16_highlights": highlights, "X6_namespaces": namespaces, "E8_built_modules": built_modules}
SQL = {"J20_J21_class_summaries": CLASS_SUMMARIES, "J24_module_summaries": MODULE_SUMMARIES, "E12_E13_project": PROJECT, "E13_module_contexts": CONTEXTS, "J22_explained_chains": CHAINS, "J23_class_digests": CLASS_DIGESTS, "J23_chain_digests": CHAIN_DIGESTS, "C11_path_subgraphs": PATHS, "H16_highlights": HIGHLIGHTS, "X6_namespaces": NAMESPACES, "E8_built_modules": BUILT}
