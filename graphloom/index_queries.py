"""Queries over stored indexes: refs and their diff, enrichment with a memo, bodies and declarations, containment."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as base
from .method_queries import ASSEMBLY
from .operators import backfill, contain, diff, enrich, graph
from .plans import adapters
from .plans.adapters import table
from .sources.snapshots import Store, load_graph, save_graph


def _store(s: SparkSession) -> Store:
    return Store(s, f"{graph.shared_dir(s)}/store-{uuid.uuid4().hex}")


# --- refs


def _nations(s, d, left_out: int) -> DataFrame:
    n = table(s, d, "nation").filter(F.col("n_nationkey") % 5 != left_out)
    return n.groupBy(F.concat(F.lit("M"), "n_regionkey").alias("module")).agg(F.sort_array(F.collect_list("n_name")).alias("class_names"))


def _published(s, d) -> Store:
    """Two snapshots of customers by their orders, one after the other."""
    store = _store(s)
    named = lambda df: df.withColumn("name", F.concat(F.lit("C"), "name")).withColumn("pattern", F.when(F.col("risk") == "high", "Hub"))
    for rows, left_out, commit in zip(base._snapshots(s, d), (1, 2), ("first", "second"), strict=True):
        store.publish("main", {"classes": named(rows), "modules": _nations(s, d, left_out), "edges": adapters.layered_edges(s, d)}, {"commit": commit, "author": "orders"})
    return store


def as_of(s, d):
    """The classes of the snapshot before the last."""
    return _published(s, d).load("main~1")["classes"].select("name", "risk", "file", base.joined("interfaces").alias("interfaces"))


AS_OF = f"WITH {base.SNAP} SELECT 'C' || name AS name, risk, file, array_to_string(i, ',') AS interfaces FROM old"


def ref_diff(s, d):
    found = diff.diff_refs(_published(s, d), "main~1", "main")
    changes = F.transform("dep_changes", lambda c: F.concat(c["target"], F.lit(" "), c["change"], F.lit(" "), F.coalesce(c["old_type"], F.lit("")), F.lit(">"), F.coalesce(c["new_type"], F.lit(""))))
    lists = {c: base.joined(F.coalesce(c, F.expr("CAST(array() AS array<string>)"))) for c in ("interfaces_added", "interfaces_removed", "classes_added", "classes_removed")}
    return found.withColumns({**lists, "dep_changes": base.joined(F.coalesce(changes, F.expr("CAST(array() AS array<string>)")))}).drop("email", "date", "message")


REF_DIFF = f"""WITH {base.SNAP}, {base.LAYERS}, g AS ({base._SQL['G4_diff_classes']}),
changed AS (SELECT 'C' || name AS name FROM g),
direct AS (SELECT DISTINCT src AS name FROM layers WHERE dst IN (SELECT name FROM changed) AND src NOT IN (SELECT name FROM changed)),
indirect AS (SELECT DISTINCT src AS name FROM layers WHERE dst IN (SELECT name FROM direct) AND src NOT IN (SELECT name FROM changed) AND src NOT IN (SELECT name FROM direct)),
om AS (SELECT 'M' || n_regionkey AS module, list_sort(list(n_name)) AS c FROM nation WHERE n_nationkey % 5 <> 1 GROUP BY 1),
nm AS (SELECT 'M' || n_regionkey AS module, list_sort(list(n_name)) AS c FROM nation WHERE n_nationkey % 5 <> 2 GROUP BY 1),
m AS (SELECT coalesce(om.module, nm.module) AS name, CASE WHEN om.module IS NULL THEN 'added' WHEN nm.module IS NULL THEN 'removed' ELSE 'modified' END AS change,
  CASE WHEN om.module IS NULL OR nm.module IS NULL THEN '' ELSE array_to_string(list_filter(nm.c, lambda x: NOT list_contains(om.c, x)), ',') END AS plus,
  CASE WHEN om.module IS NULL OR nm.module IS NULL THEN '' ELSE array_to_string(list_filter(om.c, lambda x: NOT list_contains(nm.c, x)), ',') END AS minus FROM om FULL JOIN nm ON om.module = nm.module),
said AS (
  SELECT 'added' AS section, 'C' || g.name AS name, n.file, CASE WHEN n.risk = 'high' THEN 'Hub' END AS pattern, n.risk, '' AS interfaces_added, '' AS interfaces_removed, '' AS dep_changes, NULL AS risk_change, NULL AS file_change, '' AS classes_added, '' AS classes_removed
  FROM g JOIN new n ON n.name = g.name WHERE change = 'added'
  UNION ALL SELECT 'removed', 'C' || g.name, o.file, NULL, NULL, '', '', '', NULL, NULL, '', '' FROM g JOIN old o ON o.name = g.name WHERE change = 'removed'
  UNION ALL SELECT 'modified', 'C' || name, NULL, NULL, NULL, interfaces_added, interfaces_removed, dep_changes, risk_change, file_change, '', '' FROM g WHERE change = 'modified'
  UNION ALL SELECT 'modules_' || change, name, NULL, NULL, NULL, '', '', '', NULL, NULL, plus, minus FROM m WHERE change <> 'modified' OR plus <> '' OR minus <> ''
  UNION ALL SELECT 'impact_direct', name, NULL, NULL, NULL, '', '', '', NULL, NULL, '', '' FROM direct
  UNION ALL SELECT 'impact_indirect', name, NULL, NULL, NULL, '', '', '', NULL, NULL, '', '' FROM indirect)
SELECT 'second' AS commit, 'orders' AS author, * FROM said"""


def stored_graph(s, d):
    store = _store(s)
    save_graph(store, graph.reverse_deps(adapters.layered_edges(s, d)))
    return load_graph(store).select("name", base.joined("dependents").alias("dependents"))


GRAPH = f"WITH {base.LAYERS} SELECT dst AS name, string_agg(src, ',' ORDER BY src) AS dependents FROM layers GROUP BY 1"


# --- enrichment

#: How the last word of a part's name ends the name of a class; others end in Widget.
ENDINGS = {"ring": "Manager", "bolt": "Factory", "gear": "Pool", "plate": "Cache", "anvil": "Handler", "gizmo": "Observer", "cog": "Builder"}


def _entries(s, d) -> tuple[DataFrame, DataFrame]:
    """Parts as classes: named by type and name, with bases by size and suppliers as dependencies; degrees by name."""
    p = table(s, d, "part")
    ending = F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair])
    name = F.concat(F.initcap(F.lower("p_type")), F.initcap(F.substring_index("p_name", " ", 1)), F.coalesce(F.try_element_at(ending, F.substring_index("p_name", " ", -1)), F.lit("Widget")))
    rows = p.select(F.col("p_partkey").alias("ord"), name.alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("Unknown").alias("responsibility"), F.array(F.col("p_type"), F.lit('say("hi")\t')).alias("interfaces"), F.slice(F.concat(F.split("p_name", " "), F.array("p_type", "p_brand")), 1, F.col("p_size") % 5).alias("bases"), "p_brand")
    deps = adapters.supply_edges(s, d).select(F.substring("dst", 2, 20).cast("int").alias("ord"), F.struct(F.col("src").alias("target"), "type").alias("dep")).groupBy("ord").agg(F.sort_array(F.collect_list("dep")).alias("deps"))
    degrees = rows.groupBy("name").agg(F.countDistinct("p_brand").alias("in_degree"))
    return rows.drop("p_brand").join(deps, "ord", "left"), degrees


ENTRY_ROWS = f"""{base.EDGES}, entry_deps AS (SELECT substr(dst, 2)::INTEGER AS ord, list_sort(list([src, type])) AS deps FROM edges GROUP BY 1),
entries AS (
  SELECT p_partkey AS ord, p_brand, p_type[1] || lower(p_type[2:]) || upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || CASE split_part(p_name, ' ', -1) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ENDINGS.items())} ELSE 'Widget' END AS name,
         lower(p_type) || ' ' || split_part(p_name, ' ', 1) AS words, split_part(p_name, ' ', -1) AS box, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'Unknown' END AS responsibility, list_sort([p_type, 'say("hi")' || chr(9)]) AS interfaces, list_sort(list_concat(string_split(p_name, ' '), [p_type, p_brand])[1:(p_size % 5)]) AS bases, coalesce(deps, []) AS deps
  FROM part LEFT JOIN entry_deps ON ord = p_partkey),
degrees AS (SELECT name, count(DISTINCT p_brand) AS i FROM entries GROUP BY 1),
ruled AS (
  SELECT e.ord, e.name, CASE box WHEN 'ring' THEN 'Manages ' || words WHEN 'bolt' THEN 'Creates ' || words || ' instances' WHEN 'gear' THEN 'Pools ' || words || ' resources' WHEN 'plate' THEN 'Caches ' || words || ' data' WHEN 'anvil' THEN 'Handles ' || words || ' events'
         WHEN 'gizmo' THEN 'Observes ' || words || ' changes' WHEN 'cog' THEN 'Builds ' || words || ' objects' ELSE CASE WHEN responsibility <> 'Unknown' THEN responsibility || ': ' || words || ' widget' ELSE 'Handles ' || words || ' widget operations' END END AS intent,
         CASE WHEN i >= 5 THEN 'high' WHEN i >= 2 THEN 'medium' ELSE 'low' END AS risk, CASE box WHEN 'bolt' THEN 'Factory' WHEN 'gizmo' THEN 'Observer' WHEN 'cog' THEN 'Builder' END AS pattern,
         len(list_filter(deps, lambda x: x[2] = 'aggregation')) AS a, len(deps) AS o, len(bases) AS b, i
  FROM entries e JOIN degrees g ON g.name = e.name),
remarked AS (
  SELECT ord, name, intent, risk, pattern, concat_ws('|', CASE WHEN a > 0 THEN 'Shared ownership (' || a || ' shared_ptr/weak_ptr dep' || CASE WHEN a > 1 THEN 's' ELSE '' END || ') may cause lifecycle ambiguity' END,
         CASE WHEN o > 8 THEN 'High fan-out (' || o || ' dependencies) — potential god-class, consider decomposing' END, CASE WHEN b > 2 THEN 'Deep inheritance (' || b || ' base classes) increases coupling and reduces flexibility' END,
         CASE WHEN i = 0 AND o > 0 THEN 'Root node — not depended on by others; changes here propagate downward widely' END, CASE WHEN i >= 5 THEN 'High fan-in (' || i || ' dependents) — changes here have wide blast radius' END) AS tradeoffs
  FROM ruled)"""


def heuristics(s, d):
    out = enrich.heuristics(*_entries(s, d))
    return out.select("ord", "name", "intent", "risk", "pattern", F.array_join("tradeoffs", "|").alias("tradeoffs"))


def enriched(s, d):
    """The second of two runs, which asks for nothing."""
    entries, degrees = map(graph.keep, _entries(s, d))
    store = _store(s)
    enrich.enrich_classes(entries, degrees, store)
    again = enrich.enrich_classes(entries, degrees, store)
    return again.rows.select("ord", "name", "intent", "risk", "pattern", F.array_join("tradeoffs", "|").alias("tradeoffs"), "hash", "by_model", F.lit(again.asked).cast("long").alias("asked"), F.lit(again.known).cast("long").alias("known"))


ENTRY_HASH = """substr(sha256('{"baseClasses": [' || array_to_string(list_transform(bases, lambda x: to_json(x)::VARCHAR), ', ') || '], "className": ' || to_json(name)::VARCHAR
  || ', "dependencies": [' || array_to_string(list_transform(deps, lambda x: '[' || to_json(x[1])::VARCHAR || ', ' || to_json(x[2])::VARCHAR || ']'), ', ') || '], "interfaces": [' || array_to_string(list_transform(interfaces, lambda x: to_json(x)::VARCHAR), ', ')
  || '], "responsibility": ' || to_json(responsibility)::VARCHAR || '}'), 1, 16)"""


def hashes(s, d):
    entries = _entries(s, d)[0].select(F.lit("class").alias("kind"), F.col("ord").cast("string").alias("id"), enrich.entry_hash().alias("hash"))
    n = table(s, d, "nation")
    modules = n.groupBy(F.concat(F.lit("M"), "n_regionkey").alias("name")).agg(F.collect_list("n_name").alias("class_names"), F.collect_list(F.col("n_nationkey").cast("string")).alias("external"))
    modules = modules.select(F.lit("module").alias("kind"), F.col("name").alias("id"), enrich.module_hash().alias("hash"))
    project = n.agg(F.collect_set(F.concat(F.lit("M"), "n_regionkey")).alias("modules"), F.collect_list("n_name").alias("entry_points"))
    return entries.unionByName(modules).unionByName(project.select(F.lit("project").alias("kind"), F.lit("all").alias("id"), enrich.project_hash().alias("hash")))


HASHES = f"""WITH {ENTRY_ROWS}, quoted AS (SELECT 'M' || n_regionkey AS m, n_name AS n, n_nationkey::VARCHAR AS k FROM nation)
SELECT 'class' AS kind, ord::VARCHAR AS id, {ENTRY_HASH} AS hash FROM entries
UNION ALL SELECT 'module', m, 'mod:' || substr(sha256('{{"classNames": [' || string_agg('"' || n || '"', ', ' ORDER BY n) || '], "externalDeps": [' || string_agg('"' || k || '"', ', ' ORDER BY k) || '], "name": "' || m || '"}}'), 1, 16) FROM quoted GROUP BY m
UNION ALL SELECT 'project', 'all', 'proj:' || substr(sha256('{{"entryPoints": [' || string_agg('"' || n || '"', ', ' ORDER BY n) || '], "modules": [' || (SELECT string_agg('"' || m || '"', ', ' ORDER BY m) FROM (SELECT DISTINCT m FROM quoted)) || ']}}'), 1, 16) FROM quoted"""


def _answers(s, d) -> DataFrame:
    z, text = F.col("p_size"), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    intent = F.when(z % 11 == 0, "7").when(z % 13 == 0, F.lit('"  "')).otherwise(text('"', F.col("p_type"), '"'))
    risk = F.when(z % 4 == 0, "high").when(z % 4 == 1, "medium").when(z % 4 == 2, "low").otherwise("huge")
    listed = F.when(z % 3 == 0, '"none"').when(z % 3 == 1, "[]").otherwise('["a", "b"]')
    body = text('{"intent": ', intent, ', "tradeoffs": ', listed, ', "changeRisk": "', risk, '", "summary": ', intent, F.when(z % 7 == 0, "").otherwise("}"))
    return table(s, d, "part").select("p_partkey", F.when(z % 5 == 0, text("```json\n", body, "\n```")).otherwise(body).alias("answer"))


def validation(s, d):
    answer = F.col("answer")
    return _answers(s, d).select("p_partkey", enrich.sound_class(answer).alias("sound"), enrich.sound_text(answer, "summary").alias("summary"))


VALIDATION = """SELECT p_partkey, p_size % 7 <> 0 AND p_size % 11 <> 0 AND p_size % 13 <> 0 AND p_size % 4 <> 3 AND p_size % 3 <> 0 AS sound,
CASE WHEN p_size % 7 <> 0 AND p_size % 11 <> 0 AND p_size % 13 <> 0 THEN p_type END AS summary FROM part"""


# --- bodies


def _bodies(s, d) -> DataFrame:
    """class, body, ord, name, signature: every other part names its class without namespace; some have more bodies than declarations."""
    p = adapters._assemblies(s, d)
    body = lambda nth, name, signature, when=F.lit(True): F.when(when, F.struct(F.lit(nth).alias("ord"), F.lit(name).alias("name"), F.lit(signature).alias("signature")))
    many = F.col("z") % 5 == 0
    rows = F.array(body(1, "make", "void make(short n)", many), body(2, "make", "void make(int n)"), body(3, "make", "void make(long n)", many), body(4, "remake", "void remake(Part q)"), body(5, "check", "void check(int n)"), body(6, "helper", "int helper()"), body(7, "cost", "int cost() const"))
    out = p.select(F.when(F.col("z") % 2 == 0, F.col("class")).otherwise(F.concat(F.lit("x::P"), "k")).alias("class"), "k", F.explode(F.filter(rows, lambda b: b.isNotNull())).alias("b"))
    return out.select("class", F.concat(F.lit("B"), "k", F.lit("."), "b.ord").alias("body"), "b.ord", "b.name", "b.signature")


def bodies(s, d):
    slots = adapters.assembly_methods(s, d).select("class", "signature", "place", (F.col("place") == 2).alias("filled"))
    return backfill.backfill(slots, _bodies(s, d))


BODIES = rf"""WITH RECURSIVE {ASSEMBLY},
raw AS (
  SELECT CASE WHEN z % 2 = 0 THEN class ELSE 'x::P' || k END AS class, 'B' || k || '.' || ord AS body, ord, name, signature FROM parts, (VALUES (1, 'make', 'void make(short n)', true), (2, 'make', 'void make(int n)', false), (3, 'make', 'void make(long n)', true),
  (4, 'remake', 'void remake(Part q)', false), (5, 'check', 'void check(int n)', false), (6, 'helper', 'int helper()', false), (7, 'cost', 'int cost() const', false)) AS v(ord, name, signature, many) WHERE NOT many OR z % 5 = 0),
owned AS (SELECT c.class AS owner, r.* EXCLUDE (class) FROM raw r JOIN classes c ON c.class = r.class UNION ALL
  SELECT c.class, r.* EXCLUDE (class) FROM raw r JOIN classes c ON c.class = split_part(r.class, '::', -1) WHERE r.class NOT IN (SELECT class FROM classes)),
turns AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ord, body) AS t FROM owned),
slots AS (SELECT class, list({{'place': place, 'signature': signature}} ORDER BY place) AS s FROM methods GROUP BY 1),
state AS (
  SELECT class, s, 0 AS t, [2] AS taken, ['']::VARCHAR[] AS got FROM slots
  UNION ALL
  SELECT x.class, x.s, x.t + 1, list_append(x.taken, p.at), list_append(x.got, b.body)
  FROM state x JOIN turns b ON b.owner = x.class AND b.t = x.t + 1,
  LATERAL (SELECT coalesce(list_filter(x.s, lambda q: q.signature = b.signature AND NOT list_contains(x.taken, q.place))[1].place,
    list_filter(x.s, lambda q: regexp_matches(q.signature, '\b' || b.name || '\s*\(') AND NOT list_contains(x.taken, q.place))[1].place, -1) AS at) p),
final AS (SELECT * FROM state QUALIFY row_number() OVER (PARTITION BY class ORDER BY t DESC) = 1)
SELECT m.class, m.signature, m.place, CASE WHEN m.place <> 2 THEN f.got[list_position(f.taken, m.place)] END AS body FROM methods m JOIN final f ON f.class = m.class"""


# --- containment


def anchors(s, d):
    lines = table(s, d, "lineitem")
    logs = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("log"), F.concat(F.lit("in "), F.lower("l_returnflag"), F.lit(" line: P"), "l_partkey", F.lit(" by S"), "l_suppkey", F.lit("::supply failed (indo)")).alias("text"))
    return contain.anchors(logs, adapters.nodes(s, d))


ANCHORS = f"""WITH {base.NODES},
logs AS (SELECT l_orderkey * 10 + l_linenumber AS log, 'in ' || lower(l_returnflag) || ' line: P' || l_partkey || ' by S' || l_suppkey || '::supply failed (indo)' AS text FROM lineitem),
words AS (SELECT DISTINCT log, w FROM (SELECT log, unnest(regexp_split_to_array(text, '[^a-zA-Z0-9_:]+')) AS w FROM logs) WHERE length(w) >= 4),
hit AS (SELECT w, name, ord FROM (SELECT DISTINCT w FROM words) JOIN nodes ON contains(name, w) OR contains(w, name) OR (namespace <> '' AND contains(namespace, w))),
found AS (SELECT DISTINCT log, name, ord FROM words JOIN hit USING (w))
SELECT log, name FROM found QUALIFY row_number() OVER (PARTITION BY log ORDER BY ord, name) <= 10"""


def relevance(s, d):
    """Types with names of parts are the queries; parts are found by number, brand, type and name."""
    p = table(s, d, "part")
    none = F.expr("CAST(array() AS array<string>)")
    tokens = contain.entry_tokens(F.concat(F.lit("Part"), "p_partkey"), F.col("p_brand"), F.col("p_type"), F.array(F.col("p_name")), none)
    entries = p.select(F.concat(F.lit("Part"), "p_partkey").alias("name"), F.col("p_partkey").alias("ord"), tokens.alias("tokens"))
    asked = p.select(F.concat_ws(" ", F.concat(F.lit("Un"), F.lower("p_type")), F.initcap("p_name")).alias("query")).distinct().withColumn("text", F.col("query"))
    out = contain.relevant(asked, entries)
    return out.withColumn("score", F.round("score", 9))


WORDS = r"list_distinct(list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace({}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[\s_:,.()\[\]<>]+'), lambda w: length(w) > 1), lambda w: lower(w)))"
RELEVANCE = f"""WITH asked AS (SELECT DISTINCT concat_ws(' ', 'Un' || lower(p_type), array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')) AS query FROM part),
q AS (SELECT query, {WORDS.format('query')} AS t FROM asked),
qt AS (SELECT query, len(t) AS size, unnest(t) AS q FROM q),
held AS (SELECT DISTINCT p_partkey AS ord, unnest(list_concat({WORDS.format("'Part' || p_partkey")}, {WORDS.format('p_brand')}, {WORDS.format('p_type')}, {WORDS.format('p_name')})) AS t FROM part),
hit AS (SELECT DISTINCT a.q, h.ord FROM (SELECT DISTINCT q FROM qt) a JOIN (SELECT DISTINCT t FROM held) e ON contains(e.t, a.q) OR contains(a.q, e.t) JOIN held h ON h.t = e.t),
scored AS (SELECT query, ord, round(count(*) / any_value(size), 9) AS score FROM qt JOIN hit USING (q) GROUP BY 1, 2)
SELECT query, 'Part' || ord AS name, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, ord)::INTEGER AS rank FROM scored QUALIFY rank <= 20"""


QUERIES = {
    "A11_as_of": as_of, "A15_stored_graph": stored_graph, "G8_ref_diff": ref_diff, "J16_heuristics": heuristics, "J17_memo_hashes": hashes, "J18_enriched": enriched, "J19_validation": validation,
    "X17_backfill": bodies, "C9_anchors": anchors, "I8_F6_relevant": relevance,
}
SQL = {
    "A11_as_of": AS_OF, "A15_stored_graph": GRAPH, "G8_ref_diff": REF_DIFF, "J16_heuristics": f"WITH {ENTRY_ROWS} SELECT * FROM remarked", "J17_memo_hashes": HASHES,
    "J18_enriched": f"WITH {ENTRY_ROWS} SELECT r.*, h.hash, false AS by_model, 0 AS asked, (SELECT count(*) FROM entries) AS known FROM remarked r JOIN (SELECT ord, {ENTRY_HASH} AS hash FROM entries) h ON h.ord = r.ord",
    "J19_validation": VALIDATION, "X17_backfill": BODIES, "C9_anchors": ANCHORS, "I8_F6_relevant": RELEVANCE,
}
