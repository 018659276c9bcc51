"""Queries that tell diagrams as numbered lines of documents, one for each brand of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .method_queries import ASSEMBLY
from .operators import documents
from .plans import adapters


def class_documents(s, d):
    classes, methods, deps = adapters.assembly_classes(s, d), adapters.assembly_methods(s, d), adapters.assembly_deps(s, d)
    public = methods.filter("is_public").groupBy("class").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "signature"))), lambda m: m["signature"]).alias("interfaces"))
    held = deps.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("target", F.col("dep_type").alias("type"), F.lit(None).cast("string").alias("cardinality")))).alias("deps"))
    none = F.expr("CAST(array() AS array<string>)")
    entries = classes.join(public, "class").join(held, "class", "left").select(F.col("namespace").alias("document"), "ord", F.element_at(F.split("class", "::"), -1).alias("name"), "namespace", none.alias("template_params"), none.alias("attributes"), "interfaces", "deps")
    return documents.numbered(documents.class_diagrams(entries, title="Parts", max_methods=2))


CLASS_DOCUMENTS = f"""WITH {ASSEMBLY},
shown AS (SELECT signature, class, row_number() OVER (PARTITION BY class ORDER BY place) AS i FROM methods WHERE place < 4),
deps AS (
  SELECT brand, k, k // 4 AS other, 'composition' AS type FROM parts WHERE k >= 4 UNION ALL SELECT brand, k, k // 6, 'association' FROM parts WHERE k >= 6
  UNION ALL SELECT brand, k, k // 5, 'inheritance' FROM parts WHERE z % 13 = 0 AND k >= 5 UNION ALL SELECT brand, k, k // 7, 'dependency' FROM parts WHERE z % 3 = 0 AND k >= 7),
lines AS (
  SELECT DISTINCT brand, 0 AS s, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, 'classDiagram' AS value FROM parts UNION ALL SELECT DISTINCT brand, 0, 1, 0, 0, '    title Parts' FROM parts
  UNION ALL SELECT brand, 1, k, 0, 0, '    class P' || k || ' {{' FROM parts
  UNION ALL SELECT brand, 1, k, 3, i, '        +' || CASE signature WHEN 'void make(int n)' THEN 'make(int n)' WHEN 'void remake(Part p)' THEN 'remake(Part p)' ELSE signature END FROM shown JOIN parts USING (class) WHERE i <= 2
  UNION ALL SELECT brand, 1, k, 3, 9, '        ... 1 more' FROM parts UNION ALL SELECT brand, 1, k, 4, 0, '    }}' FROM parts UNION ALL SELECT brand, 1, k, 5, 0, '    note for P' || k || ' "ns: ' || brand || '"' FROM parts
  UNION ALL SELECT d.brand, 2, d.k, row_number() OVER (PARTITION BY d.k ORDER BY 'P' || d.other, d.type), 0, CASE d.type WHEN 'inheritance' THEN '    P' || d.other || ' <|-- P' || d.k ELSE '    P' || d.k || CASE d.type WHEN 'composition' THEN ' *-- ' WHEN 'association' THEN ' --> ' ELSE ' ..> ' END || 'P' || d.other || ' : ' || d.type END
    FROM deps d JOIN parts o ON o.k = d.other AND o.brand = d.brand)
SELECT brand AS document, row_number() OVER (PARTITION BY brand ORDER BY s, a, b, c, value)::INTEGER AS line, value FROM lines"""


def sequence_documents(s, d):
    """Only calls from or to brands whose names begin with brand_1 are shown."""
    classes, steps = adapters.assembly_classes(s, d), adapters.assembly_steps(s, d)
    calls = steps.filter("kind = 'call' AND target NOT IN ('_self_', '_meta_')").join(classes.select("class", "ord", "namespace"), "class")
    method = F.regexp_extract("signature", r"(\w+)\(", 1)
    calls = calls.select(F.col("namespace").alias("document"), (F.col("ord") * 20 + F.when(method == "make", 0).otherwise(10) + F.col("step")).alias("pos"), F.concat_ws("::", "class", method).alias("caller"), F.concat_ws("::", "target", "member").alias("callee"), F.when(F.col("step") == 1, F.concat(F.lit("n = "), "ord")).alias("args"), F.when(F.col("member") == "check", "bool").alias("returns"))
    return documents.numbered(documents.sequence_diagrams(calls, classes.select(F.col("namespace").alias("document")), namespace="brand_1"))


SEQUENCE_DOCUMENTS = f"""WITH {ASSEMBLY},
calls AS (
  SELECT p.brand, p.k * 20 + CASE WHEN s.signature LIKE '%make(%' THEN 0 ELSE 10 END + s.step AS pos, s.class AS one, s.target AS two, s.member || '(' || CASE WHEN s.step = 1 THEN 'n = ' || p.k ELSE '' END || ')' AS label, CASE WHEN s.member = 'check' THEN 'bool' ELSE 'return' END AS back
  FROM steps s JOIN parts p ON p.class = s.class WHERE s.kind = 'call' AND s.target <> '_self_'),
hit AS (SELECT brand, pos, replace(one, ':', '_') AS one, replace(two, ':', '_') AS two, label, back FROM calls WHERE one LIKE 'brand\\_1%' ESCAPE '\\' OR two LIKE 'brand\\_1%' ESCAPE '\\'),
who AS (SELECT brand, who, min(p) AS p FROM (SELECT brand, one AS who, pos * 2 AS p FROM hit UNION ALL SELECT brand, two, pos * 2 + 1 FROM hit) GROUP BY 1, 2),
held AS (SELECT DISTINCT brand FROM hit), having_calls AS (SELECT DISTINCT brand FROM calls), all_brands AS (SELECT DISTINCT brand FROM parts),
lines AS (
  SELECT brand, 0 AS s, 0::BIGINT AS a, 0::BIGINT AS b, 'sequenceDiagram' AS value FROM all_brands
  UNION ALL SELECT brand, 0, 1, 0, '    Note over System: No call graph data' FROM all_brands WHERE brand NOT IN (SELECT brand FROM having_calls)
  UNION ALL SELECT brand, 0, 1, 0, '    Note over System: No matching call graph edges' FROM having_calls WHERE brand NOT IN (SELECT brand FROM held)
  UNION ALL SELECT brand, 1, p, 0, '    participant ' || who FROM who UNION ALL SELECT brand, 2, 0, 0, '' FROM held
  UNION ALL SELECT brand, 3, pos, 0, '    ' || one || '->>+' || two || ': ' || label FROM hit UNION ALL SELECT brand, 3, pos, 1, '    ' || two || '-->>-' || one || ': ' || back FROM hit)
SELECT brand AS document, row_number() OVER (PARTITION BY brand ORDER BY s, a, b, value)::INTEGER AS line, value FROM lines"""

QUERIES = {"J8_class_documents": class_documents, "J7_C10_sequence_documents": sequence_documents}
SQL = {"J8_class_documents": CLASS_DOCUMENTS, "J7_C10_sequence_documents": SEQUENCE_DOCUMENTS}
