"""Queries over signatures, types, aliases and command lines that are made of the columns of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import extraction, signatures
from .operators import aliases, free_functions
from .plans.adapters import table

_WORDS = "upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] AS u, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS t"


def _parts(s, d) -> DataFrame:
    word = lambda n: F.initcap(F.split_part("p_name", F.lit(" "), F.lit(n)))
    return table(s, d, "part").select("p_partkey", "p_size", word(1).alias("u"), word(2).alias("t"))


def _by_size(*texts: Column) -> Column:
    """One of the texts by the size of the part."""
    n = len(texts)
    return F.coalesce(*[F.when(F.col("p_size") % n == i, x) for i, x in enumerate(texts)])


def _said(*parts: str) -> Column:
    """Text in which T and U are the words of the part's name."""
    return F.concat(*[F.col(p.lower()) if p in ("T", "U") else F.lit(p) for p in parts])


def method_types(s, d):
    signature = _by_size(
        _said("map<string, vector<", "T", ">> find(const ", "U", " & key, int n = f(1, 2))"),
        _said("virtual void on(function<void(", "T", ", ", "U", ")> call, ", "T", " * p)"),
        _said("~", "T", "()"), _said("T", "(const ", "T", " &)"),
        _said("std::string name(std::vector<", "T", "> v, ", "U", " u) const noexcept(true)"), _said("T", " & operator()(unsigned int, ", "U", " u)"),
    )
    rows = _parts(s, d).withColumn("parts", signatures.signature_parts(signature)).withColumn("used", signatures.used_types(signature))
    return rows.select("p_partkey", "parts.returns", "parts.name", F.array_join("parts.params", ";").alias("params"), F.array_join("used", ";").alias("used"))


METHOD_TYPES = f"""WITH p AS (SELECT p_partkey, p_size % 6 AS k, {_WORDS} FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'map<string, vector<' || t || '>>' WHEN 1 THEN 'virtual void' WHEN 4 THEN 'std::string' WHEN 5 THEN t || ' &' ELSE '' END AS returns,
CASE k WHEN 0 THEN 'find' WHEN 1 THEN 'on' WHEN 2 THEN '~' || t WHEN 3 THEN t WHEN 4 THEN 'name' ELSE 'operator()' END AS name,
CASE k WHEN 0 THEN 'const ' || u || ' & key;int n = f(1, 2)' WHEN 1 THEN 'function<void(' || t || ', ' || u || ')> call;' || t || ' * p' WHEN 2 THEN '' WHEN 3 THEN 'const ' || t || ' &' WHEN 4 THEN 'std::vector<' || t || '> v;' || u || ' u' ELSE 'unsigned int;' || u || ' u' END AS params,
CASE k WHEN 0 THEN u || ';map<string, vector<' || t || '>>' WHEN 1 THEN 'function<void(' || t || ', ' || u || ')>;' || t WHEN 2 THEN '' WHEN 3 THEN t WHEN 4 THEN u ELSE 'unsigned int;' || u || ';' || t END AS used FROM p"""


def nested_fields(s, d):
    kind = _by_size(
        _said("std::map<string, vector<", "T", ">>"), _said("vector<map<", "U", ", ", "T", ">>"), _said("function<void(", "T", ", ", "U", ")>"), _said("shared_ptr<pair<", "T", ", ", "U", ">>"),
        _said("map<pair<int, ", "U", ">, ", "T", ">"), _said("unique_ptr<Holder<", "T", ", ", "U", ">, Free>"), _said("set<int>"),
    )
    dep = extraction.field_dependency(kind)
    return _parts(s, d).select("p_partkey", dep["target"].alias("target"), dep["type"].alias("type"), dep["cardinality"].alias("cardinality"))


NESTED_FIELDS = f"""WITH p AS (SELECT p_partkey, p_size % 7 AS k, {_WORDS} FROM part)
SELECT p_partkey, CASE k WHEN 2 THEN 'function<void(' || t || ', ' || u || ')>' WHEN 3 THEN 'pair<' || t || ', ' || u || '>' WHEN 5 THEN 'Holder<' || t || ', ' || u || '>' WHEN 6 THEN NULL ELSE t END AS target,
CASE WHEN k IN (2, 5) THEN 'composition' WHEN k <> 6 THEN 'aggregation' END AS type, CASE WHEN k IN (0, 1, 4) THEN '1..*' END AS cardinality FROM p"""


def first_dependencies(s, d):
    """Each part's dependencies in order, with repeats, trivial ones and itself."""
    dep = lambda t, kind, card=None: F.struct(t.alias("target"), F.lit(kind).alias("type"), F.lit(card).cast("string").alias("cardinality"))
    found = F.array(dep(F.col("t"), "aggregation", "1..*"), dep(F.col("u"), "association"), dep(F.col("t"), "aggregation"), dep(F.lit("int"), "composition"), dep(F.col("t"), "composition"), dep(F.concat(F.lit("P"), "p_partkey"), "association"), dep(F.col("u"), "association", "1..*"))
    rows = _parts(s, d).select("p_partkey", F.posexplode(signatures.dependencies(found, F.concat(F.lit("P"), "p_partkey"))).alias("nth", "dep"))
    return rows.select("p_partkey", "nth", "dep.target", "dep.type", "dep.cardinality")


FIRST_DEPENDENCIES = f"""WITH p AS (SELECT p_partkey, {_WORDS} FROM part)
SELECT p_partkey, 0 AS nth, t AS target, 'aggregation' AS type, '1..*' AS cardinality FROM p UNION ALL SELECT p_partkey, 1, u, 'association', NULL FROM p UNION ALL SELECT p_partkey, 2, t, 'composition', NULL FROM p"""


def alias_fields(s, d):
    k = F.col("p_partkey")
    other = lambda by: F.concat(F.lit("const A"), (k + by).cast("string"))
    target = F.when(k % 10 == 7, other(1)).when(k % 10 == 8, other(-1)).when(k % 10 == 9, other(-2)).when(k % 3 == 0, _said("std::unique_ptr<const ", "T", ">")).when(k % 3 == 1, other(-1)).otherwise(_said("vector<", "U", " *> *"))
    rows = _parts(s, d).withColumn("alias", F.concat(F.lit("A"), k.cast("string")))
    known = rows.select("alias", target.alias("canonical"))
    fields = rows.select("p_partkey", F.when(k % 4 == 0, _said("T", " *")).otherwise(F.concat(F.lit("const "), "alias", F.lit(" &"))).alias("type"))
    out = aliases.field_dependencies(fields, known)
    return out.select("p_partkey", "alias", F.col("dep.target").alias("target"), F.col("dep.type").alias("type"))


ALIAS_FIELDS = f"""WITH RECURSIVE p AS (SELECT p_partkey AS k, {_WORDS} FROM part),
a AS (SELECT k, CASE WHEN k % 10 = 7 THEN k + 1 WHEN k % 10 = 8 THEN k - 1 WHEN k % 10 = 9 THEN k - 2 WHEN k % 3 = 1 THEN k - 1 END AS next, CASE WHEN k % 3 = 0 THEN t ELSE u END AS inner_type, CASE WHEN k % 3 = 0 THEN 'composition' ELSE 'aggregation' END AS kind FROM p),
way(k, now, steps) AS (SELECT k, k, 0 FROM p UNION ALL SELECT w.k, a.next, w.steps + 1 FROM way w JOIN a ON a.k = w.now WHERE a.next IS NOT NULL AND w.steps < 20 AND a.next IN (SELECT k FROM p)),
ends AS (SELECT w.k, a.inner_type, a.kind FROM way w JOIN a ON a.k = w.now WHERE a.next IS NULL)
SELECT p.k AS p_partkey, CASE WHEN p.k % 4 <> 0 AND e.k IS NOT NULL THEN 'A' || p.k END AS alias, CASE WHEN p.k % 4 = 0 THEN p.t ELSE coalesce(e.inner_type, 'A' || p.k) END AS target,
CASE WHEN p.k % 4 <> 0 AND e.k IS NOT NULL THEN e.kind ELSE 'aggregation' END AS type FROM p LEFT JOIN ends e ON e.k = p.k"""


def commands(s, d):
    """Compile commands of parts, with quotes, escapes and an open quote, and their files."""
    k = F.col("p_partkey").cast("string")
    command = _by_size(F.concat(F.lit('cc -D"A B='), "t", F.lit("\" '-DX=\\ y' a\\ b.cpp -o "), k, F.lit(".o")), F.concat(F.lit('  g++\t-I"" -DQ="say \\"'), "u", F.lit("\\\" \\n\" -MF dep x.o")), F.concat(F.lit("cc 'open "), "t"))
    path = _by_size(F.concat(F.lit("../src/./"), k, F.lit(".cpp")), F.concat(F.lit("/abs//"), k, F.lit(".cpp")))
    rows = _parts(s, d).select("p_partkey", signatures.absolute(F.lit("/work/build"), path).alias("file"), signatures.shell_words(command).alias("words"))
    return rows.select("p_partkey", "file", F.array_join("words", "|").alias("words"), F.array_join(extraction.compiler_arguments(F.col("words"), F.col("file")), "|").alias("arguments"))


COMMANDS = f"""WITH p AS (SELECT p_partkey, p_size AS z, {_WORDS} FROM part)
SELECT p_partkey, CASE z % 2 WHEN 0 THEN '/work/src/' ELSE '/abs/' END || p_partkey || '.cpp' AS file,
CASE z % 3 WHEN 0 THEN 'cc|-DA B=' || t || '|-DX=\\ y|a b.cpp|-o|' || p_partkey || '.o' WHEN 1 THEN 'g++|-I|-DQ=say "' || u || '" \\n|-MF|dep|x.o' END AS words,
CASE z % 3 WHEN 0 THEN '-DA B=' || t || '|-DX=\\ y|a b.cpp' WHEN 1 THEN '-I|-DQ=say "' || u || '" \\n' END AS arguments FROM p"""

def _functions(s, d) -> DataFrame:
    z, k = F.col("p_size"), F.col("p_partkey")
    name = F.when(z % 9 == 0, "main").otherwise(F.concat(F.lower("u"), F.when(z % 5 == 0, "_parse_").when(z % 5 == 1, "_util_").otherwise("_"), F.lower("t")))
    signature = F.concat(F.lit("void "), name, F.lit("("), "t", F.lit(" * t, "), "u", F.lit(" u)"))
    space = F.when(z % 4 == 0, F.concat_ws("::", F.lit("make"), "u"))
    return _parts(s, d).select(k.alias("ord"), F.concat(F.lit("/src/"), "u", F.lit("/"), "t", F.lit(".v"), (z % 3).cast("string"), F.lit(".cpp")).alias("file"), space.alias("namespace"), name.alias("name"), signature.alias("signature"), z.alias("line"), signatures.used_types(signature).alias("param_types"))


def synthetic(s, d):
    out = free_functions.synthetic(_functions(s, d))

    def told(rows: DataFrame, column: str, name: str) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct("nth", F.col(column).alias("x"))))
        return rows.groupBy("key").agg(F.array_join(F.transform(ordered, lambda r: r["x"]), ";").alias(name))

    return out.entries.join(told(out.methods, "signature", "methods"), "key").join(told(out.dependencies, "target", "targets"), "key")


SYNTHETIC = f"""WITH p AS (SELECT p_partkey AS k, p_size AS z, {_WORDS} FROM part),
f AS (SELECT k, z, u, t, '/src/' || u || '/' || t || '.v' || z % 3 || '.cpp' AS file, CASE WHEN z % 4 = 0 THEN 'make::' || u ELSE '' END AS ns, CASE WHEN z % 9 = 0 THEN 'main' ELSE lower(u) || CASE z % 5 WHEN 0 THEN '_parse_' WHEN 1 THEN '_util_' ELSE '_' END || lower(t) END AS name FROM p),
g AS (SELECT *, CASE WHEN name = 'main' THEN '__entrypoint__' || file WHEN ns <> '' THEN ns ELSE '__file__' || file END AS key, CASE WHEN name = 'main' THEN 'main@' || t || '.v' || z % 3 WHEN ns <> '' THEN ns ELSE t || '.v' || z % 3 END AS shown, 'void ' || name || '(' || t || ' * t, ' || u || ' u)' AS signature FROM f),
e AS (SELECT key, arg_min(shown, k) AS name, arg_min(ns, k) AS namespace, arg_min(file, k) AS file, arg_min(z, k) AS line, CASE WHEN bool_or(g.name = 'main') THEN 'Program Entry Point' WHEN bool_or(lower(signature) LIKE '%util%') THEN 'Utility Helpers' WHEN bool_or(lower(signature) LIKE '%parse%') THEN 'Data Transformation' ELSE 'Free Functions' END AS responsibility FROM g GROUP BY key),
m AS (SELECT key, string_agg(signature, ';' ORDER BY k, signature) AS methods FROM (SELECT key, signature, min(k) AS k FROM g GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT key, string_agg(target, ';' ORDER BY k, i, target) AS targets FROM (SELECT key, target, min(k) AS k, arg_min(i, k) AS i FROM (SELECT key, t AS target, k, 0 AS i FROM g UNION ALL SELECT key, u, k, 1 FROM g) GROUP BY 1, 2) GROUP BY 1)
SELECT * FROM e JOIN m USING (key) JOIN d USING (key)"""


def accesses(s, d):
    """What accesses of parts write, and what calls of them are told by."""
    z = F.col("p_size")
    parent = F.when(z % 4 == 0, "unary").when(z % 4 == 1, "assignment").when(z % 4 == 2, "member").otherwise("other")
    method = F.when(z % 3 == 0, "push_back").when(z % 3 == 1, "reset").otherwise(F.lower("u"))
    function = F.when(z % 5 < 2, "ioctl").when(z % 5 == 2, "mmap").otherwise(F.lower("t"))
    arguments = F.when(z % 7 == 0, F.array(F.lit("fd"))).otherwise(F.array(F.lit("fd"), F.upper("t")))
    return _parts(s, d).select("p_partkey", free_functions.is_write(parent, z % 2, method).alias("is_write"), free_functions.annotation(function, arguments).alias("annotation"))


ACCESSES = f"""SELECT p_partkey, p_size % 4 = 0 OR (p_size % 4 = 1 AND p_size % 2 = 0) OR (p_size % 4 = 2 AND p_size % 3 < 2) AS is_write,
CASE WHEN p_size % 7 <> 0 AND p_size % 5 < 3 THEN CASE WHEN p_size % 5 < 2 THEN 'ioctl' ELSE 'mmap' END || ' @ ' || upper(t) END AS annotation FROM (SELECT *, {_WORDS} FROM part)"""

QUERIES = {"X10_X11_method_types": method_types, "X2_nested_fields": nested_fields, "X4_dependencies": first_dependencies, "D10_X9_alias_fields": alias_fields, "A4_commands": commands, "X16_synthetic_classes": synthetic, "X14_X15_accesses": accesses}
SQL = {"X10_X11_method_types": METHOD_TYPES, "X2_nested_fields": NESTED_FIELDS, "X4_dependencies": FIRST_DEPENDENCIES, "D10_X9_alias_fields": ALIAS_FIELDS, "A4_commands": COMMANDS, "X16_synthetic_classes": SYNTHETIC, "X14_X15_accesses": ACCESSES}
