"""What is said of classes, modules and the project, from their structure alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.naming import explain_step, method_role

_NO_TEXTS = "CAST(array() AS array<string>)"


def _texts(c: str) -> Column:
    return F.coalesce(c, F.expr(_NO_TEXTS))


def _ordered(order: Column, value: Column) -> Column:
    """The values of a group in order, as an array."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def role(signatures: Column) -> Column:
    """The role that the methods' names tell; a signature without a name counts, but tells nothing."""
    return method_role(F.transform(signatures, lambda s: F.lower(F.regexp_extract(s, r"(?i)\b([a-z_]\w*)\s*\(", 1))))


def intent(name: Column, responsibility: Column, signatures: Column, parts: Column, bases: Column) -> Column:
    """A line on a class: its responsibility and first three parts, or its methods' role, or how many parts it has, or what it extends."""
    known = F.coalesce(responsibility, F.lit(""))
    managed = F.concat(known, F.lit(" — manages "), F.array_join(F.slice(parts, 1, 3), ", "))
    return (
        F.when(~known.isin("", "Unknown"), F.when(F.size(parts) > 0, managed).otherwise(known))
        .when(role(signatures).isNotNull(), F.concat(name, F.lit(" — "), role(signatures)))
        .when(F.size(parts) >= 3, F.concat(name, F.lit(" — coordinates "), F.size(parts).cast("string"), F.lit(" subsystems")))
        .when(F.size(bases) > 0, F.concat(name, F.lit(" — extends "), F.get(bases, 0)))
        .otherwise(name)
    )


def responsibilities(interfaces: Column) -> Column:
    """The first six methods with their parameters, cut to 50 characters, and how many more there are."""
    pattern = r"(\w+)\s*\(([^)]{0,60})"

    def line(s: Column) -> Column:
        params = F.regexp_extract(s, pattern, 2)
        short = F.when(F.length(params) < 50, params).otherwise(F.concat(F.substring(params, 1, 50), F.lit("…")))
        return F.when(s.rlike(pattern), F.concat(F.regexp_extract(s, pattern, 1), F.lit("("), short, F.lit(")")))

    lines = F.array_compact(F.transform(F.slice(interfaces, 1, 6), line))
    more = F.when(F.size(interfaces) > 6, F.array(F.concat(F.lit("… and "), (F.size(interfaces) - 6).cast("string"), F.lit(" more methods")))).otherwise(F.expr(_NO_TEXTS))
    return F.concat(lines, more)


def class_summaries(entries: DataFrame, most: int = 5) -> DataFrame:
    """name, intent, responsibilities, used_by, depends_on for ``entries``: name, ord, responsibility, interfaces, private_methods, bases, deps (target, type).

    ``used_by`` has the first ``most`` other classes in ``ord`` that depend on the name.
    """
    deps = F.coalesce("deps", F.expr("CAST(array() AS array<struct<target:string,type:string>>)"))
    users = entries.select(F.explode(F.array_distinct(F.transform(deps, lambda d: d["target"]))).alias("target"), F.col("name").alias("user"), "ord").filter("target <> user")
    users = users.withColumn("r", F.row_number().over(W.partitionBy("target").orderBy("ord", "user"))).filter(F.col("r") <= most)
    users = users.groupBy(F.col("target").alias("name")).agg(_ordered(F.col("r"), F.col("user")).alias("used_by"))
    parts = F.transform(F.filter(deps, lambda d: d["type"] == "composition"), lambda d: d["target"])
    said = intent(F.col("name"), F.col("responsibility"), F.concat(_texts("interfaces"), _texts("private_methods")), parts, _texts("bases"))
    rows = entries.select("name", said.alias("intent"), responsibilities(_texts("interfaces")).alias("responsibilities"), F.slice(F.transform(deps, lambda d: d["target"]), 1, most).alias("depends_on"))
    return rows.join(users, "name", "left").select("name", "intent", "responsibilities", _texts("used_by").alias("used_by"), "depends_on")


def _top(rows: DataFrame, key: str, order: list[Column], value: str, most: int, name: str) -> DataFrame:
    """key and an array of the first ``most`` values."""
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("r") <= most)
    return ranked.groupBy(key).agg(_ordered(F.col("r"), F.col(value)).alias(name))


def key_classes(members: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """module, key_classes: the classes that most dependencies within the module name; the first three names of a module without any. Ties go by name."""
    own, other = members.select(F.col("name").alias("src"), "module"), members.select(F.col("name").alias("dst"), F.col("module").alias("m"))
    within = edges.join(own, "src").join(other, "dst").filter("module = m").groupBy("module", "dst").agg(F.count(F.lit(1)).alias("n"))
    found = _top(within, "module", [F.desc("n"), F.col("dst")], "dst", most, "found")
    names = _top(members.select("module", "name").distinct(), "module", [F.col("name")], "name", 3, "names")
    return names.join(found, "module", "left").select("module", F.coalesce("found", "names").alias("key_classes"))


def module_summaries(members: DataFrame, edges: DataFrame, module_edges: DataFrame) -> DataFrame:
    """module, intent, key_classes, interactions: a module's three commonest responsibilities, its key classes, and the four modules it depends on most."""
    sizes = members.groupBy("module").agg(F.countDistinct("name").alias("n"))
    labels = members.filter("responsibility <> '' AND responsibility <> 'Unknown'").groupBy("module", "responsibility").agg(F.count(F.lit(1)).alias("c"))
    labels = _top(labels, "module", [F.desc("c"), F.col("responsibility")], "responsibility", 3, "labels")
    line = F.concat(F.lit('Depends on module "'), "target", F.lit('" ('), F.col("weight").cast("string"), F.lit(" connections via "), F.array_join("dep_types", ", "), F.lit(")"))
    near = _top(module_edges.select(F.col("source").alias("module"), "weight", "target", line.alias("line")), "module", [F.desc("weight"), F.col("target")], "line", 4, "interactions")
    said = F.when(F.col("labels").isNotNull(), F.concat(F.lit('Module "'), "module", F.lit('" — '), F.array_join("labels", ", "))).otherwise(F.concat(F.lit('Module "'), "module", F.lit('" with '), F.col("n").cast("string"), F.lit(" classes")))
    return sizes.join(labels, "module", "left").join(near, "module", "left").join(key_classes(members, edges), "module").select("module", said.alias("intent"), "key_classes", _texts("interactions").alias("interactions"))


def _largest(sizes: DataFrame, most: int) -> list:
    """The ``most`` largest modules (module, n); ties by name."""
    return sizes.orderBy(F.desc("n"), "module").limit(most).collect()


def project_summary(members: DataFrame, entries: DataFrame) -> DataFrame:
    """One row, text: how many classes and modules there are, the four largest modules, and the first main entry point (name, kind)."""
    sizes = members.groupBy("module").agg(F.countDistinct("name").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    parts = [f"Project with {total[0]} classes across {total[1]} modules"]
    if top := _largest(sizes, 4):
        parts.append("core modules: " + ", ".join(r["module"] for r in top))
    if main := entries.filter("kind = 'main'").orderBy("name").first():
        parts.append(f"entry via {main['name']}")
    return members.sparkSession.createDataFrame([(". ".join(parts) + ".",)], "text string")


def architecture(members: DataFrame, module_edges: DataFrame) -> DataFrame:
    """One row, text: the five largest modules and the three heaviest edges between modules."""
    sizes = members.groupBy("module").agg(F.countDistinct("name").alias("n"))
    lines = [f"This project is organized into {sizes.count()} modules.", "The largest modules are: " + ", ".join(f"{r['module']} ({r['n']} classes)" for r in _largest(sizes, 5)) + "."]
    if top := module_edges.orderBy(F.desc("weight"), "source", "target").limit(3).collect():
        lines.append("Key inter-module connections: " + ", ".join(f"{r['source']} → {r['target']} ({r['weight']})" for r in top) + ".")
    return members.sparkSession.createDataFrame([(" ".join(lines),)], "text string")


def module_contexts(members: DataFrame, module_edges: DataFrame) -> DataFrame:
    """module, text: for each module how many classes it has, what it depends on and what depends on it, heaviest first."""
    sizes = members.groupBy("module").agg(F.countDistinct("name").alias("n"))

    def side(key: str, other: str, lead: str) -> DataFrame:
        item = F.concat(other, F.lit(" ("), F.col("weight").cast("string"), F.lit(" connections)"))
        rows = module_edges.groupBy(F.col(key).alias("module")).agg(_ordered(F.struct((-F.col("weight")).alias("w"), F.col(other).alias("o")), item).alias("items"))
        return rows.select("module", F.concat(F.lit(lead), F.array_join("items", ", "), F.lit(".")).alias(key))

    out, into = side("source", "target", "It depends on: "), side("target", "source", "It is depended upon by: ")
    first = F.concat(F.lit('Module "'), "module", F.lit('" contains '), F.col("n").cast("string"), F.lit(" classes."))
    return sizes.join(out, "module", "left").join(into, "module", "left").select("module", F.concat_ws(" ", first, "source", "target").alias("text"))


def explained_chains(steps: DataFrame, *key: str) -> DataFrame:
    """``key`` and text: the steps (step, target, member, kind, is_write) of each chain as phrases joined by arrows."""
    phrase = explain_step(F.col("target"), F.col("member"), F.col("kind"), F.coalesce("is_write", F.lit(False)))
    return steps.groupBy(*key).agg(F.array_join(_ordered(F.col("step"), phrase), " → ").alias("text"))
