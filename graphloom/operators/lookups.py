"""What a reader of an index asks for: single things, parts of it, its sizes, and digests to pass on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import keep, reach
from .grouping import module_edges, modules, summary_seeds

_NO_TEXTS = "CAST(array() AS array<string>)"


def first_named(rows: DataFrame, names: DataFrame, key: str = "name", order: str = "ord") -> DataFrame:
    """The first row of each of the ``names`` (one column) by ``order``; names without a row are left out."""
    asked = names.select(F.col(names.columns[0]).alias(key)).distinct()
    nth = F.row_number().over(W.partitionBy(key).orderBy(order))
    return rows.join(F.broadcast(asked) if asked.count() <= 100_000 else asked, key, "left_semi").withColumn("r_", nth).filter("r_ = 1").drop("r_")


def bounded(rows: DataFrame, order: str = "ord", most: int = 5000, shown: int = 100) -> tuple[DataFrame, int]:
    """The rows and their number; of more than ``most``, the first ``shown``."""
    total = rows.count()
    return (rows.orderBy(order).limit(shown) if total > most else rows), total


def path_subgraph(entries: DataFrame, steps: DataFrame) -> DataFrame:
    """path, name: the entries (name) that each path's steps (path, target) name, in full or by their last part."""
    asked = steps.filter("target NOT IN ('_self_', '_meta_')").select("path", "target").distinct()  # marks that name no entry, and would meet in one task
    named = entries.select("name").distinct()
    whole = asked.join(named, asked["target"] == named["name"]).select("path", "name")
    short = named.withColumn("last", F.element_at(F.split("name", "::"), -1))
    return whole.unionByName(asked.join(short, asked["target"] == short["last"]).select("path", "name")).distinct()


def highlighted(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """name, hop, side: what the seeds (name) depend on, ``upstream``, and what depends on them, ``downstream``, at any distance."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    parts = [reach(seeds, e).filter("hop > 0").withColumn("side", F.lit(side)) for e, side in ((edges, "upstream"), (back, "downstream"))]
    return parts[0].unionByName(parts[1])


def qualified(scopes: DataFrame) -> DataFrame:
    """id, namespace: the names of the namespaces around each scope (id, parent, kind, name), joined from the outermost on.

    Nameless ones and scopes of other kinds add nothing. Each round doubles how far every scope has come, so the depth of
    nesting counts by its logarithm. A scope within itself has no namespace.
    """
    known = scopes.select("id", "parent", F.when((F.col("kind") == "namespace") & (F.col("name") != ""), F.array("name")).otherwise(F.expr(_NO_TEXTS)).alias("own"))
    steps = keep(known.join(known.select(F.col("id").alias("parent"), F.col("own").alias("around")), "parent", "left").select("id", F.when(F.col("around").isNotNull(), F.col("parent")).alias("at"), F.coalesce("around", F.expr(_NO_TEXTS)).alias("names")))
    for _ in range(max(1, steps.count()).bit_length()):
        if steps.filter("at IS NOT NULL").isEmpty():
            break
        onward = steps.select(F.col("id").alias("at"), F.col("at").alias("beyond"), F.col("names").alias("outer"))
        steps = keep(steps.join(onward, "at", "left").select("id", F.col("beyond").alias("at"), F.concat(F.coalesce("outer", F.expr(_NO_TEXTS)), "names").alias("names")))
    return steps.select("id", F.when(F.col("at").isNull(), F.array_join("names", "::")).otherwise("").alias("namespace"))


def index_stats(index) -> DataFrame:
    """docs, terms, postings: what a search index holds."""
    counts = [df.agg(F.count(F.lit(1)).alias(n)) for df, n in ((index.norms, "docs"), (index.idf, "terms"), (index.weights, "postings"))]
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))  # one row each


def build_modules(members: DataFrame, edges: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Modules with their seeds, and the edges between modules."""
    between = keep(module_edges(members, edges))
    return modules(members, edges).join(summary_seeds(members, edges, entries), "module", "left"), between


def class_digest(entries: DataFrame) -> Column:
    """The lines that tell of an entry: name, namespace, file, line, responsibility, bases, deps (target, type), interfaces, private_methods."""
    texts = lambda c: F.coalesce(c, F.expr(_NO_TEXTS))
    joined = lambda label, items, between, most=None: F.when(F.size(items) > 0, F.concat(F.lit(f"  {label}: "), F.array_join(F.slice(items, 1, most) if most else items, between), F.when(F.size(items) > most, " …").otherwise("") if most and label in ("public", "internal") else F.lit("")))
    deps = F.transform(F.coalesce("deps", F.expr("CAST(array() AS array<struct<target:string,type:string>>)")), lambda d: F.concat(d["target"], F.lit("("), d["type"], F.lit(")")))
    own = F.concat("name", F.lit("("))
    made = F.filter(texts("interfaces"), lambda s: s.contains(own))
    lines = [
        F.concat(F.lit("class "), F.when(F.coalesce("namespace", F.lit("")) != "", F.concat("namespace", F.lit("::"))).otherwise(""), "name"),
        F.concat(F.lit("  location: "), "file", F.lit(":"), F.col("line").cast("string")),
        F.when(F.coalesce("responsibility", F.lit("")) != "", F.concat(F.lit("  purpose: "), "responsibility")),
        joined("extends", texts("bases"), ", "), joined("dependencies", deps, ", "), joined("ctors", made, " | ", 3), joined("public", texts("interfaces"), "; ", 8), joined("internal", texts("private_methods"), "; ", 6),
    ]
    return F.concat_ws("\n", *lines)


def chain_digests(steps: DataFrame, *key: str) -> DataFrame:
    """``key`` and text: the steps of each chain in short, joined by arrows."""
    verb = F.when(F.coalesce("is_write", F.lit(False)), "write ").otherwise("read ")
    said = F.when(F.col("target") == "_self_", F.concat(verb, "member")).when(F.col("kind") == "call", F.concat("target", F.lit("::"), "member", F.lit("()"))).otherwise(F.concat(verb, "target", F.lit("::"), "member"))
    return steps.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", said.alias("said")))), lambda x: x["said"]), " → ").alias("text"))
