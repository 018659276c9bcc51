"""Predicates, lookups and neighbour selections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def name_filter(df: DataFrame, pattern: str | None = None, prefix: str | None = None, name: str = "name", namespace: str = "namespace") -> DataFrame:
    """Rows whose namespace starts with ``prefix`` (plainly) and whose name matches ``pattern`` in any case."""
    if prefix:
        df = df.filter(F.col(namespace).startswith(prefix))
    return df.filter(F.col(name).rlike(f"(?i){pattern}")) if pattern else df


def explore(df: DataFrame, namespace: str) -> DataFrame:
    """Rows of a namespace and of those inside it; an empty one means all."""
    return df.filter((F.col("namespace") == namespace) | F.col("namespace").startswith(namespace + "::")) if namespace else df


def search_with_neighbours(nodes: DataFrame, edges: DataFrame, pattern: str) -> DataFrame:
    """name, matched: names that match, and what they depend on. A pattern that isn't a regular expression finds nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return nodes.limit(0).select("name", F.lit(False).alias("matched"))
    hit = nodes.filter(F.col("name").rlike(f"(?i){pattern}")).select("name").distinct()
    near = edges.join(hit, edges["src"] == hit["name"], "left_semi").select(F.col("dst").alias("name")).distinct()
    return hit.withColumn("matched", F.lit(True)).unionByName(near.join(hit, "name", "left_anti").join(nodes.select("name"), "name", "left_semi").withColumn("matched", F.lit(False)))


def sidebar(members: DataFrame, needle: str) -> DataFrame:
    """module, names: modules that contain ``needle`` in their name or in a class; only the classes that do are listed."""
    low = needle.lower()
    hit = F.lower("name").contains(low)
    out = members.groupBy("module").agg(F.sort_array(F.collect_set(F.when(hit, F.col("name")))).alias("names"))
    return out.filter(F.lower("module").contains(low) | (F.size("names") > 0))


def unassigned(nodes: DataFrame, members: DataFrame) -> DataFrame:
    return nodes.join(members.select("name"), "name", "left_anti").select("name")


def as_of(points: DataFrame, starts: DataFrame, key: str, at: str, found: str) -> DataFrame:
    """``points`` (key, at, ...) with the nearest preceding start (key, at, value) as ``found``; of equal starts the smallest value.

    One union and one window: both sides are sorted together, so no range join multiplies rows.
    """
    a = points.withColumns({"side_": F.lit(1), "value_": F.lit(None).cast(starts.schema["value"].dataType)})
    b = starts.groupBy(key, at).agg(F.min("value").alias("value_")).withColumn("side_", F.lit(0))
    order = W.partitionBy(key).orderBy(at, "side_").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(found, F.last("value_", ignorenulls=True).over(order))
    return both.filter("side_ = 1").drop("side_", "value_")


def dependents_and_dependencies(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """name, rank: the selected names (0), then what they depend on (1) and who depends on them (2)."""
    one = selected.select("name").distinct()
    down = edges.join(one, edges["src"] == one["name"], "left_semi").select(F.col("dst").alias("name"), F.lit(1).alias("rank"))
    up = edges.join(one, edges["dst"] == one["name"], "left_semi").select(F.col("src").alias("name"), F.lit(2).alias("rank"))
    return one.withColumn("rank", F.lit(0)).unionByName(down).unionByName(up).groupBy("name").agg(F.min("rank").alias("rank"))


def drill_down(members: DataFrame, edges: DataFrame, module: str) -> DataFrame:
    """name, inside: the classes of a module and their neighbours outside, one edge away in either direction."""
    own = members.filter(F.col("module") == module).select("name").distinct()
    near = dependents_and_dependencies(own, edges).filter("rank > 0").select("name")
    return own.withColumn("inside", F.lit(True)).unionByName(near.withColumn("inside", F.lit(False)))


def neighbour_modules(edges: DataFrame, module: str) -> DataFrame:
    """module: those with a module edge from or to ``module``."""
    out = edges.filter(F.col("source") == module).select(F.col("target").alias("module"))
    return out.unionByName(edges.filter(F.col("target") == module).select(F.col("source").alias("module"))).distinct()


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; ``*`` crosses slashes too."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out += f"[{'^' + inner[1:] if inner[0] == '!' else inner}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^(?:{out})$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path, some folder of it, or any one component matches a pattern; backslashes part components, too.

    A pattern that ends in / stands for the folder of that name.
    """
    hit, path = F.lit(False), F.replace(path, F.lit("\\"), F.lit("/"))
    for p in patterns:
        p = p.replace("\\", "/").rstrip("/")
        hit = hit | path.rlike(glob_regex(p)) | path.rlike(glob_regex(f"**/{p}")) | path.rlike(glob_regex(f"{p}/**"))
        hit = hit | _some_part(path, glob_regex(p))
    return hit


def _some_part(path: Column, pattern: str) -> Column:
    return F.exists(F.split(path, "/"), lambda c: c.rlike(pattern))
