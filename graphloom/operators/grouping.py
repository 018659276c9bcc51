"""Modules: classify, group, roll up edges; entry points and summaries.

Nodes are (name, namespace, file, responsibility, ord); ``ord`` is the input
order and breaks ties.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import degrees

#: Namespaces and directories of other projects.
THIRD_PARTY_NAMESPACES = ("std", "__gnu_cxx", "absl", "fmt", "google::protobuf", "grpc", "nlohmann", "spdlog", "YAML", "gzip", "thread_safety_analysis")
THIRD_PARTY_DIRECTORIES = ("3rd_party", "third_party", "vendor", "extern", "build", "cmake-build", "CMakeFiles")
#: Fixed value: names of servers and applications.
ENTRY_NAME = "(?i)(^main$|Main$|Server$|App$|Application$|Handler$|Controller$|Entry$|Daemon$|Service$)"


def top_namespace(ns: Column) -> Column:
    return F.substring_index(ns, "::", 1)


def top_directory(path: Column) -> Column:
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("")


# One pattern each, not a condition for each name: the optimizer repeats these rules wherever a module is used.
def third_party_namespace(ns: Column) -> Column:
    """A name without ``::`` stands for its top namespace, one with it only for what is inside it."""
    return ns.rlike("^(?:" + "|".join(re.escape(n) + ("::" if "::" in n else r"(?:::|\z)") for n in THIRD_PARTY_NAMESPACES) + ")")


def third_party_directory(path: Column) -> Column:
    return path.rlike("^(?:" + "|".join(re.escape(d) for d in THIRD_PARTY_DIRECTORIES) + ")")


def with_module(nodes: DataFrame, include_third_party: bool = False) -> DataFrame:
    """``nodes`` with their module: top namespace, else top directory, else ``_ungrouped``."""
    ns, top = F.coalesce("namespace", F.lit("")), top_directory(F.coalesce("file", F.lit("")))
    module = F.when((ns != "") & third_party_namespace(ns), "_thirdparty").when(ns != "", top_namespace(ns)).when((top != "") & third_party_directory(top), "_thirdparty").when(top != "", top).otherwise("_ungrouped")
    out = nodes.withColumn("module", module)
    return out if include_third_party else out.filter("module <> '_thirdparty'")


def most_common(df: DataFrame, key: str, value: Column) -> DataFrame:
    """key, value: the most frequent value of each key, ties by value; blank values don't count."""
    counts = df.select(key, value.alias("value")).filter("value <> ''").groupBy(key, "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "value"))).filter("r = 1").select(key, "value")


def modules(members: DataFrame, edges: DataFrame) -> DataFrame:
    """module, namespace, directory, n_classes, class_names, internal_edges."""
    groups = members.groupBy("module").agg(F.countDistinct("name").alias("n_classes"), F.sort_array(F.collect_set("name")).alias("class_names"))
    ns = most_common(members, "module", top_namespace(F.col("namespace"))).withColumnRenamed("value", "namespace")
    directory = most_common(members, "module", top_directory(F.col("file"))).withColumnRenamed("value", "directory")
    inside = between(members, edges).filter("source = target").groupBy(F.col("source").alias("module")).agg(F.count(F.lit(1)).alias("inside"))
    joined = groups.join(ns, "module", "left").join(directory, "module", "left").join(inside, "module", "left")
    return joined.select("module", "namespace", "directory", "n_classes", "class_names", F.coalesce("inside", F.lit(0).cast("long")).alias("internal_edges"))


def between(members: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, type: edges with both ends as modules."""
    one = members.select(F.col("name").alias("src"), F.col("module").alias("source")).distinct()
    two = members.select(F.col("name").alias("dst"), F.col("module").alias("target")).distinct()
    return edges.join(one, "src").join(two, "dst").select("source", "target", "type")


def module_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, weight, dep_types: edges between different modules."""
    cross = between(members, edges).filter("source <> target")
    return cross.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"), F.sort_array(F.collect_set("type")).alias("dep_types"))


def external_deps(edges: DataFrame) -> DataFrame:
    """module, external: its module edges, heaviest first."""
    item = F.struct((-F.col("weight")).alias("w"), F.col("target").alias("target"))
    return edges.groupBy(F.col("source").alias("module")).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.concat_ws(":", x["target"], (-x["w"]).cast("string"))).alias("external"))


def entry_points(nodes: DataFrame, edges: DataFrame, hubs: int = 5, roots: int = 20, signatures: DataFrame | None = None) -> DataFrame:
    """name, kind, degree: main, server, root, hub; a class has the first kind that applies.

    Hubs are ranked before those of another kind or of degree below 2 go. ``signatures`` is (name, signature).
    """
    d = nodes.select("name", "ord").join(degrees(nodes, edges), "name")
    mains = d.limit(0).select("name") if signatures is None else signatures.filter("signature LIKE '%main(%' AND (signature LIKE '%int main%' OR signature LIKE '%void main%')").select("name").distinct()
    d = d.join(mains.withColumn("is_main", F.lit(True)), "name", "left")
    kind = F.when(F.col("is_main"), "main").when(F.col("name").rlike(ENTRY_NAME), "server")
    d = d.withColumn("kind", kind)
    hub = d.orderBy(F.desc("in_degree"), "ord").limit(hubs).filter("in_degree >= 2")
    root = d.filter("kind IS NULL AND in_degree = 0 AND out_degree >= 2").orderBy(F.desc("out_degree"), "ord").limit(roots)
    named = d.filter("kind IS NOT NULL").select("name", "kind", F.col("out_degree").alias("degree"))
    root = root.select("name", F.lit("root").alias("kind"), F.col("out_degree").alias("degree"))
    hub = hub.filter("kind IS NULL").select("name", F.lit("hub").alias("kind"), F.col("in_degree").alias("degree")).join(root, "name", "left_anti")
    return named.unionByName(root).unionByName(hub)


def summary_seeds(members: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """module, seed: a line on size, top three responsibilities, hub and up to two entry points."""
    groups = members.groupBy("module").agg(F.countDistinct("name").alias("n"))
    labels = members.filter("responsibility <> ''").groupBy("module", "responsibility").agg(F.count(F.lit(1)).alias("c"))
    labels = labels.withColumn("r", F.row_number().over(W.partitionBy("module").orderBy(F.desc("c"), "responsibility"))).filter("r <= 3")
    labels = labels.groupBy("module").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "responsibility"))), lambda x: x["responsibility"]), ", ").alias("labels"))
    into = edges.filter("src <> dst").groupBy(F.col("dst").alias("name")).agg(F.countDistinct("src").alias("k"))
    hub = members.join(into, "name").withColumn("r", F.row_number().over(W.partitionBy("module").orderBy(F.desc("k"), "name"))).filter("r = 1 AND k > 1").select("module", F.col("name").alias("hub"), "k")
    eps = members.join(entries.select("name"), "name", "left_semi").withColumn("r", F.row_number().over(W.partitionBy("module").orderBy("ord"))).filter("r <= 2")
    eps = eps.groupBy("module").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ", ").alias("eps"))
    j = groups.join(labels, "module", "left").join(hub, "module", "left").join(eps, "module", "left")
    seed = F.concat_ws(". ", F.concat(F.lit('Module "'), "module", F.lit('" contains '), F.col("n").cast("string"), F.when(F.col("n") == 1, " class").otherwise(" classes")), F.concat(F.lit("primarily responsible for "), "labels"), F.concat(F.lit("Key hub: "), "hub", F.lit(" (used by "), F.col("k").cast("string"), F.lit(" classes)")), F.concat(F.lit("Entry via "), "eps"))
    return j.select("module", F.concat(seed, F.lit(".")).alias("seed"))
