"""Edges and what follows from them: inversion, degrees, reachability, calls, accesses.

Edges are (src, dst, type, pos). Traversals join the frontier with the edges
and anti-join what is known; each hop is written to the shared folder, so its
lineage doesn't grow and a lost executor costs no earlier hop.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir.

    Where that is unset, a temporary folder if driver and executors are one process, else a ValueError: no other folder is known to be shared.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="graphloom-"))
    return f"{base.rstrip('/')}/graphloom-{app}"


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in spark.checkpoint.dir and read back."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows whose measured size is below this are broadcast.
SMALL = "10MB"
#: What a task reads of a file and of a shuffle at most, as stored; in memory rows take a multiple of it.
FILE_PART, SHUFFLE_PART = "16MB", "16MB"


def measure_joins(spark: SparkSession) -> None:
    """Let joins of this session broadcast by measured sizes only, and bound what one task takes.

    Estimates go by the compressed size of files and don't see what an explode adds, so they broadcast tables of
    millions of rows through the driver; the sizes that adaptive execution measures are those of the rows.
    """
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", SMALL)
    spark.conf.set("spark.sql.files.maxPartitionBytes", FILE_PART)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLE_PART)


def reverse_deps(edges: DataFrame) -> DataFrame:
    """name, dependents (sorted, distinct): inverted edges without empty ends and self loops."""
    ok = edges.filter("src <> '' AND dst <> '' AND src <> dst")
    return ok.groupBy(F.col("dst").alias("name")).agg(F.sort_array(F.collect_set("src")).alias("dependents"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, in_degree (distinct sources), out_degree (rows)."""
    into = edges.filter("src <> dst").groupBy(F.col("dst").alias("name")).agg(F.countDistinct("src").alias("in_degree"))
    out = edges.groupBy(F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("out_degree"))
    zero = F.lit(0).cast("long")
    return nodes.select("name").join(into, "name", "left").join(out, "name", "left").select("name", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))


#: Names of a frontier that are broadcast at most; more meet the edges by a shuffle.
FRONTIER = 100_000


def reach(seeds: DataFrame, edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """name, hop: what the seeds (name) reach along edges (src, dst), at its smallest hop; seeds are hop 0."""
    steps = keep(edges.select("src", "dst").distinct())
    known = keep(seeds.select("name").distinct().withColumn("hop", F.lit(0)))
    frontier, hop, many = known, 0, known.count()
    while many and (max_hops is None or hop < max_hops):
        hop += 1
        ahead = frontier.select(F.col("name").alias("src"))
        found = steps.join(F.broadcast(ahead) if many <= FRONTIER else ahead, "src").select(F.col("dst").alias("name")).distinct()
        frontier = keep(found.join(known, "name", "left_anti").withColumn("hop", F.lit(hop)))
        many = frontier.count()
        if many:
            known = known.unionByName(frontier)
    return known


def impact(seeds: DataFrame, edges: DataFrame, max_hops: int | None = 3) -> DataFrame:
    """name, hop, kind: who depends on the seeds, ``direct`` at hop 1 and ``indirect`` beyond; seeds are left out."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = reach(seeds, back, max_hops).filter("hop > 0")
    return found.withColumn("kind", F.when(F.col("hop") == 1, "direct").otherwise("indirect"))


def neighbourhood(seeds: DataFrame, edges: DataFrame, hops: int, known: DataFrame | None = None) -> DataFrame:
    """name, hop within ``hops`` steps along edges in both directions, bases among them; with ``known`` (name), of its names only."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = reach(seeds, both, hops)
    return found if known is None else found.join(known.select("name").distinct(), "name", "left_semi")


def call_paths(start: DataFrame, calls: DataFrame, max_depth: int = 10) -> DataFrame:
    """root, path, depth, node, repeat: call trees as flat rows; a node that repeats on its own path is a leaf.

    ``start`` is (root); ``calls`` is (src, dst). The path carries what was visited.
    """
    steps = calls.select("src", "dst").distinct()
    level = keep(start.select("root", F.array("root").alias("path"), F.lit(0).alias("depth"), F.col("root").alias("node"), F.lit(False).alias("repeat")))
    out, depth = level, 0
    while depth < max_depth:
        depth += 1
        grown = level.filter("NOT repeat").join(steps, level["node"] == steps["src"])
        level = keep(grown.select("root", F.concat("path", F.array("dst")).alias("path"), F.lit(depth).alias("depth"), F.col("dst").alias("node"), F.array_contains("path", F.col("dst")).alias("repeat")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def resolved(steps: DataFrame) -> DataFrame:
    """Call steps without ``_meta_``; ``_self_`` names the calling class."""
    return steps.filter("target <> '_meta_'").withColumn("target", F.when(F.col("target") == "_self_", F.col("class")).otherwise(F.col("target")))


def caller_index(steps: DataFrame) -> DataFrame:
    """callee, callers: who calls each target::member; not de-duplicated, fields left out."""
    calls = resolved(steps).filter("kind = 'call'")
    return calls.groupBy(F.concat_ws("::", "target", "member").alias("callee")).agg(F.sort_array(F.collect_list(F.concat_ws("::", "class", "method"))).alias("callers"))


def field_accessors(steps: DataFrame) -> DataFrame:
    """field, readers, writers: distinct methods by kind of access; an unknown flag counts as reading."""
    fields = resolved(steps).filter("kind = 'field'").withColumn("w", F.coalesce("is_write", F.lit(False)))
    who = F.concat_ws("::", "class", "method")
    return fields.groupBy(F.concat_ws("::", "target", "member").alias("field")).agg(F.sort_array(F.collect_set(F.when(~F.col("w"), who))).alias("readers"), F.sort_array(F.collect_set(F.when(F.col("w"), who))).alias("writers"))


def truncated_steps(steps: DataFrame, most: int = 200) -> DataFrame:
    """class, method, step, target, member: the first ``most`` steps, and a marker where there were as many or more."""
    kept = steps.filter(F.col("step") <= most).select("class", "method", F.col("step").cast("long").alias("step"), "target", "member")
    over = steps.filter(F.col("step") == most).select("class", "method", F.lit(most + 1).cast("long").alias("step"), F.lit("_meta_").alias("target"), F.lit("truncated").alias("member"))
    return kept.unionByName(over)


def type_usage(edges: DataFrame) -> DataFrame:
    """name, field, param, base, other: how often each type is used, by kind of dependency; self use is left out."""
    kind = lambda *t: F.count_if(F.col("type").isin(*t))
    return edges.filter("src <> dst").groupBy(F.col("dst").alias("name")).agg(kind("composition", "aggregation").alias("as_field"), kind("association").alias("as_param"), kind("inheritance").alias("as_base"), kind("dependency").alias("as_local"))
