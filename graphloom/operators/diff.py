"""Snapshots: what was added, removed and modified, and what that touches.

A snapshot is (name, interfaces, bases, attributes, risk, file, deps) with
arrays of strings and deps an array of (target, type) in input order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.snapshots import UNKNOWN, Store
from .graph import impact, keep


def structural_hash(deps: Column, *arrays: Column) -> Column:
    """Twelve hex digits over the sorted arrays and target:type pairs; risk and place don't count. A null array is an empty one."""
    pairs = F.transform(deps, lambda d: F.concat_ws(":", d["target"], d["type"]))
    parts = [F.coalesce(F.array_join(F.sort_array(a), "\x1f"), F.lit("")) for a in (*arrays, pairs)]
    return F.substring(F.sha2(F.concat_ws("\x1e", *parts), 256), 1, 12)


def dep_map(deps: DataFrame) -> DataFrame:
    """name, target, type from (name, target, type, pos): the last type of each target wins."""
    last = F.max(F.struct("pos", "type")).alias("last")
    return deps.groupBy("name", "target").agg(last).select("name", "target", "last.type")


def diff_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, change: added, removed or common."""
    a = old.select("name").distinct().withColumn("o", F.lit(True))
    b = new.select("name").distinct().withColumn("n", F.lit(True))
    return a.join(b, "name", "full_outer").select("name", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("common").alias("change"))


def diff_deps(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, target, change, old_type, new_type from dep maps (name, target, type): equal ones are left out."""
    a = old.select("name", "target", F.col("type").alias("old_type"))
    b = new.select("name", "target", F.col("type").alias("new_type"))
    both = a.join(b, ["name", "target"], "full_outer").filter("NOT (old_type <=> new_type)")
    return both.select("name", "target", F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").otherwise("retyped").alias("change"), "old_type", "new_type")


def diff_classes(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, change, interfaces_added, interfaces_removed, dep_changes, risk_change, file_change of snapshots with a ``hash``.

    Common names with equal hashes aren't reported, even if risk or place
    differ. Those with other hashes are if their interfaces, dependencies, risk
    or file changed, so a change of attributes or bases alone isn't reported. A
    risk change needs both risks. ``dep_changes`` holds (target, change,
    old_type, new_type) in the order of targets. Snapshots may lack ``deps`` and ``file``.
    """
    none, no_deps = F.array().cast("array<string>"), F.array().cast("array<struct<target:string,change:string,old_type:string,new_type:string>>")

    kinds = "array<struct<target:string,type:string>>"

    def side(df: DataFrame, mark: str) -> DataFrame:
        place = F.col("file") if "file" in df.columns else F.lit(None).cast("string")
        deps = F.transform("deps", lambda d: F.struct(d["target"].alias("target"), d["type"].alias("type"))) if "deps" in df.columns else F.array()
        return df.select("name", F.coalesce("interfaces", none).alias(f"{mark}_interfaces"), F.col("risk").alias(f"{mark}_risk"), F.col("hash").alias(f"{mark}_hash"), place.alias(f"{mark}_file"), deps.cast(kinds).alias(f"{mark}_deps"))

    # Dependencies are taken apart only of names whose hashes differ.
    j = keep(side(old, "o").join(side(new, "n"), "name", "full_outer").filter("NOT (o_hash <=> n_hash)"))

    def targets(deps: str) -> DataFrame:
        rows = j.filter("o_hash IS NOT NULL AND n_hash IS NOT NULL").select("name", F.posexplode(deps).alias("pos", "dep"))
        return dep_map(rows.select("name", "dep.target", "dep.type", "pos"))

    moved = diff_deps(targets("o_deps"), targets("n_deps")).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("target", "change", "old_type", "new_type"))).alias("dep_changes"))
    j = j.join(moved, "name", "left")
    both = F.col("o_hash").isNotNull() & F.col("n_hash").isNotNull()
    change = F.when(F.col("o_hash").isNull(), "added").when(F.col("n_hash").isNull(), "removed").otherwise("modified")
    risky = both & (F.col("o_risk") != "") & (F.col("n_risk") != "") & (F.col("o_risk") != F.col("n_risk"))
    elsewhere = both & ~F.col("o_file").eqNullSafe(F.col("n_file"))
    delta = lambda x, y: F.when(both, F.sort_array(F.array_except(x, y))).otherwise(none)
    out = j.select(
        "name",
        change.alias("change"),
        delta("n_interfaces", "o_interfaces").alias("interfaces_added"),
        delta("o_interfaces", "n_interfaces").alias("interfaces_removed"),
        F.when(both, F.coalesce("dep_changes", no_deps)).otherwise(no_deps).alias("dep_changes"),
        F.when(risky, F.concat_ws("->", "o_risk", "n_risk")).alias("risk_change"),
        F.when(elsewhere, F.concat(F.coalesce("o_file", F.lit("")), F.lit("->"), F.coalesce("n_file", F.lit("")))).alias("file_change"),
    )
    return out.filter("change <> 'modified' OR size(interfaces_added) + size(interfaces_removed) + size(dep_changes) > 0 OR risk_change IS NOT NULL OR file_change IS NOT NULL")


def diff_modules(old: DataFrame, new: DataFrame) -> DataFrame:
    """module, change, classes_added, classes_removed from (module, class_names); unchanged ones are left out."""
    a, b = old.select("module", F.col("class_names").alias("o")), new.select("module", F.col("class_names").alias("n"))
    none = F.array().cast("array<string>")
    j = a.join(b, "module", "full_outer")
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    plus = F.when(both, F.sort_array(F.array_except("n", "o"))).otherwise(none)
    minus = F.when(both, F.sort_array(F.array_except("o", "n"))).otherwise(none)
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("modified")
    return j.select("module", change.alias("change"), plus.alias("classes_added"), minus.alias("classes_removed")).filter("change <> 'modified' OR size(classes_added) + size(classes_removed) > 0")


#: The columns of ``change_rows`` and their types.
CHANGE = {
    "section": "string", "name": "string", "file": "string", "pattern": "string", "risk": "string", "interfaces_added": "array<string>", "interfaces_removed": "array<string>",
    "dep_changes": "array<struct<target:string,change:string,old_type:string,new_type:string>>", "risk_change": "string", "file_change": "string", "classes_added": "array<string>", "classes_removed": "array<string>",
}


def change_rows(old: DataFrame, new: DataFrame, classes: DataFrame, modules: DataFrame, edges: DataFrame, max_hops: int = 3) -> DataFrame:
    """section, name and what there is to say: a row for each class and module that changed and each class that this reaches.

    Sections are added, removed, modified, modules_added, modules_removed, modules_modified, impact_direct, impact_indirect.
    Added classes have file, pattern and risk, removed ones their file, as the snapshots have them.
    """
    place = lambda df: df.select("name", *((F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in ("file", "pattern", "risk")))

    def rows(df: DataFrame, section: Column) -> DataFrame:
        df = df.withColumn("section", section)
        return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in CHANGE.items()))

    kind = F.col("change")
    names = lambda what: classes.filter(kind == what).select("name")
    hit = impact(classes.select("name"), edges, max_hops)
    parts = (
        rows(names("added").join(place(new), "name"), F.lit("added")),
        rows(names("removed").join(place(old).drop("pattern", "risk"), "name"), F.lit("removed")),
        rows(classes.filter(kind == "modified"), F.lit("modified")),
        rows(modules.withColumnRenamed("module", "name"), F.concat(F.lit("modules_"), kind)),
        rows(hit.select("name", "kind"), F.concat(F.lit("impact_"), F.col("kind"))),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def diff_refs(store: Store, old_ref: str, new_ref: str, max_hops: int = 3) -> DataFrame | None:
    """``change_rows`` between two refs of a store, with the new one's commit, author, email, date and message; None if either is missing or nothing changed.

    A ref holds classes (a snapshot with ``hash``), modules (module, class_names) and edges (src, dst); the latter two may be missing.
    """
    old, new = store.load(old_ref), store.load(new_ref)
    if old is None or new is None:
        return None
    spark = store.spark
    no_modules, no_edges = spark.createDataFrame([], "module string, class_names array<string>"), spark.createDataFrame([], "src string, dst string")
    classes = keep(diff_classes(old["classes"], new["classes"]))
    modules = keep(diff_modules(old.get("modules", no_modules), new.get("modules", no_modules)))
    if classes.isEmpty() and modules.isEmpty():
        return None
    said = store.meta(new_ref)
    found = change_rows(old["classes"], new["classes"], classes, modules, new.get("edges", no_edges), max_hops)
    return found.select(*(F.lit(said[k]).alias(k) for k in UNKNOWN), *CHANGE)


def change_record(meta: dict[str, str], classes: DataFrame, modules: DataFrame, edges: DataFrame, max_hops: int = 3) -> DataFrame | None:
    """One row that records a change: commit, names of classes and modules by kind, and impact of all changed classes; None if nothing changed.

    The row holds every changed name, so it is for a report; ``classes`` and ``modules`` are its tables at any size.
    """
    if classes.isEmpty() and modules.isEmpty():
        return None
    names = lambda df, key, kind: df.filter(F.col("change") == kind).agg(F.sort_array(F.collect_list(key)).alias(f"{key}s_{kind}"))
    touched = impact(classes.select("name"), edges, max_hops)
    hit = touched.groupBy().agg(F.sort_array(F.collect_list(F.when(F.col("kind") == "direct", F.col("name")))).alias("impact_direct"), F.sort_array(F.collect_list(F.when(F.col("kind") == "indirect", F.col("name")))).alias("impact_indirect"))
    out = classes.sparkSession.range(1).select(*[F.lit(meta.get(k, "unknown")).alias(k) for k in ("commit", "author")], *[F.lit(meta.get(k, other)).alias(k) for k, other in (("email", ""), ("date", "unknown"), ("message", ""), ("index_file", ""))])
    for part in (*(names(classes, "name", k) for k in ("added", "removed", "modified")), *(names(modules, "module", k) for k in ("added", "removed", "modified")), hit):
        out = out.join(F.broadcast(part))  # one row each
    return out
