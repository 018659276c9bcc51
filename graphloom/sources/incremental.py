"""Incremental ingest by content hash.

State is (path, hash, entries). A scan classifies files against it, parses only
what changed, and merges cached with new entries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def with_hash(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with hash; files without readable content are left out."""
    return files.withColumn("hash", F.sha2(F.col(content).cast("binary"), 256)).filter("hash IS NOT NULL")


def classify(state: DataFrame, files: DataFrame) -> DataFrame:
    """path, status: unchanged, changed (new files too) or deleted."""
    a, b = state.select("path", F.col("hash").alias("old")), files.select("path", F.col("hash").alias("new"))
    status = F.when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def evict(state: DataFrame, files: DataFrame) -> DataFrame:
    """State without files that are gone or excluded now."""
    return state.join(files.select("path"), "path", "left_semi")


def merged(cached: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Cached and fresh entries; of equal keys the fresh one, and of several the last ordinal."""
    both = cached.withColumn("turn_", F.lit(0)).unionByName(fresh.withColumn("turn_", F.lit(1)))
    best = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("turn_"), F.desc("ordinal")))
    return both.withColumn("r_", best).filter("r_ = 1").drop("r_", "turn_")


def merge_units(entries: DataFrame) -> DataFrame:
    """key, signature, steps across translation units (key, unit, signature, steps): the newest entry of a key wins, and an empty call sequence takes over the last one of the same signature."""
    newest = entries.groupBy("key").agg(F.max("unit").alias("unit"))
    order = W.partitionBy("key", "signature").orderBy("unit").rowsBetween(W.unboundedPreceding, 0)
    kept = F.last(F.when(F.size("steps") > 0, F.col("steps")), ignorenulls=True).over(order)
    filled = entries.withColumn("steps", F.coalesce(kept, F.col("steps")))
    return filled.join(newest, ["key", "unit"], "left_semi").select("key", "signature", "steps")


def trusted(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges of trusted types, and others whose target is a known key."""
    own = F.col("type").isin("composition", "aggregation", "inheritance")
    return edges.filter(own).unionByName(edges.filter(~own).join(known.select(F.col("key").alias("dst")).distinct(), "dst", "left_semi").select(*edges.columns))


def state_schema(entry: StructType) -> StructType:
    """Schema of a state whose entries have the fields of ``entry``."""
    return StructType([StructField("path", StringType()), StructField("hash", StringType()), StructField("entries", ArrayType(entry))])


def by_file(entries: DataFrame, files: DataFrame) -> DataFrame:
    """``entries`` with path, the file of ``files`` that their ``location`` names, or else the first whose path ends in it; null if there is none.

    Only files with the same last part of the path are compared.
    """
    last = lambda c: F.substring_index(c, "/", -1)
    named = files.select(F.col("path").alias("path_")).distinct()
    places = entries.filter("location <> ''").select(F.col("location").alias("location_")).distinct()
    near = places.join(named, last(places["location_"]) == last(named["path_"])).filter("endswith(path_, location_)")
    first = near.groupBy("location_").agg(F.min(F.struct(F.col("path_") != F.col("location_"), F.col("path_").alias("path")))["path"].alias("path"))
    return entries.join(first, entries["location"] == first["location_"], "left").drop("location_")


def scan(state: DataFrame, files: DataFrame, parse: Callable[[DataFrame], DataFrame], key: list[str], save: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Entries of all ``files`` (path, content) and the state after the scan; only new and changed files are parsed.

    ``parse`` turns files into entries: location, ordinal and further fields,
    ``key`` among them, as in the entries of ``state``. An entry of no known
    file counts in this scan and isn't kept. Of entries with equal keys the one
    parsed now stays, else that of the last path. ``save`` writes the new state
    and reads it back, so that parsing runs once; an empty file list gives an empty state.
    """
    entry = state.schema["entries"].dataType.elementType
    found = with_hash(files)
    status = classify(state, found)
    todo = found.join(status.filter("status = 'changed'"), "path", "left_semi")
    parsed = save(by_file(parse(todo.drop("hash")).select(*entry.names), todo))
    held = parsed.filter("path IS NOT NULL").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ordinal", F.struct(*entry.names).alias("e"))))["e"].alias("entries"))
    new = todo.select("path", "hash").join(held, "path", "left").withColumn("entries", F.coalesce("entries", F.array().cast(ArrayType(entry))))
    same = evict(state, found).join(status.filter("status = 'unchanged'"), "path", "left_semi")
    cached = same.select("path", F.explode("entries").alias("e")).select("path", "e.*")
    order = lambda df: df.withColumn("ordinal", F.struct(F.coalesce("path", F.lit("")).alias("path"), "ordinal"))
    entries = merged(order(cached), order(parsed.select("path", *entry.names)), key).withColumn("ordinal", F.col("ordinal.ordinal"))
    return entries, save(same.select("path", "hash", "entries").unionByName(new))


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """Whole versions of a stored state, the oldest first."""
    jvm = spark._jvm.org.apache.hadoop.fs
    done = jvm.Path(f"{folder}/version=*/_SUCCESS")
    found = done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done) or []
    return sorted(x.getPath().getParent().toString() for x in found)


def save_state(state: DataFrame, folder: str, number: int | None = None) -> DataFrame:
    """``state`` as a new version in ``folder``, the next one if it has no ``number``, read back from there. A version counts once it is whole, so a lost job leaves the one before."""
    spark = state.sparkSession
    if number is None:
        known = _versions(spark, folder)
        number = _number(known[-1]) + 1 if known else 0
    path = f"{folder}/version={number:09d}"
    state.write.mode("overwrite").parquet(path)
    return spark.read.schema(state.schema).parquet(path)


def _number(version: str) -> int:
    return int(version.rpartition("=")[2])


def state_before(spark: SparkSession, folder: str, number: int, schema: StructType, exactly: int | None = None) -> DataFrame | None:
    """The newest whole version below ``number``, an empty state if there is none; with ``exactly``, that version or None."""
    known = [v for v in _versions(spark, folder) if _number(v) < number and exactly in (None, _number(v))]
    if not known:
        return spark.createDataFrame([], schema) if exactly is None else None
    return spark.read.schema(schema).parquet(known[-1])


def load_state(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The newest whole version in ``folder``; an empty state if there is none, or if it has another schema."""
    known = _versions(spark, folder)
    empty = spark.createDataFrame([], schema)
    if not known:
        return empty
    found = spark.read.parquet(known[-1])
    return found if found.schema.simpleString() == schema.simpleString() else empty


def invalidate(spark: SparkSession, folder: str, schema: StructType) -> None:
    """Let the next scan parse every file: an empty state becomes the newest version."""
    save_state(spark.createDataFrame([], schema), folder)


def diagnostics(rows: DataFrame) -> DataFrame:
    """severity, spelling: each message once."""
    return rows.select("severity", "spelling").distinct()


def cache_stats(state: DataFrame) -> DataFrame:
    """files, entries: what the state holds."""
    return state.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.size("entries")), F.lit(0)).cast("long").alias("entries"))
