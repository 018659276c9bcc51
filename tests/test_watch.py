"""A watched folder: batches that run again, files that go."""

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from graphloom.sources import incremental
from graphloom.streaming import watch

ENTRY = StructType([StructField("location", StringType()), StructField("ordinal", LongType()), StructField("name", StringType())])


def parse(files):
    """One entry for each word of a file."""
    words = F.split(F.col("content").cast("string"), " ")
    return files.select(F.col("path").alias("location"), F.posexplode(words).alias("ordinal", "name")).withColumn("ordinal", F.col("ordinal").cast("long"))


def held(spark, states):
    state = incremental.load_state(spark, states, incremental.state_schema(ENTRY))
    return {r["path"].rpartition("/")[2]: [e["name"] for e in r["entries"]] for r in state.collect()}


def test_batches_commit_once_and_deleted_files_go(spark, tmp_path):
    folder, states = tmp_path / "in", f"file://{tmp_path}/states"
    folder.mkdir()
    (folder / "a.h").write_text("one two")
    (folder / "b.h").write_text("three")
    (folder / "skip.txt").write_text("no")
    run = lambda: watch.watch(spark, f"file://{folder}", f"file://{tmp_path}/checkpoint", states, parse, ["name"], ENTRY, "*.h").awaitTermination()
    run()
    assert held(spark, states) == {"a.h": ["one", "two"], "b.h": ["three"]}
    (folder / "b.h").unlink()
    (folder / "c.h").write_text("four")
    run()
    assert held(spark, states) == {"a.h": ["one", "two"], "c.h": ["four"]}
    run()
    assert held(spark, states) == {"a.h": ["one", "two"], "c.h": ["four"]}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    states, calls = f"file://{tmp_path}/states", []

    def counted(files):
        calls.append(1)
        return parse(files)

    def commit(rows, number, live):
        batch = spark.createDataFrame([(p, c.encode()) for p, c in rows], "path string, content binary")
        return watch.commit_batch(batch, number, spark.createDataFrame([(p,) for p in live], "path string"), states, counted, ["name"], ENTRY)

    commit([("/a", "x y"), ("/b", "z")], 0, ["/a", "/b"])
    commit([("/c", "w")], 1, ["/a", "/c"])
    before = held(spark, states)
    assert before == {"a": ["x", "y"], "c": ["w"]} and len(calls) == 2
    commit([("/c", "w")], 1, ["/a", "/c"])
    commit([("/a", "x y"), ("/b", "z")], 0, ["/a", "/b"])
    assert held(spark, states) == before and len(calls) == 2
    (tmp_path / "states" / "version=000000002").rename(tmp_path / "gone")  # the state of batch 1 is lost before it is whole
    commit([("/c", "w")], 1, ["/a", "/c"])
    assert held(spark, states) == before and len(calls) == 3
