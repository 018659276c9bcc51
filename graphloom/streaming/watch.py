"""Watching a folder: files that arrive are scanned as micro-batches, and each batch commits one state.

A state's number is its batch's, so a batch that runs again after a failure finds its
state whole and changes nothing, or writes it anew from the state before it. Files
that are gone leave the state with the next batch. The file source tells of a path
once: a file that is written again under its old name is seen by ``incremental.scan``, not here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.graph import keep
from ..sources import incremental

SOURCE = "path string, modificationTime timestamp, length long, content binary"


def commit_batch(batch: DataFrame, number: int, live: DataFrame, states: str, parse: Callable[[DataFrame], DataFrame], key: list[str], entry: StructType) -> DataFrame:
    """The state after batch ``number``, as a version of the folder ``states``; written only if it isn't there.

    ``batch`` is (path, content); ``live`` (path) lists what exists. Files that the state has with the same hash aren't parsed.
    """
    spark, schema = batch.sparkSession, incremental.state_schema(entry)
    done = incremental.state_before(spark, states, number + 2, schema, exactly=number + 1)
    if done is not None:
        return done
    before = incremental.state_before(spark, states, number + 1, schema)
    files = keep(batch.select("path", "content"))
    paths = files.select("path").distinct()
    _, new = incremental.scan(before.join(paths, "path", "left_semi"), files, parse, key, keep)
    rest = before.join(paths, "path", "left_anti").join(live.select("path").distinct(), "path", "left_semi")
    state = rest.select("path", "hash", "entries").unionByName(new.join(live.select("path").distinct(), "path", "left_semi"))
    return incremental.save_state(state, states, number + 1)


def watch(spark: SparkSession, folder: str, checkpoint: str, states: str, parse: Callable[[DataFrame], DataFrame], key: list[str], entry: StructType, pattern: str = "*") -> StreamingQuery:
    """Scans what has arrived in ``folder`` since the last call, then stops; ``checkpoint`` remembers the files and ``states`` the entries."""

    def read(reader):
        return reader.format("binaryFile").schema(SOURCE).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)

    def handle(batch: DataFrame, number: int) -> None:
        commit_batch(batch, number, read(batch.sparkSession.read).select("path"), states, parse, key, entry)

    return read(spark.readStream).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
