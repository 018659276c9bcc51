"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of the class [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


#: Folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, spark.checkpoint.dir.

    Where that is unset, a temporary folder if they are one process, else a ValueError: no other folder is known to be shared.
    """
    app = spark.sparkContext.applicationId
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="graphloom-"))
    return f"{found.rstrip('/')}/graphloom-{app}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: what follows can be redone from files that outlive
    any executor. Files stay until the shared folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What a Python worker keeps from task to task, by name.
CACHES: dict[str, dict] = {}


def cache(name: str) -> dict:
    return CACHES.setdefault(name, {})


def drop_caches(but: str | None) -> None:
    for name, held in CACHES.items():
        if name != but:
            held.clear()


def give_back() -> None:
    """Return memory that was freed: Spark reuses its Python workers, and an idle one would go on holding what its largest task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches], keeps: str | None = None) -> Callable[[Batches], Batches]:
    """``run`` as a task that first drops the caches of other operators in its worker, but for ``keeps``, and gives back memory at its end."""

    def task(batches: Batches) -> Batches:
        drop_caches(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What runs inside hands Python ``rows`` rows at a time, or fewer if the session says so."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(df: DataFrame, col: str) -> Column:
    """The column as string, null as empty."""
    return F.coalesce(df[col].cast("string"), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1; rows without an id count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def maybe_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast ``df`` if its counted ``rows`` are within ``limit``; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if rows <= limit else df
