"""Free functions as methods of entries that no class stands behind.

A function belongs to its namespace, or else to its file; each main function is an
entry of its own. What an entry says follows from sums over its functions, so a
namespace of any size is spread; methods and dependencies are rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.extraction import FREE_FUNCTIONS
from .graph import keep

#: What entries are called and said to do where nothing else tells.
ENTRY_POINT, OTHERS = "Program Entry Point", "Free Functions"
#: Methods that change what they are called on.
MUTATING = (
    "emplace", "emplace_back", "emplace_front", "emplace_hint", "push_back", "push_front", "push", "enqueue", "insert", "insert_or_assign", "try_emplace",
    "erase", "pop", "pop_back", "pop_front", "clear", "remove", "remove_if", "swap", "assign", "resize", "replace", "reset", "release",
    "set_value", "store", "append", "add", "put", "operator=", "operator[]",
)
#: Functions whose second argument says what they do.
SYSCALLS = ("ioctl", "fcntl", "prctl", "mmap", "setsockopt")


def is_write(parent: Column, operand: Column, method: Column) -> Column:
    """Whether an access writes: the operand of a unary operator, the first one of an assignment, or what a changing method is called on.

    ``parent`` is unary, assignment, compound or member; ``operand`` counts from 0.
    """
    return F.coalesce((parent == "unary") | (parent.isin("assignment", "compound") & (operand == 0)) | ((parent == "member") & method.isin(*MUTATING)), F.lit(False))


def annotation(function: Column, arguments: Column) -> Column:
    """``ioctl @ COMMAND`` for calls of such functions with a named second argument; null for others."""
    command = F.get(arguments, 1)
    return F.when(function.isin(*SYSCALLS) & (command != ""), F.concat(function, F.lit(" @ "), command))


@dataclass
class Synthetic:
    """entries (key, name, namespace, file, line, responsibility), methods (key, nth, signature, line), dependencies (key, nth, target, type)."""

    entries: DataFrame
    methods: DataFrame
    dependencies: DataFrame


def synthetic(functions: DataFrame) -> Synthetic:
    """Entries for ``functions``: ord, file, namespace, name, signature, line, param_types.

    Of equal signatures of an entry the first counts. An entry lies where its first function does, and depends on the types of
    all parameters, in the order in which they come.
    """
    stem = F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1)
    is_main, spaced = F.col("name") == "main", F.coalesce("namespace", F.lit("")) != ""
    key = F.when(is_main, F.concat(F.lit("__entrypoint__"), "file")).when(spaced, F.col("namespace")).otherwise(F.concat(F.lit("__file__"), "file"))
    shown = F.when(is_main, F.concat(F.lit("main@"), stem)).when(spaced, F.col("namespace")).otherwise(stem)
    rows = keep(functions.select(key.alias("key"), shown.alias("shown"), is_main.alias("is_main"), F.coalesce("namespace", F.lit("")).alias("namespace"), "ord", "file", "line", "signature", "param_types"))
    text = F.lower(F.concat_ws(" ", "shown", "signature"))
    rank = F.coalesce(*[F.when(text.rlike(p), i) for i, (p, _) in enumerate(FREE_FUNCTIONS)], F.lit(len(FREE_FUNCTIONS)))
    first = F.min_by(F.struct("shown", "namespace", "file", "line"), "ord").alias("first")
    found = rows.groupBy("key").agg(first, F.max("is_main").alias("is_main"), F.min(rank).alias("rank"))
    said = F.coalesce(F.when(F.col("is_main"), ENTRY_POINT), *[F.when(F.col("rank") == i, label) for i, (_, label) in enumerate(FREE_FUNCTIONS)], F.lit(OTHERS))
    entries = found.select("key", F.col("first.shown").alias("name"), "first.namespace", "first.file", "first.line", said.alias("responsibility"))
    nth = lambda *order: F.row_number().over(W.partitionBy("key").orderBy(*order))
    methods = rows.groupBy("key", "signature").agg(F.min(F.struct("ord", "line")).alias("at"))
    methods = methods.select("key", nth("at", "signature").alias("nth"), "signature", F.col("at.line").alias("line"))
    deps = rows.select("key", "ord", F.posexplode("param_types").alias("i", "target")).groupBy("key", "target").agg(F.min(F.struct("ord", "i")).alias("at"))
    deps = deps.select("key", nth("at", "target").alias("nth"), "target", F.lit("association").alias("type"))
    return Synthetic(entries, methods, deps)
