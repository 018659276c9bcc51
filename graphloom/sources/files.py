"""Source trees: discovery, exclusion, compile databases, index documents, change log.

Everything is read and written by Spark's own sources, so any store that Spark
reaches will do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.extraction import compiler_arguments
from ..functions.signatures import absolute, shell_words
from ..operators import trace
from ..operators.filters import excluded

#: Suffixes of source files.
SUFFIXES = (".cpp", ".cxx", ".cc", ".c", ".h", ".hpp", ".hxx")
DEFAULT_EXCLUDES = ["build", "third_party", "vendor", ".git"]

def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_TEXT, _INT, _TEXTS = T.StringType(), T.IntegerType(), T.ArrayType(T.StringType())
_STEP = _struct(order=_INT, targetClass=_TEXT, member=_TEXT, kind=_TEXT, isWrite=T.BooleanType(), lineNumber=_INT)
ENTRY = _struct(
    className=_TEXT, responsibility=_TEXT, namespace=_TEXT, fileLocation=_TEXT, lineNumber=_INT,
    baseClasses=_TEXTS, templateParams=_TEXTS, interfaces=_TEXTS, attributes=_TEXTS,
    dependencies=T.ArrayType(_struct(target=_TEXT, type=_TEXT, cardinality=_TEXT)),
    interfaceMeta=T.ArrayType(_struct(signature=_TEXT, lineNumber=_INT, usedTypes=_TEXTS, callSequence=T.ArrayType(_STEP))),
)


def discover(spark: SparkSession, root: str, excludes: list[str] | None = None, ignore: DataFrame | None = None, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path (relative), content: files with a known suffix in any case. ``excludes`` replaces the defaults, ``ignore`` (pattern) adds to them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    root = root.split("://")[-1].removeprefix("file:").rstrip("/")
    path = F.regexp_replace(F.regexp_extract("path", "(?s)" + root.replace(".", "\\.") + "/(.*)$", 1), "^/+", "")
    patterns = list(DEFAULT_EXCLUDES if excludes is None else excludes)
    if ignore is not None:
        patterns += [r["pattern"] for r in ignore.collect()]  # a pattern file is configuration
    known = "(" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$"
    out = files.select(path.alias("path"), "content").filter(F.lower("path").rlike(known))
    return out.filter(~excluded(F.col("path"), patterns)) if patterns else out


def ignore_patterns(spark: SparkSession, path: str) -> DataFrame:
    """pattern: lines of a pattern file without blanks and comments."""
    lines = spark.read.text(path).select(F.trim("value").alias("pattern"))
    return lines.filter("pattern <> '' AND pattern NOT LIKE '#%'")


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """file, arguments: ``arguments`` is preferred to ``command``, which is split as a shell does; output options, the file and objects are left out.

    A relative file lies in its directory. Entries without a file are left out; a command with an open quote has no arguments.
    """
    raw = spark.read.schema("file string, directory string, command string, arguments array<string>").option("multiLine", True).json(path)
    none = F.array().cast("array<string>")
    words = F.coalesce(shell_words(F.coalesce("command", F.lit(""))), none)
    given = F.when(F.size(F.coalesce("arguments", none)) > 0, F.col("arguments")).otherwise(words)
    rows = raw.filter("file <> ''").select(absolute(F.coalesce("directory", F.lit("")), F.col("file")).alias("file"), given.alias("given"))
    return rows.select("file", compiler_arguments(F.col("given"), F.col("file")).alias("arguments"))


def check_compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """entries, complete, without_file, without_directory, without_command: counts that tell whether a database is usable."""
    raw = spark.read.schema("file string, directory string, command string, arguments array<string>").option("multiLine", True).json(path)
    no = lambda c: F.col(c).isNull() | (F.col(c) == "")
    bare = no("command") & (F.coalesce(F.size("arguments"), F.lit(0)) <= 0)
    return raw.agg(F.count(F.lit(1)).alias("entries"), F.count_if(~(no("file") | no("directory") | bare)).alias("complete"), F.count_if(no("file")).alias("without_file"), F.count_if(no("directory")).alias("without_directory"), F.count_if(bare).alias("without_command"))


def parse(files: DataFrame, parser: Callable[[str, bytes], list[dict]]) -> DataFrame:
    """file, ordinal, entry: what a parser that is given as a function finds in each file (path, content)."""
    fields = [f.name for f in ENTRY]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, {k: e.get(k) for k in fields}) for p, c in zip(batch["path"], batch["content"], strict=True) for i, e in enumerate(parser(p, bytes(c)))]
            yield pd.DataFrame(rows, columns=["file", "ordinal", "entry"])

    return files.mapInPandas(run, T.StructType([T.StructField("file", T.StringType()), T.StructField("ordinal", T.LongType()), T.StructField("entry", ENTRY)]))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Class entries of an index document of any version: a bare array (1) or an object with ``classes`` (2 to 4)."""
    raw = spark.read.text(path, wholetext=True)
    bare = F.from_json("value", T.ArrayType(ENTRY))
    held = F.from_json("value", T.StructType([T.StructField("classes", T.ArrayType(ENTRY))]))["classes"]
    entries = F.when(F.ltrim(F.col("value")).startswith("["), bare).otherwise(held)
    return raw.select(F.posexplode(entries).alias("ordinal", "e")).select("ordinal", "e.*")


def write_index(entries: DataFrame, path: str, version: int = 4) -> None:
    """One JSON document with all entries in order, for tools that want a file; tables stay parquet.

    Entries are lines that one task sorts and writes, none of them held with the others in memory.
    """
    cols = [c for c in entries.columns if c != "ordinal"]
    first = entries.agg(F.min("ordinal").alias("first"))  # one row
    body = entries.join(F.broadcast(first)).select(F.lit(1).alias("section"), "ordinal", F.concat(F.when(F.col("ordinal") == F.col("first"), "").otherwise(","), F.to_json(F.struct(*cols))).alias("value"))
    ends = entries.sparkSession.createDataFrame([(0, 0, f'{{"version":{version},"classes":['), (2, 0, "]}")], "section int, ordinal long, value string")
    body.unionByName(ends).repartition(1).sortWithinPartitions("section", "ordinal").select("value").write.mode("overwrite").text(path)


def append_change(record: DataFrame | None, path: str) -> None:
    """Adds a change record to the log; nothing happened, nothing is added."""
    if record is not None:
        record.write.mode("append").parquet(path)


def write_text(lines: DataFrame, path: str) -> None:
    """Rendered text (value) as one file."""
    lines.select("value").coalesce(1).write.mode("overwrite").text(path)


def read_calls(spark: SparkSession, call_graph: str | None = None, backtraces: str | None = None) -> DataFrame:
    """group, pos, caller, callee, args, returns: calls of a JSON file, one group, or of backtrace texts, a group for each file. Exactly one of both is given."""
    if (call_graph is None) == (backtraces is None):
        raise ValueError("give either a call graph or backtraces")
    if call_graph is not None:
        raw = spark.read.text(call_graph, wholetext=True)
        calls = F.from_json("value", "array<struct<caller:string,callee:string,args:string,return:string>>")
        rows = raw.select(F.lit("calls").alias("group"), F.posexplode(calls).alias("pos", "c"))
        return rows.select("group", F.col("pos").cast("long").alias("pos"), *(F.coalesce(F.col("c")[f], F.lit("")).alias(n) for f, n in (("caller", "caller"), ("callee", "callee"), ("args", "args"), ("return", "returns"))))
    texts = spark.read.text(backtraces, wholetext=True).select(F.col("_metadata.file_name").alias("group"), F.col("value").alias("text"))
    return trace.call_edges(trace.frames(texts, "group")).withColumnRenamed("trace", "group").withColumn("pos", F.col("pos").cast("long")).withColumn("returns", F.lit(""))
