"""Diagrams as documents: a row for each line, placed by document, section and order.

No document is gathered into one row. A filter leaves a placeholder where nothing of a
document is left. ``write`` sorts lines by range, so a document may be of any size
and files of many documents are written at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.naming import class_of, method_label, method_of, sanitize_id
from .render import ARROWS

#: What is said where there is nothing to show.
NO_CLASSES = '    note "No matching classes found"'
NO_CALLS, NO_MATCHES = "    Note over System: No call graph data", "    Note over System: No matching call graph edges"


def _line(section: int, value: Column, *place: Column) -> list[Column]:
    """section, a, b, c, value: the columns of a line at up to three numbers."""
    numbers = [*place, *[F.lit(0)] * (3 - len(place))]
    return [F.lit(section).alias("section"), *(n.cast("long").alias(k) for n, k in zip(numbers, "abc", strict=True)), value.alias("value")]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _tilde(text: Column) -> Column:
    return F.translate(text, "<>", "~~")


def _head(documents: DataFrame, kind: str, title: str | None) -> list[DataFrame]:
    head = [documents.select("document", *_line(0, F.lit(kind)))]
    return [*head, documents.select("document", *_line(0, F.lit(f"    title {title}"), F.lit(1)))] if title else head


def matching(entries: DataFrame, pattern: str | None = None, namespace: str | None = None) -> DataFrame:
    """Entries whose name has the pattern, in any case, and whose namespace begins with the given one."""
    if namespace:
        entries = entries.filter(F.coalesce("namespace", F.lit("")).startswith(namespace))
    return entries.filter(F.col("name").rlike(f"(?i){pattern}")) if pattern else entries


def class_diagrams(entries: DataFrame, pattern: str | None = None, namespace: str | None = None, title: str | None = None, max_methods: int = 6, max_attributes: int = 12) -> DataFrame:
    """document, section, a, b, c, value: a class diagram for each document.

    ``entries``: document, ord, name, namespace, template_params, attributes, interfaces, deps (target, type, cardinality).
    Dependencies are drawn between classes of the same document, each line once.
    """
    shown = matching(entries, pattern, namespace)
    documents = entries.select("document").distinct()
    held = shown.select("document").distinct()
    empty = documents.join(held, "document", "left_anti")
    safe, order = sanitize_id(F.col("name")), F.col("ord")

    def members(column: str, most: int, label, part: int, more: str) -> list[DataFrame]:
        listed = F.coalesce(column, F.expr("CAST(array() AS array<string>)"))
        rows = shown.select("document", "ord", F.posexplode(F.slice(listed, 1, most)).alias("i", "x"))
        over = shown.filter(F.size(listed) > most)
        return [rows.select("document", *_line(1, F.concat(F.lit("        "), label(F.col("x"))), order, F.lit(part), F.col("i"))), over.select("document", *_line(1, F.concat(F.lit("        ... "), (F.size(listed) - most).cast("string"), F.lit(more)), order, F.lit(part), F.lit(most)))]

    dep = shown.select("document", "ord", "name", F.posexplode("deps").alias("i", "d")).select("document", "ord", "name", "i", "d.*")
    dep = dep.withColumn("base", F.element_at(F.split(F.trim(F.regexp_replace("target", "<.*>", "")), "::"), -1))
    present = shown.select("document", F.col("name").alias("known")).distinct()
    by_base = dep.join(present.withColumnRenamed("known", "base"), ["document", "base"], "left_semi").select(*dep.columns)
    by_name = dep.join(present.withColumnRenamed("known", "target"), ["document", "target"], "left_semi").select(*dep.columns)
    arrow = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in ARROWS.items()], F.lit("-->"))
    label = F.when(F.coalesce("cardinality", F.lit("")) != "", F.concat("type", F.lit(" ["), "cardinality", F.lit("]"))).otherwise(F.col("type"))
    own, other = sanitize_id(F.col("name")), sanitize_id(F.col("base"))
    line = F.when(F.col("type") == "inheritance", F.concat(F.lit("    "), other, F.lit(" "), arrow, F.lit(" "), own)).otherwise(F.concat(F.lit("    "), own, F.lit(" "), arrow, F.lit(" "), other, F.lit(" : "), label))
    relations = by_base.unionByName(by_name).distinct().withColumn("value", line).groupBy("document", "value").agg(F.min(F.struct("ord", "i")).alias("at"))

    parts = [
        *_head(held, "classDiagram", title),
        empty.select("document", *_line(0, F.lit("classDiagram"))), empty.select("document", *_line(0, F.lit(NO_CLASSES), F.lit(1))),
        shown.select("document", *_line(1, F.concat(F.lit("    class "), safe, F.lit(" {")), order, F.lit(0))),
        shown.filter(F.size("template_params") > 0).select("document", *_line(1, F.lit("        <<template>>"), order, F.lit(1))),
        *members("attributes", max_attributes, _tilde, 2, " more fields"),
        *members("interfaces", max_methods, lambda x: F.concat(F.lit("+"), _tilde(method_label(x))), 3, " more"),
        shown.select("document", *_line(1, F.lit("    }"), order, F.lit(4))),
        shown.filter("namespace <> ''").select("document", *_line(1, F.concat(F.lit("    note for "), safe, F.lit(' "ns: '), F.col("namespace"), F.lit('"')), order, F.lit(5))),
        relations.select("document", *_line(2, F.col("value"), F.col("at.ord"), F.col("at.i"))),
    ]
    return _union(parts)


def matching_calls(calls: DataFrame, pattern: str | None = None, namespace: str | None = None) -> DataFrame:
    """Calls (caller, callee) of which either end's class has the pattern, in any case, and either begins with the namespace."""
    one, two = class_of(F.col("caller")), class_of(F.col("callee"))
    if namespace:
        calls = calls.filter(one.startswith(namespace) | two.startswith(namespace))
    return calls.filter(one.rlike(f"(?i){pattern}") | two.rlike(f"(?i){pattern}")) if pattern else calls


def sequence_diagrams(calls: DataFrame, documents: DataFrame, pattern: str | None = None, namespace: str | None = None, title: str | None = None) -> DataFrame:
    """document, section, a, b, c, value: a sequence diagram for each of the ``documents`` (document).

    ``calls``: document, pos, caller, callee, args, returns. Participants come in the order of their first call.
    """
    documents = documents.select("document").distinct()
    any_calls = calls.select("document").distinct()
    found = matching_calls(calls, pattern, namespace)
    held = found.select("document").distinct()
    rows = found.select("document", "pos", sanitize_id(class_of(F.col("caller"))).alias("one"), sanitize_id(class_of(F.col("callee"))).alias("two"), F.concat(method_of(F.col("callee")), F.lit("("), F.coalesce("args", F.lit("")), F.lit(")")).alias("label"), F.coalesce(F.nullif(F.substring("returns", 1, 60), F.lit("")), F.lit("return")).alias("back"))
    ends = rows.select("document", F.explode(F.array(F.struct((F.col("pos") * 2).alias("p"), F.col("one").alias("who")), F.struct((F.col("pos") * 2 + 1).alias("p"), F.col("two").alias("who")))).alias("x"))
    who = ends.groupBy("document", "x.who").agg(F.min("x.p").alias("p"))
    short = F.when(F.length("label") > 60, F.concat(F.substring("label", 1, 57), F.lit("..."))).otherwise(F.col("label"))

    def note(df: DataFrame, text: str) -> list[DataFrame]:
        return [df.select("document", *_line(0, F.lit("sequenceDiagram"))), df.select("document", *_line(0, F.lit(text), F.lit(1)))]

    parts = [
        *_head(held, "sequenceDiagram", title),
        *note(documents.join(any_calls, "document", "left_anti"), NO_CALLS), *note(any_calls.join(held, "document", "left_anti"), NO_MATCHES),
        who.select("document", *_line(1, F.concat(F.lit("    participant "), "who"), F.col("p"))),
        held.select("document", *_line(2, F.lit(""))),
        rows.select("document", *_line(3, F.concat(F.lit("    "), "one", F.lit("->>+"), "two", F.lit(": "), short), F.col("pos"))),
        rows.select("document", *_line(3, F.concat(F.lit("    "), "two", F.lit("-->>-"), "one", F.lit(": "), "back"), F.col("pos"), F.lit(1))),
    ]
    return _union(parts)


ORDER = ("document", "section", "a", "b", "c")


def numbered(lines: DataFrame) -> DataFrame:
    """document, line, value: lines with their number, from 1."""
    return lines.select("document", F.row_number().over(W.partitionBy("document").orderBy(*ORDER[1:], "value")).alias("line"), "value")


def write(lines: DataFrame, path: str, files: int | None = None) -> None:
    """Every document as text in a folder document=<name>, its files in the order of its lines."""
    ranged = lines.repartitionByRange(files, *ORDER) if files else lines.repartitionByRange(*ORDER)
    ranged.sortWithinPartitions(*ORDER).select("document", "value").write.mode("overwrite").partitionBy("document").text(path)


def write_all(entries: DataFrame, path: str, pattern: str | None = None, namespace: str | None = None, title: str | None = None) -> None:
    """The class diagram of each document and, beside it, the placeholder of a sequence diagram without calls."""
    none = entries.sparkSession.createDataFrame([], "document string, pos long, caller string, callee string, args string, returns string")
    classes = class_diagrams(entries, pattern, namespace, title)
    sequences = sequence_diagrams(none, entries)
    named = lambda df, kind: df.withColumn("document", F.concat("document", F.lit(f".{kind}")))
    write(named(classes, "class").unionByName(named(sequences, "sequence")), path)
