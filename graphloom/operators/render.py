"""Results as diagram text: one row with all lines in order, or a row for each class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import class_of, method_label, method_of, sanitize_id

#: Arrows by kind of dependency.
ARROWS = {"inheritance": "<|--", "composition": "*--", "aggregation": "o--", "association": "-->", "dependency": "..>"}


def class_blocks(classes: DataFrame, max_methods: int = 6, max_attributes: int = 12) -> DataFrame:
    """name, block: the lines of each class (name, namespace, attributes, methods), with caps and a count of what they hide."""
    tilde = lambda c: F.translate(c, "<>", "~~")
    capped = lambda col, n, mark, what: F.concat(F.transform(F.slice(col, 1, n), lambda x: F.concat(F.lit("        " + mark), tilde(method_label(x) if mark else x))), F.when(F.size(col) > n, F.array(F.concat(F.lit("        ... "), (F.size(col) - n).cast("string"), F.lit(what)))).otherwise(F.array().cast("array<string>")))
    safe = sanitize_id(F.col("name"))
    lines = F.concat(F.array(F.concat(F.lit("    class "), safe, F.lit(" {"))), capped(F.col("attributes"), max_attributes, "", " more fields"), capped(F.col("methods"), max_methods, "+", " more"), F.array(F.lit("    }")))
    note = F.when(F.col("namespace") != "", F.array(F.concat(F.lit("    note for "), safe, F.lit(' "ns: '), F.col("namespace"), F.lit('"')))).otherwise(F.array().cast("array<string>"))
    return classes.select("name", F.array_join(F.concat(lines, note), "\n").alias("block"))


def relations(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """src, line: one line for each edge between shown classes; of inheritance, the parent comes first."""
    inside = edges.join(shown.select(F.col("name").alias("dst")), "dst", "left_semi").join(shown.select(F.col("name").alias("src")), "src", "left_semi")
    arrow = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in ARROWS.items()], F.lit("-->"))
    a, b = sanitize_id(F.col("src")), sanitize_id(F.col("dst"))
    line = F.when(F.col("type") == "inheritance", F.concat(F.lit("    "), b, F.lit(" "), arrow, F.lit(" "), a)).otherwise(F.concat(F.lit("    "), a, F.lit(" "), arrow, F.lit(" "), b, F.lit(" : "), F.col("type")))
    return inside.select("src", line.alias("line")).distinct()


def sequence_lines(calls: DataFrame) -> DataFrame:
    """group, value: a sequence diagram for each group of calls (group, pos, caller, callee, args), participants in order of appearance."""
    c = calls.select("group", "pos", sanitize_id(class_of(F.col("caller"))).alias("a"), sanitize_id(class_of(F.col("callee"))).alias("b"), method_of(F.col("callee")).alias("m"), "args")
    label = F.concat("m", F.lit("("), "args", F.lit(")"))
    label = F.when(F.length(label) > 60, F.concat(F.substring(label, 1, 57), F.lit("..."))).otherwise(label)
    line = F.concat(F.lit("    "), "a", F.lit("->>+"), "b", F.lit(": "), label, F.lit("\n    "), "b", F.lit("-->>-"), "a", F.lit(": return"))
    body = c.groupBy("group").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    who = c.select("group", F.explode(F.array(F.struct((F.col("pos") * 2).alias("p"), F.col("a").alias("n")), F.struct((F.col("pos") * 2 + 1).alias("p"), F.col("b").alias("n")))).alias("x"))
    who = who.groupBy("group", "x.n").agg(F.min("x.p").alias("p")).groupBy("group").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "n"))), lambda x: F.concat(F.lit("    participant "), x["n"])), "\n").alias("who"))
    return body.join(who, "group").select("group", F.concat_ws("\n", F.lit("sequenceDiagram"), "who", F.lit(""), "body").alias("value"))


def state_diagram(machines: DataFrame) -> DataFrame:
    """key, enum, value: a state diagram for each machine (key, enum, states, source, target)."""
    line = F.concat(F.lit("    "), sanitize_id(F.col("source")), F.lit(" --> "), sanitize_id(F.col("target")))
    body = machines.groupBy("key", "enum", "states").agg(F.array_join(F.sort_array(F.collect_set(line)), "\n").alias("body"))
    first = F.concat(F.lit("    [*] --> "), sanitize_id(F.substring_index("states", ",", 1)))
    return body.select("key", "enum", F.concat_ws("\n", F.lit("stateDiagram-v2"), F.concat(F.lit('    note "FSM: '), "enum", F.lit('"')), first, F.nullif("body", F.lit(""))).alias("value"))


def module_graph(edges: DataFrame, most: int = 20) -> DataFrame:
    """value: the heaviest module edges as a graph."""
    top = edges.orderBy(F.desc("weight"), "source", "target").limit(most)
    line = F.concat(F.lit("    "), sanitize_id(F.col("source")), F.lit(" -->|"), F.col("weight").cast("string"), F.lit("| "), sanitize_id(F.col("target")))
    rows = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "source", "target", line.alias("line")))), lambda x: x["line"])
    return top.agg(F.concat_ws("\n", F.lit("graph LR"), F.array_join(rows, "\n")).alias("value"))
