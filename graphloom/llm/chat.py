"""Reply trees as formatted conversations, with built-in functions only.

Every root-to-leaf path of a tree is one candidate conversation. Paths are
enumerated by iterated self-joins that double: after round k each node knows
its ancestor 2**k above. Leaves then climb by these, the farthest first, and
each step of their paths climbs on, so a tree of depth d takes 2 * log2(d)
joins and only the steps of its paths are written. The branches of a tree are
ranked by their mean score, and each chosen one is formatted as a whole.

The template opens a turn with ``<|role|>`` and a newline and closes it with
``<|end|>``. Inside roles and texts, ``&``, ``<`` and ``[`` are written as
``&amp;``, ``&lt;`` and ``&#91;`` (newlines of roles as ``&#10;``), so no
control string of this or another template survives in a text, and
unescaping gives back exactly what was there. The loss mask is a list of
(start, length) in code points of the formatted text, one for each assistant
text.

Defined cases: null roles and texts are empty. A null conversation id is a
conversation of its own. Rows that tie on the turn are ordered by role and
text and kept. A node whose parent isn't there is a root; nodes on a
cycle have no root and are left out. An empty table gives an empty result.
Extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import materialize

END = "<|end|>"
#: What is escaped, in this order, and how it is written.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escaped(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def chains(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Linear conversations as reply trees: tree, node, parent, score, role, text; each turn replies to the one before."""
    plain = rows.select(rows[id_col].alias("tree"), rows[turn_col].alias("turn"), F.coalesce(rows[role_col].cast("string"), F.lit("")).alias("role"), F.coalesce(rows[text_col].cast("string"), F.lit("")).alias("text"))
    node = F.row_number().over(W.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    nodes = plain.withColumn("node", node)
    return nodes.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def branches(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """tree, leaf, rank, path: root-to-leaf paths as arrays of nodes, ranked by mean score, then by leaf; the ``best`` of each tree."""
    links = materialize(nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "nodes")

    def at(rows: DataFrame, column: str, found: DataFrame) -> Column:
        return rows["tree"].eqNullSafe(found["t_"]) & (rows[column] == found["n_"])

    named = lambda rows, *more: rows.select(F.col("tree").alias("t_"), F.col("node").alias("n_"), *more)
    known = named(links).distinct()
    up = materialize(links.join(known, at(links, "parent", known)).select("tree", "node", F.col("parent").alias("above")), "above")
    levels, most = [], links.count().bit_length()
    while len(levels) <= most and not up.isEmpty():
        levels.append(up)
        far = named(up, F.col("above").alias("above_"))
        up = materialize(up.join(far, at(up, "above", far)).select("tree", "node", F.col("above_").alias("above")), "above")

    replied = links.filter("parent IS NOT NULL").select(F.col("tree").alias("t_"), F.col("parent").alias("n_")).distinct()
    leaves = links.join(replied, at(links, "node", replied), "left_anti")
    if len(levels) > most:  # what still has an ancestor comes from a cycle
        endless = named(up)
        leaves = leaves.join(endless, at(leaves, "node", endless), "left_anti")
    steps = materialize(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back")), "steps")
    for k in range(len(levels) - 1, -1, -1):
        far = named(levels[k], "above")
        found = steps.join(far, at(steps, "node", far)).select("tree", "leaf", F.col("above").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        steps = steps.unionByName(materialize(found, "steps"))
    scores = named(links, "score")
    turns = steps.join(scores, at(steps, "node", scores)).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "node", "score"))).alias("turns"))
    mean = F.aggregate("turns", F.lit(0.0), lambda total, x: total + x["score"]) / F.size("turns")
    ranked = turns.select("tree", "leaf", F.row_number().over(W.partitionBy("tree").orderBy(mean.desc(), "leaf")).alias("rank"), F.col("turns.node").alias("path"))
    return ranked if best is None else ranked.filter(F.col("rank") <= best)


def formatted(nodes: DataFrame, paths: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """tree, leaf, rank, formatted, loss: one row per chosen path; loss is an array of (start, length)."""
    steps = paths.select("tree", "leaf", "rank", F.posexplode("path").alias("place", "node"))
    texts = nodes.select(F.col("tree").alias("t_"), F.col("node").alias("n_"), "role", "text")
    head = F.concat(F.lit("<|"), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("|>\n"))
    turns = steps.join(texts, steps["tree"].eqNullSafe(texts["t_"]) & (steps["node"] == texts["n_"])).select("tree", "leaf", "rank", "place", head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == loss_role).alias("learn"))
    whole = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("place", "head", "body", "learn"))).alias("turns"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), ""))
    lengths = F.transform("turns", lambda t: F.struct(F.length(t["head"]).cast("long").alias("head"), F.length(t["body"]).cast("long").alias("body"), t["learn"].alias("learn")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        span = F.array(F.struct((state["at"] + t["head"]).alias("start"), t["body"].alias("length")))
        spans = F.when(t["learn"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((state["at"] + t["head"] + t["body"] + len(END)).alias("at"), spans.alias("spans"))

    return whole.select("tree", "leaf", "rank", "formatted", F.aggregate(lengths, start, step)["spans"].alias("loss"))


def parsed(texts: DataFrame) -> DataFrame:
    """``texts`` with turns, an array of (role, text), and loss_text, both read back from formatted and loss."""
    parts = F.split("formatted", "<\\|end\\|>", -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    role = lambda p: unescaped(F.replace(F.regexp_extract(p, r"^<\|([^\n]*)\|>\n", 1), F.lit("&#10;"), F.lit("\n")))
    turns = F.transform(parts, lambda p: F.struct(role(p).alias("role"), unescaped(F.regexp_replace(p, r"^<\|[^\n]*\|>\n", "")).alias("text")))
    loss = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return texts.withColumns({"turns": turns, "loss_text": loss})


def format_conversations(nodes: DataFrame, best: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """Reply trees to formatted conversations, written to the shared folder: tree, leaf, rank, formatted, loss."""
    nodes = materialize(nodes, "turns")
    return materialize(formatted(nodes, branches(nodes, best), loss_role), "formatted")
