"""Calls by class and method: call trees, caller trees, accessors, usages, focal chains, flows.

Tables (place orders methods within a class, all public ones first):

- classes: class, file, ord
- methods: class, signature, place, is_public, used_types
- steps: class, signature, step, target, member, kind (call or field), is_write, line

A class is found by its qualified name, or else by its last part; the first
class in ``ord`` has a shared last part. Method names resolve to the first
method in place that carries the name, so public ones win. Everything is joins
on (class, name); trees carry the places of their steps as a path, so each row
says where it hangs, and grow one level per join. Levels are written to the
shared folder. Rows of a tree are what the tree has: a method that is reached by many
ways is there many times, up to ``max_depth``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import keep

#: How a method's name is told from its signature.
NAME = r"\b([a-zA-Z_~]\w*)\s*\("
PLAIN_NAME = r"\b([a-zA-Z_]\w*)\s*\("
UNGROUPED = "_ungrouped"


def method_name(signature: Column, pattern: str = NAME) -> Column:
    """The name before the first parenthesis, or the whole signature where there is none."""
    found = F.regexp_extract(signature, pattern, 1)
    return F.when(found != "", found).otherwise(signature)


def short_name(name: Column) -> Column:
    return F.element_at(F.split(name, "::"), -1)


def class_index(classes: DataFrame) -> DataFrame:
    """key, class, file: what a name in a call stands for; an exact name before a last part."""
    exact = classes.select(F.col("class").alias("key"), F.lit(0).alias("rank"), "ord", "class", "file")
    short = classes.select(short_name(F.col("class")).alias("key"), F.lit(1).alias("rank"), "ord", "class", "file")
    best = F.min_by(F.struct("class", "file"), F.struct("rank", "ord", "class")).alias("best")
    return exact.unionByName(short).groupBy("key").agg(best).select("key", "best.class", "best.file")


def method_index(methods: DataFrame) -> DataFrame:
    """class, name, signature: the method that a name stands for within its class; a whole signature names its method, too."""
    names = F.array_distinct(F.array(method_name(F.col("signature")), F.col("signature")))
    rows = methods.filter("signature <> ''").select("class", "signature", "place", F.explode(names).alias("name"))
    return rows.groupBy("class", "name").agg(F.min_by("signature", "place").alias("signature"))


def _named_steps(owners: DataFrame, methods: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """caller, of, node, mark; and node, step, class, method, kind, is_write, line, file, next, next_mark: the steps of each method under each name of its class.

    ``node`` numbers a (class, method) that has steps, ``mark`` what both make together, class::method. ``next`` is the called one's number; fields and methods without steps have none.
    """
    steps = steps.filter("target <> '_meta_'").select(F.col("class").alias("owner"), "signature", "step", "target", "member", "kind", "is_write", "line")
    bodies = method_index(methods).select(F.col("class").alias("owner"), F.col("name").alias("of"), "signature")
    names = owners.select(F.col("key").alias("caller"), F.col("class").alias("owner"))
    target = F.when(F.col("target") == "_self_", F.col("caller")).otherwise(F.col("target"))
    rows = bodies.join(steps, ["owner", "signature"]).join(names, "owner").select("caller", "of", F.struct(F.col("step").cast("int").alias("step"), target.alias("class"), F.col("member").alias("method"), "kind", "is_write", "line").alias("s"))
    bodies = keep(rows.groupBy("caller", "of").agg(F.collect_list("s").alias("s")).withColumn("node", F.monotonically_increasing_id()))
    nodes = keep(bodies.select("caller", "of", "node").withColumn("mark", F.min("node").over(W.partitionBy(F.concat_ws("::", "caller", "of")))))
    of_class = nodes.groupBy(F.col("caller").alias("class")).agg(F.map_from_entries(F.collect_list(F.struct("of", F.struct("node", "mark")))).alias("nodes"))
    known = owners.select(F.col("key").alias("class"), "file").join(of_class, "class", "left")
    ahead = F.when(F.col("kind") != "field", F.try_element_at("nodes", F.col("method")))
    found = bodies.select("node", F.inline("s")).join(known, "class", "left").withColumn("ahead", ahead)
    return nodes, keep(found.select("node", "step", "class", "method", "kind", "is_write", "line", "file", F.col("ahead.node").alias("next"), F.col("ahead.mark").alias("next_mark")))


def _ways(starts: DataFrame, edges: DataFrame, depth: int) -> list[DataFrame]:
    """The ways of 0, 1, ... ``depth`` steps from ``starts`` (node, mark, ...) to methods that aren't on them yet: all columns of ``starts``, path (steps), seen (marks before the last)."""
    onward = edges.filter("next IS NOT NULL").select("node", "step", "next", "next_mark")
    levels = [starts.withColumns({"path": F.expr("CAST(array() AS array<int>)"), "seen": F.expr("CAST(array() AS array<bigint>)")})]
    columns = [c for c in levels[0].columns if c not in ("path", "seen", "node", "mark")]
    while len(levels) <= depth:
        grown = levels[-1].join(onward, "node").withColumn("seen", F.array_append("seen", F.col("mark"))).filter(~F.array_contains("seen", F.col("next_mark")))
        level = keep(grown.select(*columns, F.array_append("path", F.col("step")).alias("path"), "seen", F.col("next").alias("node"), F.col("next_mark").alias("mark")))
        if level.isEmpty():
            break
        levels.append(level)
    return levels


def _steps_after(levels: list[DataFrame], edges: DataFrame) -> DataFrame:
    """The steps after all ways of ``levels``."""
    ways = levels[0]
    for level in levels[1:]:
        ways = ways.unionByName(level)
    return ways.join(edges, "node").withColumns({"path": F.array_append("path", F.col("step")), "seen": F.array_append("seen", F.col("mark"))}).drop("node", "mark", "step", "next", "next_mark")


def call_tree(starts: DataFrame, classes: DataFrame, methods: DataFrame, steps: DataFrame, max_depth: int = 10) -> DataFrame:
    """root_class, root_method, path, depth, class, method, kind, is_write, line, file.

    ``starts``: root_class, root_method. ``path`` has the step numbers from the root, whose path is empty. Field steps
    are leaves, and so are methods that are already on their path, unknown ones and those at ``max_depth``.

    The tree's rows don't move. Ways are grown from the roots down to half the depth, and from the methods met there, each
    of them once, for the other half; joins put the steps to the ways, and the second halves to those first ones that share no method with them.
    """
    owners = keep(class_index(classes))
    nodes, edges = _named_steps(owners, methods, steps)
    none = F.lit(None)
    roots = keep(starts.select("root_class", "root_method").distinct())
    shown = roots.join(owners.select(F.col("key").alias("root_class"), "file"), "root_class", "left")
    columns = ["root_class", "root_method", "path", "depth", "class", "method", "kind", "is_write", "line", "file"]
    out = shown.withColumns({"path": F.expr("CAST(array() AS array<int>)"), "depth": F.lit(0), "class": F.col("root_class"), "method": F.col("root_method"), "kind": F.lit("call"), "is_write": none.cast("boolean"), "line": none.cast("int")}).select(columns)
    if max_depth < 1:
        return out
    half = max_depth // 2
    known = nodes.select(F.col("caller").alias("root_class"), F.col("of").alias("root_method"), "node", "mark")
    first = _ways(keep(roots.join(known, ["root_class", "root_method"])), edges, half)
    if half:
        out = out.unionByName(_steps_after(first[:half], edges).withColumn("depth", F.size("path")).select(columns))
    if len(first) > half:
        ends = first[half].select("node", "mark").distinct()
        rest = _ways(keep(ends.withColumn("start", F.col("node"))), edges, max_depth - half - 1)
        rest = _steps_after(rest, edges).withColumnsRenamed({"path": "onward", "seen": "later", "start": "node"})
        whole = first[half].drop("mark").join(rest, "node").filter(~F.arrays_overlap("seen", "later")).withColumn("path", F.concat("path", "onward"))
        out = out.unionByName(whole.withColumn("depth", F.size("path")).select(columns))
    return out


def callers(classes: DataFrame, methods: DataFrame, steps: DataFrame, kind: str = "call") -> DataFrame:
    """key, class, signature, name, line, file, is_write, at: one row for each step that calls or accesses ``key``, class::member.

    ``at`` orders them. ``_self_`` stands for the last part of the class's name; ``_meta_`` is left out. Nothing is merged.
    """
    of_kind = (F.col("kind") == "field") == (kind == "field")
    target = F.when(F.col("target") == "_self_", short_name(F.col("class"))).otherwise(F.col("target"))
    rows = steps.filter(of_kind & (F.col("target") != "_meta_")).join(methods.select("class", "signature", "place"), ["class", "signature"]).join(classes.select("class", "file", "ord"), "class")
    return rows.select(F.concat_ws("::", target, "member").alias("key"), "class", "signature", method_name(F.col("signature")).alias("name"), "line", "file", F.coalesce("is_write", F.lit(False)).alias("is_write"), F.struct("ord", "class", "place", "step").alias("at"))


def _with_key(rows: DataFrame, keys: DataFrame, owner: str, member: str) -> DataFrame:
    """``rows`` with ``key``, by the qualified class if ``keys`` has it, else by the class's last part."""
    exact = keys.select(F.col("key").alias("exact"), F.lit(True).alias("is_exact"))
    rows = rows.withColumn("exact", F.concat_ws("::", owner, member)).join(exact, "exact", "left")
    return rows.withColumn("key", F.when(F.col("is_exact"), F.col("exact")).otherwise(F.concat_ws("::", short_name(F.col(owner)), member))).drop("exact", "is_exact")


def caller_tree(starts: DataFrame, classes: DataFrame, methods: DataFrame, steps: DataFrame, max_depth: int = 6) -> DataFrame:
    """root_class, root_method, path, depth, class, method, line, file: who calls the roots, direct callers at depth 0.

    ``path`` numbers the callers of each level from 1. A caller that is on its own path already is a leaf; the root isn't on the path.
    """
    index = callers(classes, methods, steps)
    index = index.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy("at"))).drop("at", "is_write")
    index = keep(index)
    keys = keep(index.select("key").distinct())
    empty = F.expr("CAST(array() AS array<string>)")
    level = starts.distinct().select("root_class", "root_method", F.expr("CAST(array() AS array<int>)").alias("path"), F.col("root_class").alias("class"), F.col("root_method").alias("name"), empty.alias("seen"), F.lit(False).alias("repeat"))
    out = None
    for depth in range(max_depth):
        asked = _with_key(level.filter("NOT repeat").select("root_class", "root_method", "path", "seen", F.col("class").alias("callee"), F.col("name").alias("member")), keys, "callee", "member")
        grown = asked.drop("callee", "member").join(index, "key").withColumn("visit", F.concat_ws("::", "class", "name"))
        grown = grown.select("root_class", "root_method", F.array_append("path", F.col("nth").cast("int")).alias("path"), F.lit(depth).alias("depth"), "class", F.col("signature").alias("method"), "name", "line", "file", F.array_contains("seen", F.col("visit")).alias("repeat"), F.array_append("seen", F.col("visit")).alias("seen"))
        level = keep(grown)
        out = level if out is None else out.unionByName(level)
        if level.isEmpty():
            break
    return out.select("root_class", "root_method", "path", "depth", "class", "method", "line", "file")


def field_accessors(asked: DataFrame, classes: DataFrame, methods: DataFrame, steps: DataFrame) -> DataFrame:
    """class, field, accessor, signature, is_write, line, file, nth: a row for each access of the ``asked`` (class, field).

    Accesses by the qualified name count; only where there is none, those by the last part do.
    """
    index = keep(callers(classes, methods, steps, "field"))
    found = _with_key(asked.distinct(), index.select("key").distinct(), "class", "field").join(index.withColumnRenamed("class", "accessor"), "key")
    nth = F.row_number().over(W.partitionBy("class", "field").orderBy("at"))
    return found.select("class", "field", "accessor", "signature", "is_write", "line", "file", nth.alias("nth"))


#: The use that a dependency's type stands for.
USES = {"composition": "field", "aggregation": "field", "association": "param", "dependency": "local", "inheritance": "inherit"}


def type_usage(types: DataFrame, deps: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """type, use, class, dep_type, signature, file: where the ``types`` (type) are used, by class and by method.

    ``deps``: class, target, dep_type. A type is meant by its name or its last part. Classes of that name or last part don't count.
    A method that names the type counts once however often it names it; parameters are told once for each class and method.
    """
    keys = types.distinct().withColumn("key", F.explode(F.array_distinct(F.array("type", short_name(F.col("type"))))))
    other = (F.col("class") != F.col("type")) & (short_name(F.col("class")) != short_name(F.col("type")))
    use = F.coalesce(*[F.when(F.col("dep_type") == k, v) for k, v in USES.items()])
    by_class = keys.join(deps, keys["key"] == deps["target"]).filter(other).select("type", use.alias("use"), "class", "dep_type", F.lit(None).cast("string").alias("signature")).filter("use IS NOT NULL")
    named = methods.select("class", "signature", F.explode(F.array_distinct("used_types")).alias("key"))
    by_method = keys.join(named, "key").filter(other).select("type", F.lit("param").alias("use"), "class", F.lit("association").alias("dep_type"), "signature")
    params = by_class.filter("use = 'param'").unionByName(by_method).dropDuplicates(["type", "class", "signature"])
    return by_class.filter("use <> 'param'").unionByName(params).join(classes.select("class", "file"), "class", "left").select("type", "use", "class", "dep_type", "signature", "file")


def focal_chain(asked: DataFrame, methods: DataFrame, steps: DataFrame) -> DataFrame:
    """class, signature, step, target, member, kind, is_write, line: the steps of the ``asked`` (class, signature), by whole signature.

    Of methods that share a signature the first in place counts. A method without steps has no rows.
    """
    first = methods.groupBy("class", "signature").agg(F.min("place").alias("place"))
    return asked.distinct().join(first, ["class", "signature"], "left_semi").join(steps, ["class", "signature"]).select("class", "signature", "step", "target", "member", "kind", "is_write", "line")



def _holders(wanted: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """class, method, signature of the ``wanted`` (class, method) whose class exists: the first method in place whose signature contains the name and a parenthesis; null if none does."""
    known = wanted.distinct().join(classes.select("class").distinct(), "class", "left_semi")
    found = known.join(methods.select("class", "signature", "place"), "class").filter(F.col("signature").contains(F.concat("method", F.lit("("))))
    return known.join(found.groupBy("class", "method").agg(F.min_by("signature", "place").alias("signature")), ["class", "method"], "left")


#: What a step is in a walk if it isn't the number of the method that it enters: a line of its own, or nothing.
SHOWN, NOTHING = -1, -2


def walk(start: int, called: dict[int, list[int]], max_depth: int) -> list[tuple[int, int]]:
    """(method, nth step, or 0 for the method itself) in depth-first order; a method is entered once, at the depth where it's first met."""
    out, seen, above = [(start, 0)], {start}, [(start, 0)]
    while above:
        node, i = above.pop()
        steps = called[node]
        while i < len(steps):
            ahead, i = steps[i], i + 1
            if ahead == SHOWN:
                out.append((node, i))
            elif ahead in called and ahead not in seen and len(above) < max_depth:
                above.append((node, i))
                out.append((ahead, 0))
                seen.add(ahead)
                node, i, steps = ahead, 0, called[ahead]
    return out


def _numbered(holders: DataFrame, steps: DataFrame) -> DataFrame:
    """node, called, said: of each method of ``holders`` (node, class, method, signature), what its steps enter, and class, method, action of each step."""
    steps = steps.filter("target IS NOT NULL").select("class", "signature", "step", "target", "member", "kind", "is_write")
    enters = F.coalesce((F.col("kind") == "call") & (F.col("target") != "_self_"), F.lit(False))
    rows = keep(holders.drop("method").join(steps, ["class", "signature"]).withColumn("enters", enters))
    known = holders.select(F.col("class").alias("target"), F.col("method").alias("member"), F.col("node").alias("ahead"))
    rows = rows.filter("NOT enters").withColumn("ahead", F.lit(SHOWN).cast("long")).unionByName(rows.filter("enters").join(known, ["target", "member"], "left").withColumn("ahead", F.coalesce("ahead", F.lit(NOTHING).cast("long"))))
    action = F.when(F.col("is_write"), "write").when(F.col("kind") == "call", "call").otherwise("read")
    said = F.struct(F.when(F.col("target") == "_self_", F.col("class")).otherwise(F.col("target")).alias("class"), F.col("member").alias("method"), action.alias("action"))
    ordered = F.sort_array(F.collect_list(F.struct("step", "target", "member", "ahead", said.alias("said"))))
    bodies = rows.groupBy("node").agg(ordered.alias("s")).select("node", F.col("s.ahead").alias("called"), F.col("s.said").alias("said"))
    return keep(holders.select("node").join(bodies, "node", "left").withColumn("called", F.coalesce("called", F.array().cast("array<bigint>"))))


def flows(starts: DataFrame, classes: DataFrame, methods: DataFrame, steps: DataFrame, members: DataFrame, max_depth: int = 10, least: int = 2) -> DataFrame:
    """start_class, start_method, nth, class, method, module, action: the steps of each start's flow, if it has ``least`` of them.

    ``starts``: start_class, start_method. ``members``: class, module. Methods are numbers until the end. The calls within reach of each start are
    joined level by level; what one start reaches is then a row, whose walk is told by method and step, and names come to it by a join.
    """
    wanted = steps.filter("kind = 'call' AND target <> '_self_'").select(F.col("target").alias("class"), F.col("member").alias("method")).unionByName(starts.select(F.col("start_class").alias("class"), F.col("start_method").alias("method")))
    holders = keep(_holders(wanted, classes, methods).withColumn("node", F.monotonically_increasing_id()))
    bodies = _numbered(holders, steps)
    onward = keep(bodies.select("node", F.explode(F.array_distinct(F.filter("called", lambda x: x >= 0))).alias("ahead")))
    named = holders.select(F.col("node").alias("start"), F.col("class").alias("start_class"), F.col("method").alias("start_method"))
    level = keep(named.join(starts.distinct(), ["start_class", "start_method"], "left_semi").select("start", F.col("start").alias("node")))
    reached, depth = level, 0
    while depth < max_depth:
        depth += 1
        level = keep(level.join(onward, "node").select("start", F.col("ahead").alias("node")).distinct().join(reached, ["start", "node"], "left_anti"))
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    rows = reached.join(bodies.select("node", "called"), "node").groupBy("start").agg(F.collect_list(F.struct("node", "called")).alias("r")).select("start", "r.node", "r.called")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(start, walk(start, dict(zip(node, called, strict=True)), max_depth)) for start, node, called in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            found = [(start, out) for start, out in found if len(out) >= least]
            columns = [[start for start, _ in found], [[n for n, _ in out] for _, out in found], [[at for _, at in out] for _, out in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())), strict=True)], ["start", "node", "at"])

    told = rows.mapInArrow(walked, "start long, node array<long>, at array<int>").join(named, "start")
    told = told.select("start_class", "start_method", F.posexplode(F.arrays_zip("node", "at")).alias("nth", "s")).select("start_class", "start_method", "nth", "s.node", "s.at")
    own = F.struct("class", "method", F.lit("call").alias("action"))
    found = told.join(holders.select("node", "class", "method").join(bodies.select("node", "said"), "node"), "node")
    found = found.select("start_class", "start_method", "nth", F.when(F.col("at") == 0, own).otherwise(F.get("said", F.col("at") - 1)).alias("s")).select("start_class", "start_method", "nth", "s.*")
    return found.join(members.select("class", "module"), "class", "left").withColumn("module", F.coalesce("module", F.lit(UNGROUPED))).select("start_class", "start_method", "nth", "class", "method", "module", "action")


def flow_totals(found: DataFrame) -> DataFrame:
    """start_class, start_method, name, n_steps, n_modules of each flow."""
    last = F.max_by(F.concat_ws("::", "class", "method"), "nth")
    return found.groupBy("start_class", "start_method").agg(last.alias("last"), F.count(F.lit(1)).alias("n_steps"), F.countDistinct("module").alias("n_modules")).select("start_class", "start_method", F.concat(F.concat_ws("::", "start_class", "start_method"), F.lit(" → "), "last").alias("name"), "n_steps", "n_modules")


def first_methods(chosen: DataFrame, methods: DataFrame, most: int) -> DataFrame:
    """rank, start_class, start_method, nth: of each of the ``chosen`` (rank, class), the first ``most`` public methods, if they have a name."""
    nth = F.row_number().over(W.partitionBy("class").orderBy("place"))
    rows = methods.filter("is_public").join(chosen, "class").withColumn("nth", nth).filter(F.col("nth") <= most)
    return rows.select("rank", F.col("class").alias("start_class"), F.regexp_extract("signature", PLAIN_NAME, 1).alias("start_method"), "nth").filter("start_method <> ''")


#: In which order kinds of entry points start flows.
KINDS = ("main", "hub", "server", "root")


def key_flows(entries: DataFrame, classes: DataFrame, methods: DataFrame, steps: DataFrame, members: DataFrame, limit: int = 10, most: int = 20) -> DataFrame:
    """place, name, n_steps, n_modules: the best flows of the first ``most`` entry points (class, kind, ord), five methods each.

    Flows that cross more modules, then longer ones, come first; one that shares over 0.8 of the methods of a better one is left out.
    """
    rank = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)], F.lit(len(KINDS)))
    chosen = entries.select("class", F.struct(rank.alias("kind"), "ord").alias("rank")).orderBy("rank").limit(most)
    starts = keep(first_methods(chosen, methods, 5))
    found = keep(flows(starts.select("start_class", "start_method"), classes, methods, steps, members, least=3))
    totals = starts.join(flow_totals(found), ["start_class", "start_method"]).orderBy(F.desc("n_modules"), F.desc("n_steps"), "rank", "nth")
    ranked = [r.asDict() for r in totals.collect()]  # ``most`` times five rows
    who = ["start_class", "start_method"]
    keys = keep(found.select(*who, F.concat_ws("::", "class", "method").alias("key")).distinct())
    sizes = {(r[0], r[1]): r[2] for r in keys.groupBy(*who).count().collect()}
    other = keys.select(F.col("start_class").alias("c"), F.col("start_method").alias("m"), "key")
    shared = {tuple(r)[:4]: r[4] for r in keys.join(other, "key").groupBy(*who, "c", "m").count().collect()}  # a number for each two of those flows
    kept: list[dict] = []
    for r in ranked:
        me = (r["start_class"], r["start_method"])
        if all(shared.get((*me, k["start_class"], k["start_method"]), 0) / max(sizes[me], sizes[k["start_class"], k["start_method"]]) <= 0.8 for k in kept):
            kept.append(r)
        if len(kept) == limit:
            break
    return classes.sparkSession.createDataFrame([(i, r["name"], r["n_steps"], r["n_modules"]) for i, r in enumerate(kept, 1)], "place int, name string, n_steps long, n_modules long")


def flow_query(matches: DataFrame, classes: DataFrame, methods: DataFrame, steps: DataFrame, members: DataFrame, limit: int = 5) -> DataFrame:
    """query, place, name, n_steps: for each query, the longest flows from the methods of its ``matches`` (query, class, rank).

    The first ten matches give up to three public methods each, in turn until ``limit`` flows are found; the match that reaches the limit is used whole.
    """
    matches = keep(matches.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("rank"))).filter("rank <= 10"))
    chosen = matches.groupBy("class").agg(F.min("rank").alias("rank"))
    starts = keep(first_methods(chosen, methods, 3).drop("rank"))
    totals = starts.join(flow_totals(flows(starts.select("start_class", "start_method"), classes, methods, steps, members)), ["start_class", "start_method"])
    found = matches.join(totals.withColumnRenamed("start_class", "class"), "class")
    before = F.coalesce(F.count(F.lit(1)).over(W.partitionBy("query").orderBy("rank").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = found.withColumn("before", before).filter(F.col("before") < limit)
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("n_steps"), "rank", "nth"))
    return found.withColumn("place", place).filter(F.col("place") <= limit).select("query", "place", "name", "n_steps")
