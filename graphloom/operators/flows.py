"""Walks whose result depends on the order of visits: flows, exploration paths, suggestions.

These follow one path through a small graph, so the reachable part, bounded by
depth, is gathered by distributed joins first, and the walk itself is a loop on
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import keep, reach


def _reachable(starts: list[str], calls: DataFrame, max_depth: int, most: int) -> dict[str, list[str]]:
    """Called nodes of each node near ``starts``, in the order of their first call."""
    near = reach(calls.sparkSession.createDataFrame([(s,) for s in starts], "name string"), calls, max_depth + 1)
    first = calls.join(near.select(F.col("name").alias("src")), "src", "left_semi").groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    rows = first.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many calls for one flow")
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["src"], r["pos"], r["dst"])):
        out.setdefault(r["src"], []).append(r["dst"])
    return out


def _walk(start: str, out: dict[str, list[str]], max_depth: int) -> list[str]:
    seen: dict[str, None] = {}
    stack = [(start, 0)]
    while stack:
        node, depth = stack.pop()
        if node in seen or depth > max_depth:
            continue
        seen[node] = None
        stack += [(n, depth + 1) for n in reversed(out.get(node, []))]
    return list(seen) if len(seen) > 1 else []


def flow(start: str, calls: DataFrame, max_depth: int = 10, most: int = 100_000) -> list[str]:
    """Nodes in depth-first order from ``start`` along calls (src, dst, pos), each once; empty if fewer than two.

    A later call of the same node never changes the order. More than ``most`` different calls within reach are an error: such a graph isn't one flow.
    """
    return _walk(start, _reachable([start], calls, max_depth, most), max_depth)


def ranked_starts(entries: DataFrame, nodes: DataFrame, most: int = 20) -> list[str]:
    """Entry points (name, kind, degree) in the order in which flows start: main, hub, server, root, the highest degree first."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(("main", "hub", "server", "root"))], F.lit(4))
    rows = entries.join(nodes.select("name", "ord"), "name").orderBy(rank, F.desc("degree"), "ord").limit(most).collect()
    return [r["name"] for r in rows]


def key_flows(starts: list[str], calls: DataFrame, members: DataFrame, limit: int = 10, max_depth: int = 10, most: int = 100_000) -> list[list[str]]:
    """Flows of up to 20 starts, those that cross most modules of ``members`` (name, module) first; one that overlaps a kept one by over 0.8 is dropped."""
    starts = starts[:20]
    if not starts:
        return []
    out = _reachable(starts, calls, max_depth, most)
    found = [f for s in starts if (f := _walk(s, out, max_depth))]
    names = calls.sparkSession.createDataFrame([(n,) for n in sorted({n for f in found for n in f})], "name string")
    modules = {r["name"]: r["module"] for r in members.join(names, "name", "left_semi").select("name", "module").collect()}  # a row per node of a flow
    found.sort(key=lambda f: (-len({modules.get(n) for n in f}), -len(f)))
    kept: list[list[str]] = []
    for f in found:
        if all(len(set(f) & set(k)) <= 0.8 * max(len(f), len(k)) for k in kept):
            kept.append(f)
    return kept[:limit]


def exploration_path(edges: DataFrame, entries: DataFrame, members: DataFrame, max_steps: int = 5) -> list[str]:
    """Modules from the best entry point's along the heaviest edges, each once; empty if fewer than two.

    The start is the module of a main, hub, server or root, in this order, else the largest module.
    """
    edges = keep(edges.select("source", "target", "weight"))  # one row for two modules, read once for each step
    rank = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(("main", "hub", "server", "root"))])
    first = entries.join(members, "name").orderBy(rank, "ord").select("module").first() or members.groupBy("module").count().orderBy(F.desc("count"), "module").first()
    path = [first["module"]] if first else []
    while path and len(path) < max_steps:
        step = edges.filter((F.col("source") == path[-1]) & ~F.col("target").isin(path)).orderBy(F.desc("weight"), "target").first()
        if step is None:
            break
        path.append(step["target"])
    return path if len(path) > 1 else []


def suggestions(visible: DataFrame, members: DataFrame, edges: DataFrame, entries: DataFrame, deps: DataFrame, limit: int = 3) -> DataFrame:
    """kind, name, weight, in this order: a neighbour of the module that most visible classes belong to, up to three entry points, the two frequent targets.

    A frequent target is a known class that isn't visible; its weight is how many ``deps`` (src, dst, type) of visible ones name it.
    The first ``limit`` rows count; a name stays at its first place.
    """
    kind = lambda name, df, most: df.orderBy(F.desc("weight"), "name").limit(most).select(F.lit(name).alias("kind"), "name", "weight")
    own = visible.join(members, "name").groupBy("module").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "module").limit(1)
    near = kind("module", edges.join(own, edges["source"] == own["module"]).select(F.col("target").alias("name"), "weight"), 1)
    rest = kind("entry", entries.join(visible, "name", "left_anti").select("name", F.col("degree").alias("weight")), 3)
    named = deps.join(visible.select(F.col("name").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("name")).agg(F.count(F.lit(1)).alias("weight"))
    named = named.join(visible, "name", "left_anti").join(members.select("name").distinct(), "name", "left_semi")
    target = kind("target", named.join(rest, "name", "left_anti"), 2)
    place = F.when(F.col("kind") == "module", 0).when(F.col("kind") == "entry", 1).otherwise(2)
    return near.unionByName(rest).unionByName(target).orderBy(place, F.desc("weight"), "name").limit(limit)
