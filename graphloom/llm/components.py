"""Connected components: links are contracted where they lie, what remains by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, tidy

#: Links that one task may hold, if they all are one node's.
ONE_TASK = 1_000_000
#: Links that a task contracts at once.
PIECE = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b), and for each the smallest node that these links let it reach."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while True:
        one, two = root[x], root[y]
        apart = one != two
        if not apart.any():
            return nodes, nodes[root]
        x, y, one, two = x[apart], y[apart], one[apart], two[apart]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while ((onward := root[root]) != root).any():
            root = onward


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root: ``forest`` of each ``PIECE`` links of a task."""
    held: list[pa.RecordBatch] = []

    def ended() -> pa.RecordBatch:
        a, b = (np.concatenate([h.column(k).to_numpy() for h in held]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in forest(a, b)], names=["node", "root"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(h.num_rows for h in held) >= PIECE:
            yield ended()
            held = []
    if held:
        yield ended()


def components(links: DataFrame) -> DataFrame:
    """node, label: for each node of ``links`` (a, b) the smallest node it reaches.

    Each task contracts its own links first: a node is told with its root in each of the tasks where it
    occurs, once for each, and points to the smallest of these roots. Links remain only between different roots
    of one node, and are contracted in turn while that halves them; ``stars`` does the rest, if there is any.
    Then the pointers are followed back. Every round is written to the shared folder.
    """
    pointers, rest, before = [], links.select("a", "b").filter("a <> b"), None
    while True:
        found = rest.mapInArrow(tidy(_contract), "node long, root long").groupBy("node").agg(F.min("root").alias("label"), F.collect_set("root").alias("roots"))
        found = materialize(found.withColumn("roots", F.when(F.size("roots") > 1, F.col("roots"))), "contracted")
        pointers.append(found.select("node", "label"))
        rest = found.filter("roots IS NOT NULL").select(F.explode("roots").alias("a"), F.col("label").alias("b")).filter("a <> b")
        many = rest.count()
        if not many or before is not None and 2 * many > before:
            break
        before = many
    labels = stars(rest) if many else pointers.pop()
    for level in reversed(pointers):
        labels = level.join(labels.select(F.col("node").alias("label"), F.col("label").alias("onward")), "label", "left").select("node", F.coalesce("onward", "label").alias("label"))
    return labels


def stars(links: DataFrame) -> DataFrame:
    """``components`` by large-star and small-star steps alone.

    Each step is a grouped minimum with map-side aggregation and a join. The links
    of a node meet its minimum in one task, unless there are more than
    ``ONE_TASK`` links in all: then minima are written first, so that both sides of the join
    are plain shuffles, whose large partitions Spark splits. The rounds grow with
    the logarithm of the number of nodes. Every round is written to the shared folder.
    """

    def least(rows: DataFrame, low: DataFrame) -> DataFrame:
        return rows.join(materialize(low, "minima") if many else low, "a")

    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, many = None, edges.count() > ONE_TASK
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = least(both, low).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = least(large, low).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = materialize(small.filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before, many = now, now[0] > ONE_TASK
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
