"""Hard negatives by a norm-bucketed search for the largest inner products.

Rows are sorted by the length of their vector, longest first, and cut into
buckets. A score is at most the product of both lengths (Cauchy-Schwarz), so a
bucket whose longest vector can't reach an anchor's limit is passed over: the lower
limit of each window, and the running kth score once k rows are found. Buckets
are searched in rounds that grow fourfold from the longest on; between rounds the
kth scores of all tasks are brought together. So later rounds give few rows however
many tasks they have, and buckets that no anchor can use aren't read.

Anchors are a stated share of the rows. They go in blocks of ``block``
components, each broadcast, against all buckets. The driver holds one block with its
positives and kth scores, nothing that grows with the table.

A component x becomes floor(scale * x), and scores are exact: below 2^53
products of lengths allow float64, above them int64.

Defined cases: rows with a null label, id or vector, or with a null or non-finite
component, take no part, nor do rows so long that scores don't fit 64 bits (squared
length of 2^62 or more). Of two vectors of different widths the shorter one
counts as filled up with zeros; an empty one scores 0. Rows that repeat an id count
each, as anchors too, but none is a positive or negative of its own id. Equal
scores go by the smaller id. An empty table gives an empty result. Other columns are not looked at,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import materialize, small_batches, tidy

#: Rows of a bucket, and rows that one task packs.
BUCKET, PART = 512, 50_000
#: Components of a block of anchors.
BLOCK = 2_000_000
#: Rounds grow by so much.
GROWTH = 4
#: Squared lengths from which scores might not fit 64 bits.
TOO_LONG = 2.0**62
_LEAST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Mining:
    """``positives`` of an anchor; ``negatives`` of each, with scores of ``low`` to ``high`` percent of the positive's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256


def usable(rows: DataFrame, label: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, label, width, square, vector of the rows that take part; the vector's components are whole numbers."""
    whole = F.transform(rows[vector_col].cast("array<double>"), lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.floor(scale * x).cast("double")))
    out = rows.select(rows[id_col].cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("vector")).filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    out = out.withColumn("square", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return out.filter(F.col("square") < TOO_LONG).select("id", "label", F.size("vector").alias("width"), "square", "vector")


_PACKED = "part int, longest double, width int, ids binary, labels binary, vectors binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of rows (part, id, label, width, square, vector) that come by falling square."""

    def bucket(rows: list[tuple]) -> pa.RecordBatch:
        width = max(r[3] for r in rows)
        matrix = np.zeros((len(rows), width))
        for line, r in zip(matrix, rows, strict=True):
            line[: r[3]] = r[5]
        ids, labels = (np.array([r[i] for r in rows], np.int64).tobytes() for i in (1, 2))
        fields = (rows[0][0], math.sqrt(max(r[4] for r in rows)), width, ids, labels, matrix.tobytes())
        kinds = (pa.int32(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(fields, kinds, strict=True)], names=[x.split()[0] for x in _PACKED.split(", ")])

    rows: list[tuple] = []
    for batch in batches:
        fixed = [c.to_pylist() for c in batch.columns[:-1]]
        for line in zip(*fixed, (x.values.to_numpy(zero_copy_only=False) for x in batch.column(5)), strict=True):
            rows.append(line)
            if len(rows) == BUCKET:
                yield bucket(rows)
                rows = []
    if rows:
        yield bucket(rows)


def buckets(rows: DataFrame, count: int) -> DataFrame:
    """The rows in buckets; ``part`` rises as ``longest`` falls."""
    ordered = rows.repartitionByRange(max(1, math.ceil(count / PART), min(8, count // BUCKET)), F.desc("square"), "id").sortWithinPartitions(F.desc("square"), "id")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "id", "label", "width", "square", "vector")
    return materialize(ordered.mapInArrow(tidy(_packed), _PACKED), "buckets")


@dataclass
class Block:
    """Anchors with the windows of their searches; ``owner`` is a search's anchor, and only rows of scores from ``floor`` to ``ceiling`` count."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    lengths: np.ndarray
    owner: np.ndarray
    floor: np.ndarray
    ceiling: np.ndarray
    same_label: bool
    wanted: int

    def reach(self) -> float:
        """The length below which no vector counts for any search."""
        long = np.maximum(self.lengths[self.owner], 1e-300)
        live = self.floor <= self.ceiling
        with np.errstate(over="ignore"):  # an anchor of length 0 may need any or no row
            return float(np.min(self.floor[live] / long[live], initial=np.inf)) * (1 - 1e-9)


def _products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _percent(score: np.ndarray, percent: int) -> np.ndarray:
    """``percent`` of each score, rounded down; a product with the whole score might not fit 64 bits."""
    return percent * (score // 100) + percent * (score % 100) // 100


def _best(search: np.ndarray, score: np.ndarray, other: np.ndarray, wanted: int) -> np.ndarray:
    """Places of the first ``wanted`` of each search."""
    order = np.lexsort((other, -score, search))
    ranked = search[order]
    first = np.flatnonzero(np.diff(ranked, prepend=-1))
    rank = np.arange(len(ranked)) - np.repeat(first, np.diff(first, append=len(ranked)))
    return order[rank < wanted]


_FOUND = "search long, other long, score long"


def _searched(spread: Broadcast, at_once: int = 1024):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = spread.value
        floor = block.floor.copy()
        held = [np.zeros(0, np.int64)] * 3  # search, other, score
        searches_of = np.argsort(block.owner, kind="stable")
        bounds = np.searchsorted(block.owner[searches_of], np.arange(len(block.ids) + 1))
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                vectors = np.frombuffer(row["vectors"]).reshape(len(ids), row["width"])
                bound = block.lengths * row["longest"] * (1 + 1e-9)
                able = (floor <= block.ceiling) & (bound[block.owner] >= floor)
                anchors = np.flatnonzero(np.bincount(block.owner[able], minlength=len(block.ids)))
                new = []
                for start in range(0, len(anchors), at_once):
                    some = anchors[start : start + at_once]
                    score = _products(block.vectors[some], vectors, float(bound[some].max()))
                    fits = (labels == block.labels[some][:, None]) == block.same_label
                    fits &= ids != block.ids[some][:, None]
                    turns = bounds[some + 1] - bounds[some]
                    for k in range(int(turns.max(initial=0))):
                        mine = np.flatnonzero(turns > k)
                        search = searches_of[bounds[some[mine]] + k]
                        hit = fits[mine] & (score[mine] >= floor[search][:, None]) & (score[mine] <= block.ceiling[search][:, None])
                        x, y = np.nonzero(hit)
                        new.append((search[x], ids[y], score[mine][x, y]))
                if new:
                    held = [np.concatenate(c) for c in zip(held, *new, strict=True)]
                    kept = _best(held[0], held[2], held[1], block.wanted)
                    held = [c[kept] for c in held]
                    full = np.bincount(held[0], minlength=len(floor)) >= block.wanted
                    least = np.full(len(floor), np.iinfo(np.int64).max)
                    np.minimum.at(least, held[0], held[2])
                    floor = np.where(full, np.maximum(floor, least), floor)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held], names=["search", "other", "score"])

    return run


def _search(packed: DataFrame, parts: int, block: Block) -> DataFrame:
    """search, other, score, rank: the first ``block.wanted`` rows of each search."""
    spark = packed.sparkSession
    best = W.partitionBy("search").orderBy(F.desc("score"), "other")
    found, first, step = None, 0, 1
    while first < parts:
        reach = block.reach()
        wanted = packed.filter(F.col("part").between(first, first + step - 1) & (F.col("longest") >= reach)) if reach > 0 else packed.filter(F.col("part").between(first, first + step - 1))
        spread = spark.sparkContext.broadcast(block)
        new = wanted.mapInArrow(tidy(_searched(spread)), _FOUND)
        found = new if found is None else found.select("search", "other", "score").unionByName(new)
        found = materialize(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= block.wanted), "found")
        first, step = first + step, step * GROWTH
        if first < parts:
            for r in found.filter(F.col("rank") == block.wanted).select("search", "score").toLocalIterator():  # one row for each search of the block at most
                block.floor[r.search] = max(block.floor[r.search], r.score)
        spread.unpersist()
    return found


def hard_negatives(rows: DataFrame, is_anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", mining: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on id and vector's other columns as ``rows`` has them; ``label`` may replace the stored one.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    with small_batches(spark, BUCKET):
        source = rows.withColumn("label", label) if label is not None else rows
        clean = materialize(usable(rows, rows[label_col] if label is None else label, id_col, vector_col, mining.scale), "usable")
        anchors = materialize(usable(source.filter(is_anchor), source[label_col], id_col, vector_col, mining.scale), "anchors")
        count, size = clean.count(), anchors.agg(F.sum(F.greatest("width", F.lit(1)))).first()[0] or 0
        out = spark.createDataFrame([], schema)
        if not count or not size:
            return out
        packed = buckets(clean, count)
        parts = packed.agg(F.max("part")).first()[0] + 1
        blocks = math.ceil(size / BLOCK)
        for k in range(blocks):
            out = out.unionByName(_mined(packed, parts, anchors.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k), mining))
    return out


def _mined(packed: DataFrame, parts: int, anchors: DataFrame, mining: Mining) -> DataFrame:
    """The hard negatives of one block of anchors."""
    spark = packed.sparkSession
    found = anchors.orderBy("id").toPandas()  # ``BLOCK`` components, about
    n = len(found)
    vectors = np.zeros((n, max([0, *found["width"]])))
    for line, x in zip(vectors, found["vector"], strict=True):
        line[: len(x)] = x
    ids, labels, lengths = found["id"].to_numpy(np.int64), found["label"].to_numpy(np.int64), np.sqrt(found["square"].to_numpy(float))
    top = np.iinfo(np.int64).max
    block = Block(ids, labels, vectors, lengths, np.arange(n), np.full(n, _LEAST), np.full(n, top), True, mining.positives)
    positives = _search(packed, parts, block).orderBy("search", "rank").toPandas()
    score = positives["score"].to_numpy(np.int64)
    floor = -_percent(-score, mining.low)
    block = Block(ids, labels, vectors, lengths, positives["search"].to_numpy(np.int64), floor, _percent(score, mining.high), False, mining.negatives)
    owners = spark.createDataFrame(list(zip(range(len(score)), ids[block.owner].tolist(), positives["other"].tolist(), score.tolist(), strict=True)), "search long, anchor_id long, positive_id long, positive_score long")
    negatives = _search(packed, parts, block).withColumnsRenamed({"other": "negative_id", "score": "negative_score"})
    return negatives.join(F.broadcast(owners), "search").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
