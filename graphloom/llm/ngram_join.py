"""Near duplicates by a parity-sketch join on word shingles.

Two sets link if 100 times their intersection is at least ``percent`` times
their union. Then their symmetric difference is at most a bound that follows
from their sizes. Every set becomes a parity sketch: its shingle hashes, cut
into chunks by their leading bits, are XORed chunk by chunk. A shingle of the
symmetric difference changes one chunk, so the number of chunks that differ is
a lower bound of the difference, and of one chunk more than the bound, some
chunk is equal: the pigeonhole join. Chunk counts hold for a size band and the
next one; a set takes part in the two bands where it can have partners. As
only equal chunks that aren't empty are joined, a set sends its first chunks
until it has one more filled chunk than its bound, and ``spare(n)`` beyond. So
linked sets share more than ``relied(n)`` values, and every set may leave out
that many: those that most sets have. The rarest shared value of a pair always
remains with both.

Equal sets are one class and are joined once. Chunks travel in packed blocks, not rows: a task sorts
what it has by chunk value, deals it to value ranges, and each range is grouped
in numpy. Chunk values that many sets of a batch share are reduced in the map task: all
its sets are paired with the smallest, and only three of them travel on.

Each candidate is verified on the shingle sets of the whole texts. Candidates
are first each set and its smallest partners, if they share enough values, then
sets of a remaining chunk value that still lie in different components. For these, sets
are sketched again without common shingles, those of chunk values that many
components share: leaving the same shingles out of all sets doesn't raise any
difference, so the bounds hold. A set with too few others left keeps its first
values. So members of one large group aren't paired with each
other, and no link between components is lost.

No pair leaves a task before it is known to link. The sets that share a value
meet in the star of the smallest of them; a star is cut into slices of bounded
size, and each two slices make a block, which is a task's unit. Inside it the Hamming distances of
bit sketches rule out most pairs, exact intersections decide the others, and
pairs that are already connected are passed over, so a block gives fewer pairs of labels than it has sets.

Chunk counts leave room for chance (``margin`` standard deviations). A set that
nevertheless fills too few chunks is compared with every document, in blocks of such sets.

Defined cases: null, empty and blank texts have the empty set, link with
nothing and are their own component. A document without an id gets component
null, is compared with none and is kept. Rows that repeat an id and a text are
equal sets. A very long text is one set like others; only its own task holds it. Ties go to the smaller id. An empty table gives an empty result. ``near_dedup`` keeps extra
columns, whatever their names.
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

from ._common import materialize, maybe_broadcast, shared_dir, small_batches, text_of, tidy
from ._shingles import mix, shingles
from .components import components

PERCENT = 75
#: Documents that a task has in hand at once.
PIECE = 1024
#: Tasks that ranges of chunk values are dealt to, at most; a task takes its ranges one at a time.
TASKS = 1 << 15
#: Rows of ids or slices that are broadcast at most.
LISTED = 500_000
#: What a set adds to the weight of a slice beside its shingles.
OVERHEAD = 500


@dataclass(frozen=True)
class Tuning:
    """How the join works; results are the same for any values.

    ``crowd``: sets of a batch that share a chunk value before the map task
    reduces them. ``crowded``: components that share a chunk value whose shingles
    then count as common. ``common``: common shingles left out of the second
    sketches, at most. ``margin``: standard deviations of filled chunks that a
    chunk count leaves room for. ``slice``: weight of a slice, shingles and ``OVERHEAD`` for each set.
    """

    crowd: int = 16
    crowded: int = 12
    common: int = 1_000_000
    margin: float = 6.0
    slice: int = 500_000


TUNING = Tuning()
#: Up to this size every shingle is a chunk of its own.
TINY = 32
_SCOPE = 0xD6E8FEB86659FD93


def edges_of_bands(percent: int, top: int) -> list[int]:
    """First sizes of the bands: a set and a larger partner are in the same band or in neighbouring ones."""
    edges = [1, 2]
    while edges[-1] <= top:
        edges.append(max(edges[-1] + 1, 100 * (edges[-1] - 1) // percent + 1))
    return edges


def difference(n: int, m: int, percent: int) -> int:
    """The largest symmetric difference of linked sets of n and m elements.

    From 100 * i >= percent * (n + m - i), the intersection i is at least
    ceil(percent * (n + m) / (100 + percent)).
    """
    return n + m - 2 * -(-percent * (n + m) // (100 + percent))


def spare(n: int) -> int:
    """Filled chunks that a set of n sends beyond its need. Some may be missing by chance; ``relied`` on is half."""
    return min(n // 16 + 6, n // 2)


def chunk_count(need: int, n: int, margin: float) -> int:
    """Chunks of a band's sketches: ``need`` filled ones of n shingles, with room for those that stay empty."""
    chunks = need
    while n > TINY and chunks < 4 * n:
        share = math.exp(-n / chunks)
        spread = math.sqrt(chunks * share * (1 - (1 + n / chunks) * share))
        if chunks * (1 - share) - margin * spread - 2 >= need:
            return chunks
        chunks += 1 + chunks // 64
    return 1 << 32


def relied(n: Column) -> Column:
    """Half of ``spare``: linked sets of n or more share more values than this."""
    return F.floor(F.least(F.floor(n / 16) + 6, F.floor(n / 2)) / 2)


class Sketcher:
    """Chunk values of sets under one threshold."""

    def __init__(self, percent: int, margin: float):
        self.percent, self.margin = percent, margin
        self.edges = edges_of_bands(percent, 1)
        self.cached: dict[int, list[tuple[int, int, int]]] = {}

    def scopes(self, n: int) -> list[tuple[int, int, int]]:
        """(scope, chunks, filled chunks to send) for each band in which a set of n can have partners."""
        if n not in self.cached:
            if self.edges[-1] <= 100 * n // self.percent + 1:
                self.edges = edges_of_bands(self.percent, 2 * n)
            band = int(np.searchsorted(self.edges, n, side="right")) - 1
            out = []
            for scope, partner in ((band, 100 * n // self.percent), (band - 1, self.edges[band] - 1)):
                if scope >= 0 and 100 * partner >= self.percent * n:
                    first, last, most = self.edges[scope], self.edges[scope + 1] - 1, self.edges[scope + 2] - 1
                    needs = [(m, self.bound(m, 100 * m // self.percent) + 1 + spare(m) * 2 // 3) for m in (first, last)]
                    needs.append((most, self.bound(most, last) + 1 + spare(most) * 2 // 3))
                    chunks = max(chunk_count(need, m, self.margin) for m, need in needs)
                    out.append((scope, chunks, self.bound(n, partner) + 1 + spare(n)))
            self.cached[n] = out
        return self.cached[n]

    def bound(self, n: int, partner: int) -> int:
        """The largest difference of a set of n and linked sets up to ``partner``; it rises and falls by one with their parity."""
        return max(difference(n, m, self.percent) for m in range(max(1, partner - 3), partner + 1))

    def chunks(self, found: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each scope of a set of n: the values of the chunks to send, where each starts in ``found``, and how many were due.

        ``found`` may be a part of the set, if every set leaves out the same shingles.
        """
        for scope, chunks, send in self.scopes(n):
            at = ((found >> np.uint64(32)) * np.uint64(chunks)) >> np.uint64(32)
            starts = np.flatnonzero(np.diff(at, prepend=np.uint64(0xFFFFFFFFFFFFFFFF)))[: send + 1]
            last = int(starts[send]) if len(starts) > send else len(found)
            starts = starts[:send]
            if len(starts):
                parity = np.bitwise_xor.reduceat(mix(found[:last] + np.uint64(_SCOPE)), starts)
                value = mix(parity ^ mix(at[starts] + np.uint64((scope + 1) * _SCOPE % (1 << 64))))
                value = value & np.uint64(0xFFFFFFFFFFFFFF80) | np.uint64(scope % 128)
                yield value, np.append(starts, last), send
            else:
                yield np.zeros(0, np.uint64), np.zeros(1, np.int64), send

    def values(self, found: np.ndarray, n: int) -> tuple[np.ndarray, bool]:
        """The chunk values that a set sends, each with its scope in the lowest seven bits, and whether they are too few to promise a shared one."""
        sent = [(v, due) for v, _, due in self.chunks(found, n)]
        return np.concatenate([np.zeros(0, np.uint64), *(v for v, _ in sent)]), any(len(v) < due - spare(n) // 3 for v, due in sent)


def set_keys(found: np.ndarray) -> tuple[int, int]:
    """Two sums of 64 bits that name a set."""
    return int(mix(found + np.uint64(1)).sum().astype(np.int64)), int(mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().astype(np.int64))


_PACKED = pa.schema([("range", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_ROWS = "kind int, a long, b long, c long, d long"


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct rows (a, b) with their counts, as three columns."""
    if not len(a):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 0) | (np.diff(b) != 0))))
    return np.column_stack((a[first], b[first], np.diff(first, append=len(a))))


def _grouped(value: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """value, key, group start and group size of the rows whose value has several keys, sorted and distinct."""
    order = np.argsort(value, kind="stable")
    value, key = value[order], key[order]
    same = np.concatenate(([False], value[1:] == value[:-1], [False]))
    some = same[1:] | same[:-1]
    value, key = value[some], key[some]
    order = np.lexsort((key, value))
    value, key = value[order], key[order]
    if len(value):
        fresh = np.concatenate(([True], (value[1:] != value[:-1]) | (key[1:] != key[:-1])))
        value, key = value[fresh], key[fresh]
    starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, np.int64)
    sizes = np.diff(starts, append=len(value))
    row_size, row_start = np.repeat(sizes, sizes), np.repeat(starts, sizes)
    several = row_size > 1
    return value, key, np.where(several, row_start, -1), row_size


def _sketch(percent: int, bits: int, tuning: Tuning, common: Broadcast | None = None):
    """Packed chunk values and documents; with ``common``, of the sets without these shingles.

    The second number of a document is twice its set's size, and one more if too few chunks are filled to promise a shared value.
    """

    def packed(kinds: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kinds, strict=True), _PACKED, strict=True)], schema=_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, known, turn = Sketcher(percent, tuning.margin), set(), 0
        for batch in batches:
            rows, values, keys = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                found = shingles(text.as_py())
                k1, k2 = set_keys(found)
                n = len(found)
                if common is not None:
                    found = found[~_among(found, common.value)]
                sent, short = sketcher.values(found, n) if n else (found, False)
                rows.append((doc or 0, 2 * n + short, k1, k2, doc is not None))
                if n and doc is not None and k1 not in known:
                    known.add(k1)
                    values.append(sent)
                    keys.append(np.full(len(sent), k1, np.int64))
            if not rows:
                continue
            turn += 1
            side = (turn * 7919 + rows[0][0]) % (1 << bits)
            kinds = [(side, 3, np.array(rows, np.int64).tobytes())]
            if values:
                value, key = np.concatenate(values), np.concatenate(keys)
                order = np.argsort(value, kind="stable")
                value, key = value[order], key[order]
                starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, np.int64)
                sizes = np.diff(starts, append=len(value))
                crowd = sizes >= tuning.crowd
                if crowd.any():
                    inside = np.repeat(crowd, sizes)
                    v, k, at, _ = _grouped(value[inside], key[inside])
                    kinds.append((side, 0, _pairs(k, k[at]).tobytes()))
                    kinds.append((side, 1, np.column_stack((v.view(np.int64), k)).tobytes()))
                    stay = ~inside
                    stay_more = np.arange(len(v)) - at < 3
                    value, key = np.concatenate((value[stay], v[stay_more])), np.concatenate((key[stay], k[stay_more]))
                    order = np.argsort(value, kind="stable")
                    value, key = value[order], key[order]
                part = (value >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(part, prepend=-1, append=1 << bits))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    kinds.append((int(part[a]), 2, value[a:b].tobytes() + key[a:b].tobytes()))
            for at in range(0, len(kinds), 32):
                yield packed(kinds[at : at + 32])

    return run


def _among(found: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which elements of ``found`` are in the sorted array."""
    if not len(ordered):
        return np.zeros(len(found), bool)
    return ordered[np.minimum(np.searchsorted(ordered, found), len(ordered) - 1)] == found


def _common(percent: int, margin: float):
    """The shingles behind the chunk values that a text is listed for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(percent, margin)
        for batch in batches:
            out = [np.zeros(0, np.uint64)]
            for wanted, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                found, wanted = shingles(text.as_py()), np.sort(np.array(wanted, np.int64).view(np.uint64))
                for value, starts, _ in sketcher.chunks(found, len(found)):
                    for i in np.flatnonzero(_among(value, wanted)):
                        out.append(found[starts[i] : starts[i + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["shingle"])

    return run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups equal chunk values of each range, which comes in one run: kind 0 candidates (set, smallest set, count), kind 1 shared values (value, set), kind 3 documents."""

    def rows(kind: int, *columns: np.ndarray, mask: np.ndarray | None = None) -> pa.RecordBatch:
        n = len(columns[0])
        filled = [pa.array(c, pa.int64(), mask=mask if i == 0 else None) for i, c in enumerate(columns)] + [pa.nulls(n, pa.int64())] * (4 - len(columns))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *filled], names=["kind", "a", "b", "c", "d"])

    def ended(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not payloads:
            return
        value = np.concatenate([np.frombuffer(p, np.uint64, len(p) // 16) for p in payloads])
        key = np.concatenate([np.frombuffer(p, np.int64, offset=len(p) // 2) for p in payloads])
        value, key, start, size = _grouped(value, key)
        mine = start >= 0
        pairs = _pairs(key[mine], key[start[mine]])
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        if len(pairs):
            yield rows(0, *pairs.T)
        if mine.any():
            yield rows(1, value[mine].view(np.int64), key[mine])

    now, payloads = -1, []
    for batch in batches:
        for r, kind, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if r != now:
                yield from ended(payloads)
                now, payloads = r, []
            if kind == 2:
                payloads.append(payload.as_py())
            else:
                found = np.frombuffer(payload.as_py(), np.int64).reshape(-1, {0: 3, 1: 2, 3: 5}[kind])
                if kind == 3:
                    yield rows(3, *(found[:, i] for i in range(4)), mask=found[:, 4] == 0)
                elif len(found):
                    yield rows(kind, *(found[:, i] for i in range(found.shape[1])))
    yield from ended(payloads)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets of shingles link."""
    shared = int(_among(a, b).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def bit_sketches(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of ``bits`` parities for each set; two rows differ in no more bits than the sets' symmetric difference has elements."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for row, found in zip(out, sets, strict=True):
        at = (found >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
        row[:] = np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.uint64)
    return out


def block_links(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of labels that links between ``first`` and ``second`` (flags) connect, each label with the smallest it reaches."""
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    sets, first, second, label, size = [sets[i] for i in order], first[order], second[order], label[order], size[order]
    root = label.copy()
    sketch = bit_sketches(sets, 1 << min(15, max(6, int(8 * np.median(size)).bit_length())))
    for x in np.flatnonzero(first):
        low, high = np.searchsorted(size, (-(-percent * size[x] // 100), 100 * size[x] // percent + 1))
        near = low + np.flatnonzero(second[low:high] & (root[low:high] != root[x]))
        both = size[near] + size[x]
        most = both - 2 * (-(-percent * both // (100 + percent)))
        apart = np.bitwise_count(sketch[near] ^ sketch[x]).sum(axis=1, dtype=np.int64)
        may = np.flatnonzero(apart <= most)
        for y in near[may[np.argsort(apart[may], kind="stable")]]:
            if root[x] != root[y] and linked(sets[x], sets[y], percent):
                old, new = max(root[x], root[y]), min(root[x], root[y])
                root[root == old] = new
    return sorted({(int(a), int(b)) for a, b in zip(label, root, strict=True) if a != b})


def _blocks(percent: int):
    """Labels (a, b) that are connected by links in sorted blocks of hub, i, j, slice, lead, label, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(key: tuple[int, int, int], rows: list[tuple]) -> pa.RecordBatch:
            part, lead, label = (np.array(c) for c in zip(*(r[:3] for r in rows), strict=True))
            first, second = lead & (part == key[1]), part == key[2]
            found = block_links([r[3] for r in rows], first, second, label, percent)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        block, rows = None, []
        for batch in batches:
            fixed = [c.to_pylist() for c in batch.columns[:-1]]
            for hub, i, j, part, lead, label, text in zip(*fixed, batch.column(6).cast(pa.binary()), strict=True):
                if (hub, i, j) != block:
                    if len(rows) > 1:
                        yield ended(block, rows)
                    block, rows = (hub, i, j), []
                rows.append((part, lead, label, shingles(text.as_py())))
        if len(rows) > 1:
            yield ended(block, rows)

    return run


def _links(stars: DataFrame, sets: DataFrame, docs: DataFrame, percent: int, tuning: Tuning) -> DataFrame:
    """Labels (a, b) that links connect, in each star those of its leading members with all others.

    ``stars``: hub, member, lead. ``sets``: member, n, label. The leading
    members of a star are cut into slices by weight, and the others into further
    ones, unless all fit into one. Each block is two slices, the first of leading members.
    """
    weight = F.col("n") + OVERHEAD
    stars = materialize(stars.groupBy("hub", "member").agg(F.max("lead").alias("lead")).join(sets, "member"), "stars")
    per = stars.groupBy("hub").agg(F.coalesce(F.sum(F.when(F.col("lead"), weight)), F.lit(0)).alias("ahead"), F.sum(weight).alias("all"))
    ahead = F.ceil(F.col("ahead") / tuning.slice)
    per = per.select("hub", ahead.alias("ahead"), F.when(F.col("all") <= tuning.slice, 0).otherwise(F.ceil((F.col("all") - F.col("ahead")) / tuning.slice)).alias("behind")).filter("ahead > 0")
    per = materialize(per, "slices")
    at = F.when(F.col("lead"), F.pmod(F.xxhash64("member"), F.col("ahead"))).when(F.col("behind") == 0, 0).otherwise(F.col("ahead") + F.pmod(F.xxhash64("member"), F.greatest(F.col("behind"), F.lit(1))))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("slice") >= F.col("ahead"), F.col("ahead") - 1).otherwise(F.col("ahead") + F.col("behind") - 1))
    placed = stars.join(maybe_broadcast(per, per.count(), LISTED), "hub").withColumn("slice", at.cast("long")).withColumn("other", F.explode(others))
    placed = placed.select("hub", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), "slice", "member", "lead", "label")
    texts = _texts_of(docs, stars.select(F.col("member").alias("id_"))).withColumnRenamed("id_", "member")
    rows = placed.join(texts, "member").select("hub", "i", "j", "slice", "lead", "label", "text")
    rows = rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    return materialize(rows.mapInArrow(tidy(_blocks(percent)), "a long, b long"), "links")


def _against(queries: Broadcast, percent: int):
    """Links (a, b) of each document with the listed sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(found) for _, found in queries.value])
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                found = shingles(text.as_py())
                for i in np.flatnonzero((100 * np.minimum(sizes, len(found)) >= percent * np.maximum(sizes, len(found))) & (len(found) > 0)):
                    if doc is not None and linked(queries.value[i][1], found, percent):
                        out.append((queries.value[i][0], doc))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _short_links(short: DataFrame, docs: DataFrame, percent: int, tuning: Tuning) -> DataFrame:
    """Links (a, b) of the sets (id_, n) that fill too few chunks, with all documents, in blocks of bounded size. Almost always there is none."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "a long, b long")
    blocks = short.agg(F.ceil(F.sum(F.col("n") + OVERHEAD) / tuning.slice)).first()[0] or 0
    for k in range(blocks):
        part = _texts_of(docs, short.filter(F.pmod(F.xxhash64("id_"), F.lit(blocks)) == k))
        queries = spark.sparkContext.broadcast([(r.id_, shingles(bytes(r.text))) for r in part.select("id_", F.encode("text", "UTF-8").alias("text")).collect()])
        out = out.unionByName(materialize(docs.mapInArrow(tidy(_against(queries, percent)), "a long, b long").filter("a <> b").distinct(), "short"))
    return out


def _sketched(source: DataFrame, percent: int, tuning: Tuning, common: Broadcast | None = None) -> DataFrame:
    """What ``_match`` finds in ``source`` (id_, text), written by kind."""
    spark = source.sparkSession
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(5, math.ceil(math.log2(max(1, size / 10 / 400_000))))  # about 400,000 chunks to a range
    packed = source.mapInArrow(tidy(_sketch(percent, bits, tuning, common)), "range int, kind int, payload binary").repartition(min(TASKS, 1 << bits), "range").sortWithinPartitions("range")
    path = f"{shared_dir(spark)}/sketches-{np.random.default_rng().integers(1 << 62):x}"
    packed.mapInArrow(tidy(_match), _ROWS).write.partitionBy("kind").parquet(path)
    return spark.read.schema("a long, b long, c long, d long, kind int").parquet(path)


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` (id_, text) of the listed ids (id_), each once. ``ids`` are counted as they are; only where they are many are they made distinct before."""
    ids, many = ids.select("id_"), ids.count()
    if many > LISTED:
        ids = materialize(ids.distinct(), "ids")
        many = ids.count()
    return docs.join(maybe_broadcast(ids, many, LISTED), "id_", "left_semi").dropDuplicates(["id_"])


def _held(rows: DataFrame) -> DataFrame:
    """Of (value, n, rep, label) those whose value joins components, without the ``relied(n)`` most crowded of each set and scope."""
    spread = rows.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("sets")).filter("low <> high").select("value", "sets")
    rows = rows.join(spread, "value").withColumn("scope", F.col("value").bitwiseAND(127))
    place = F.row_number().over(W.partitionBy("rep", "scope").orderBy(F.desc("sets"), "value"))
    return materialize(rows.withColumn("place", place).filter(F.col("place") > relied(F.col("n"))).select("value", "n", "rep", "label"), "held")


def _stars(held: DataFrame, lead: Column) -> DataFrame:
    """hub, member, lead: the sets of each value in the star of the smallest of them."""
    hubs = held.groupBy("value").agg(F.min("rep").alias("hub"))
    return held.join(hubs, "value").select("hub", F.col("rep").alias("member"), lead.alias("lead")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, tuning: Tuning = TUNING) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``."""
    with small_batches(docs.sparkSession, PIECE):
        return _components_of(docs, id_col, text_col, percent, tuning)


def _components_of(docs: DataFrame, id_col: str, text_col: str, percent: int, tuning: Tuning) -> DataFrame:
    spark = docs.sparkSession
    source = docs.select(docs[id_col].cast("long").alias("id_"), text_of(docs, text_col).alias("text"))
    stored = _sketched(source, percent, tuning)
    rows = stored.filter("kind = 3").select(F.col("a").alias("doc_id"), F.shiftright("b", 1).alias("n"), (F.col("b") % 2 == 1).alias("short"), F.col("c").alias("k1"), F.col("d").alias("k2"))
    classes = materialize(rows.filter("doc_id IS NOT NULL AND n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.max("short").alias("short")), "classes")
    by_key = classes.select(F.col("k1").alias("key"), "n", "rep")

    def labelled(labels: DataFrame | None) -> DataFrame:
        """member, n, label of each class."""
        found = classes.select(F.col("rep").alias("member"), "n")
        return found.withColumn("label", F.col("member")) if labels is None else found.join(labels.withColumnRenamed("node", "member"), "member", "left").withColumn("label", F.coalesce("label", "member"))

    def shared(found: DataFrame, labels: DataFrame) -> DataFrame:
        """value, n, rep, label of all sets that share a chunk value."""
        keyed = found.filter("kind = 1").select(F.col("a").alias("value"), F.col("b").alias("key")).distinct()
        return keyed.join(by_key, "key").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("value", "n", "rep", F.coalesce("label", "rep").alias("label"))

    found = stored.filter("kind = 0 AND a <> b").groupBy(F.col("a").alias("x"), F.col("b").alias("y")).agg(F.sum("c").alias("times"))
    one, two = (by_key.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("rep").alias(d)) for k, d in (("x", "a"), ("y", "b")))
    fits = (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent) & (F.col("a") != F.col("b")) & (F.col("times") > relied(F.least("n_x", "n_y")))
    candidates = materialize(found.join(one, "x").join(two, "y").filter(fits).select("a", "b"), "candidates")
    stars = candidates.select(F.col("b").alias("hub"), F.col("a").alias("member"), F.lit(False).alias("lead"))
    links = _links(stars.unionByName(candidates.select(F.col("b").alias("hub"), F.col("b").alias("member"), F.lit(True).alias("lead")).distinct()), labelled(None), source, percent, tuning)
    links = links.unionByName(_short_links(classes.filter("short").select(F.col("rep").alias("id_"), "n"), source, percent, tuning))
    labels = materialize(components(links), "labels")

    first = materialize(shared(stored, labels), "shared")
    held = _held(first)
    crowd = first.select("value", "label").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("labels")).filter(F.col("labels") >= tuning.crowded)
    listed = first.join(crowd, "value").groupBy("value").agg(F.min("rep").alias("id_"), F.max("labels").alias("labels")).orderBy(F.desc("labels"), "value").limit(tuning.common // 4)
    listed = materialize(listed.groupBy("id_").agg(F.collect_list("value").alias("wanted")), "listed")
    behind = listed.join(_texts_of(source, listed), "id_").select("wanted", "text").mapInArrow(tidy(_common(percent, tuning.margin)), "shingle long")
    behind = behind.distinct().limit(tuning.common).toPandas()["shingle"].to_numpy(np.int64)  # so many numbers at most
    common = spark.sparkContext.broadcast(np.sort(behind.view(np.uint64)))
    again = _sketched(_texts_of(source, held.select(F.col("rep").alias("id_"))), percent, tuning, common)
    hollow = again.filter("kind = 3 AND b % 2 = 1").select(F.col("a").alias("rep"), F.lit(True).alias("hollow"))
    rest = _stars(_held(shared(again, labels)), F.lit(True))
    if not hollow.isEmpty():
        hollow = hollow.distinct()
        some = held.join(held.join(hollow, "rep", "left_semi").select("value").distinct(), "value", "left_semi").join(hollow, "rep", "left")
        rest = rest.unionByName(_stars(some, F.coalesce("hollow", F.lit(False))))
    labels = materialize(components(links.unionByName(_links(rest, labelled(labels), source, percent, tuning))), "labels")

    named_rows = rows.join(classes.drop("short"), ["k1", "k2", "n"], "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    whole = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("label", "rep", "doc_id"))
    return named_rows.select("doc_id", F.col("n").alias("n_shingles"), whole.alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, one for each, and those without an id."""
    stays = near_duplicates(docs, id_col, text_col, percent).filter("doc_id = component_id").select(F.col("doc_id").alias("i_")).distinct()
    named = docs.filter(docs[id_col].isNotNull())
    kept = named.join(stays, named[id_col].cast("long") == stays["i_"], "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.filter(docs[id_col].isNull()))
