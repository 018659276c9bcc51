"""Packing token sequences by bin completion.

Lengths are whole numbers up to ``capacity``, so a corpus of any size is one
histogram of at most ``capacity`` counters. The driver packs that histogram:
around the largest length left it takes the filling with the least waste as
often as the counters allow. Each pattern uses up a counter or lowers it below
the pattern's need, so patterns stay few. If that packing misses the lower
bound, it branches over the other undominated fillings, depth first. The search ends after ``nodes`` branches with
the best packing found, which holds every piece in any case; ``nodes=None`` goes
on until the packing is proven. Tasks then
look up the slot of each piece from its length and its rank among the pieces
of that length; ranks come from counts per shard, and a length has as many
shards as rows in a shard, so a hot one is spread.

Defined cases: a null text is the empty text, which is one piece holding only
the closing id. Rows that repeat an id are packed as documents of their own, ties
in any order; a null id is one more value. A very long text is tokenized by its
chunks in its own task, and known chunks are kept up to ``CHUNK_BYTES``. An
empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import cache, materialize, small_batches, text_of, tidy

#: Tokenizers and the ids of known chunks, by file; a Python worker keeps both until it runs another operator's task.
_LOADED: dict[str, ChunkIds] = cache("chunks")
CHUNKS_KEPT = 500_000
#: Longer chunks are tokenized each time, so the ones kept take bounded memory.
CHUNK_BYTES = 64
#: New chunks that the tokenizer takes in one call at most.
TOGETHER = 10_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A run of ASCII symbols at a chunk's end, after an ASCII or Latin-1 letter. Apostrophes stay, as the tokenizer takes them with letters.
_END = re.compile(rb"([!-&(-/:-@\[-`{-~](?:(?<=[A-Za-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[!-&(-/:-@\[-`{-~]*)(?=\s|\Z)")


class ChunkIds(dict):
    """Ids of the chunks between blanks, as little-endian 32-bit bytes.

    The tokenizer never joins characters across a blank, nor letters and the symbols after them, so
    a text's ids are those of its chunks in a row, and symbols at a chunk's end are a chunk of their own.
    The new chunks of a text are tokenized in one call. Past ``CHUNKS_KEPT`` entries, they
    are still tokenized but no longer kept.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def of(self, text: bytes) -> bytes:
        """The ids of a whole text; one with ``<|`` may hold special tokens and is cut at blanks only."""
        chunks = text.split() if b"<|" in text else _END.sub(rb" \1", text.lower()).split()
        new = [c for c in set(chunks) if c not in self]
        if not new:
            return b"".join(map(self.__getitem__, chunks))
        own: dict[bytes, bytes] = {}
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            found = self.tokenizer.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)
            own.update((c, np.array(f.ids, dtype="<u4").tobytes()) for c, f in zip(part, found, strict=True))
        kept = [c for c in new if len(c) <= CHUNK_BYTES][: CHUNKS_KEPT - len(self)]
        self.update((c, own[c]) for c in kept)
        if len(kept) == len(new):
            return b"".join(map(self.__getitem__, chunks))
        return b"".join([own[c] if c in own else self[c] for c in chunks])

    def __missing__(self, chunk: bytes) -> bytes:
        return self.of(chunk)


def chunk_ids(path: str) -> ChunkIds:
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _LOADED[path] = ChunkIds(tokenizer)
    return _LOADED[path]


def _cut(path: str, capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end, step = chunk_ids(path), b"\0\0\0\0", 4 * capacity
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids = known.of(text.as_py() or b"") + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, value in zip(rows, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids, closed by id 0, cut only where longer than ``capacity``."""
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return source.mapInArrow(tidy(_cut(tokenizer or default_tokenizer(), capacity), "chunks"), "doc_id long, piece int, start long, length long, ids_crc32 long")


def completion(counts: list[int], largest: int, capacity: int, nodes: float) -> dict[int, int]:
    """The first of the least-waste fillings around ``largest``: {length: how many}.

    Branches take a length with a multiplicity, large lengths and many copies
    first, so the first leaf is the best-fit filling and becomes the incumbent;
    of fillings with equal waste the one of fewer, larger pieces comes first
    and dominates the rest. ``reach[i]`` is all that the lengths up to the
    i-th could still fill: a branch whose waste stays at the incumbent's or
    above even then is cut. Where ``nodes`` steps don't end the search, the
    sums that can be reached are computed and give the same filling.
    """
    room = capacity - largest
    free = {n: counts[n] - (n == largest) for n in range(1, min(largest, room) + 1) if counts[n] > (n == largest)}
    rising = sorted(free)
    reach, total = [], 0
    for n in rising:
        total += n * free[n]
        reach.append(total)
    best: tuple[int, dict[int, int]] = (room, {})
    left = nodes

    def search(room: int, below: int, used: dict[int, int]) -> None:
        nonlocal best, left
        if room < best[0]:
            best = (room, dict(used))
        at = min(below, bisect_right(rising, room))
        while at and left > 0 and best[0]:
            at -= 1
            if room - reach[at] >= best[0]:
                return
            n = rising[at]
            for times in range(min(room // n, free[n]), 0, -1):
                left -= 1
                search(room - n * times, at, used | {n: times})
                if left <= 0 or not best[0]:
                    return

    search(room, len(rising), {})
    if left <= 0 and best[0]:
        return next(completions(counts, largest, capacity))
    found = dict(best[1])
    found[largest] = found.get(largest, 0) + 1
    return found


def completions(counts: list[int], largest: int, capacity: int) -> Iterator[dict[int, int]]:
    """Undominated fillings around ``largest``, the least waste first, then large lengths and many copies first.

    ``sums[i]`` has a bit for each sum of the i smallest lengths, so no branch
    is a dead end. A filling is dominated if a piece left over fits into its
    waste, in place of a smaller piece, or in place of two that aren't larger.
    """
    room = capacity - largest
    free = {n: counts[n] - (n == largest) for n in range(1, min(largest, room) + 1) if counts[n] > (n == largest)}
    rising = sorted(free)
    sums, mask = [1], (1 << (room + 1)) - 1
    for n in rising:
        bits, left, take = sums[-1], min(free[n], room // n), 1
        while left:
            take = min(take, left)
            bits |= bits << (take * n) & mask
            left, take = left - take, take * 2
        sums.append(bits)

    def exact(at: int, total: int, used: dict[int, int]) -> Iterator[dict[int, int]]:
        if not total:
            yield used
            return
        at = min(at, bisect_right(rising, total))
        while at and sums[at] >> total & 1:
            at -= 1
            n = rising[at]
            for times in range(min(total // n, free[n]), 0, -1):
                if sums[at] >> (total - n * times) & 1:
                    yield from exact(at, total - n * times, used | {n: times})

    def dominated(used: dict[int, int], waste: int) -> bool:
        over = [n for n in rising if free[n] > used.get(n, 0)]
        within = lambda low: (i := bisect_left(over, low)) < len(over) and over[i]
        for x, c in used.items():
            if (a := within(x + 1)) and a <= x + waste:
                return True
            if any((a := within(x + y)) and a <= x + y + waste for y in used if y < x or (y == x and c > 1)):
                return True
        return bool(over) and over[0] <= waste

    for waste in range(room + 1):
        if sums[-1] >> (room - waste) & 1:
            for used in exact(len(rising), room - waste, {}):
                if not dominated(used, waste):
                    yield used | {largest: used.get(largest, 0) + 1}


def fewest(counts: list[int], capacity: int) -> int:
    """A lower bound on sequences: pieces above half the capacity have one each, and smaller ones of at least k need what those leave over."""
    n = np.arange(capacity + 1)
    many, total = np.cumsum(counts), np.cumsum(n * np.array(counts, np.int64))
    half = capacity // 2
    k = np.arange(half + 1)
    large = many[capacity - k] - many[half]
    spare = large * capacity - (total[capacity - k] - total[half])
    small = total[half] - np.where(k > 0, total[k - 1], 0)
    return int((many[capacity] - many[capacity - k] + large + np.maximum(0, -((spare - small) // capacity))).max())


def best_fit(counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The best-fit decreasing packing, bins alike at once."""
    open_bins: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: dict[int, int], bins: int) -> None:
        if room not in open_bins:
            insort(rooms, room)
        open_bins.setdefault(room, []).append((pattern, bins))

    for n in range(capacity, 0, -1):
        left = counts[n]
        while left:
            at = bisect_left(rooms, n)
            room = rooms[at] if at < len(rooms) else capacity
            pattern, bins = open_bins[room].pop() if at < len(rooms) else ({}, left)
            if at < len(rooms) and not open_bins[room]:
                del open_bins[room], rooms[at]
            each = min(room // n, left)
            took = min(bins, left // each)
            put(room - n * each, pattern | {n: each}, took)
            if pattern and bins > took:
                put(room, pattern, bins - took)
            left -= each * took
    return [x for group in open_bins.values() for x in group]


def packed(histogram: dict[int, int], capacity: int = 2048, nodes: int | None = 2000) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often each is used; together they use up the histogram.

    The first descent takes the least-waste filling as often as it goes; it or
    the best-fit packing is the incumbent. Unless that meets the lower bound,
    the search goes back from its end over the other undominated fillings and
    fewer copies of each, and cuts what the bound of the rest can't bring below
    the incumbent. It ends when it has met the bound or seen all, which proves
    the packing, or after ``nodes`` branches.
    """
    nodes = float("inf") if nodes is None else nodes
    counts = [0] * (capacity + 1)
    for n, c in histogram.items():
        counts[n] = c
    least, fit = fewest(counts, capacity), best_fit(counts, capacity)
    path, largest = [], capacity
    while largest := next((n for n in range(largest, 0, -1) if counts[n]), 0):
        pattern = completion(counts, largest, capacity, nodes)
        path.append((pattern, min(counts[n] // c for n, c in pattern.items())))
        _use(counts, *path[-1])
    used = sum(times for _, times in path)
    bins, best = min((used, path), (sum(times for _, times in fit), fit), key=lambda x: x[0])
    path = list(path)

    def branches(skip: int) -> Iterator[tuple[dict[int, int], int]]:
        """Choices for the next bins; counts are as here whenever this goes on."""
        largest = next(n for n in range(capacity, 0, -1) if counts[n])
        for pattern in completions(list(counts), largest, capacity):
            for times in range(min(counts[n] // c for n, c in pattern.items()), 0, -1):
                if skip:
                    skip -= 1
                else:
                    yield pattern, times

    # Levels of the first descent get their branches when the search comes back to them.
    levels: list[Iterator[tuple[dict[int, int], int]] | None] = [None] * len(path)
    left = nodes
    while levels and bins > least and left > 0:
        if len(path) == len(levels):
            pattern, times = path.pop()
            _use(counts, pattern, -times)
            used -= times
        levels[-1] = levels[-1] or branches(1)
        choice = next(levels[-1], None)
        if choice is None:
            levels.pop()
            continue
        left -= 1
        _use(counts, *choice)
        path.append(choice)
        used += choice[1]
        if used + fewest(counts, capacity) >= bins:
            continue
        if any(counts):
            levels.append(branches(0))
        else:
            bins, best = used, list(path)
    return best


def _use(counts: list[int], pattern: dict[int, int], times: int) -> None:
    for n, c in pattern.items():
        counts[n] -= c * times


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length: (first rank, pieces of this length in a bin, first sequence, offset) in rising rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for pattern, times in patterns:
        offset = 0
        for n in sorted(pattern, reverse=True):
            c = pattern[n]
            out.setdefault(n, []).append((ranks.get(n, 0), c, first, offset))
            ranks[n] = ranks.get(n, 0) + c * times
            offset += n * c
        first += times
    return out


def _place(table: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                rows = order[a:b]
                n = int(length[rows[0]])
                slot = table[n][np.searchsorted(table[n][:, 0], rank[rows], side="right") - 1]
                within = rank[rows] - slot[:, 0]
                sequence[rows] = slot[:, 2] + within // slot[:, 1]
                offset[rows] = slot[:, 3] + within % slot[:, 1] * n
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer: str | None = None, nodes: int | None = 2000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    with small_batches(docs.sparkSession):
        rows = materialize(pieces(docs, id_col, text_col, capacity, tokenizer), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    shards = F.from_json(F.lit(str([math.isqrt(histogram.get(n, 0)) + 1 for n in range(capacity + 1)])), "array<int>")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.get(shards, F.col("length").cast("int"))).cast("int"))
    sums = rows.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n"))
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    table = {n: np.array(v, np.int64) for n, v in slots(packed(histogram, capacity, nodes)).items()}
    rank = F.row_number().over(W.partitionBy("length", "shard").orderBy("doc_id", "piece")) - 1
    ranked = rows.withColumn("rank", rank).join(base, ["length", "shard"]).withColumn("rank", (F.col("rank") + F.col("base")).cast("long"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(tidy(_place(table), "chunks"), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
