"""Exact duplicates, with frequent digests split off from the shuffle.

A Misra-Gries summary per partition finds digests that may be frequent. Their
groups are then counted exactly and the winners, at most ``counters`` rows, are
broadcast, so the rows of a hot group meet their winner without moving. All
other digests are grouped by an ordinary shuffle with map-side aggregation.

``exact_dedup`` drops the losers of frequent digests in the map task, and joins
the rest against ids and digests of losers only, so texts move only if these are
too many to broadcast.

Defined cases: a null text is the empty text. Rows without an id take part and
win only if no row of their group with as long a text has an id. Of rows that tie in
id and length, the one with the smallest hash of its text stays, and of rows that
repeat both id and text any one, but only one.
A very long text is hashed in its own task. An empty table gives an empty result. Extra columns are carried by
``exact_dedup``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BLANKS, fresh, materialize, maybe_broadcast, text_of, tidy


def digest_of(text: Column) -> Column:
    """SHA-256 of the text without blanks, as bytes."""
    return F.unhex(F.sha2(F.translate(text, BLANKS, ""), 256))


def _summary(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[bytes, int] = {}
        for batch in batches:
            for pair in pc.value_counts(batch.column(0)):
                key = pair["values"].as_py()
                low[key] = low.get(key, 0) + pair["counts"].as_py()
            if len(low) > counters:
                cut = sorted(low.values(), reverse=True)[counters]
                low = {k: v - cut for k, v in low.items() if v > cut}
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.binary()), pa.array(list(low.values()), pa.int64())], names=["digest", "low"])

    return run


def frequent(rows: DataFrame, counters: int) -> DataFrame:
    """Digests that may hold ``2 / counters`` of the rows or more: none of those is missed, and at most ``counters`` rows return.

    The summaries' counts are lower bounds that add up to the row count at
    most, so no more than ``counters`` digests can reach the floor.
    """
    floor = max(2, rows.count() // counters)
    parts = rows.select("digest").mapInArrow(tidy(_summary(counters)), "digest binary, low long")
    return parts.groupBy("digest").agg(F.sum("low").alias("low")).filter(F.col("low") >= floor).select("digest")


#: Losers of infrequent digests that ``exact_dedup`` broadcasts at most; more are joined by a shuffle.
LOSERS = 100_000


def _decided(docs: DataFrame, id_col: str, text_col: str, counters: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of frequent digests and of the others (doc_id, n_chars, hash, digest, row, best, group_size), and the winners of the frequent ones."""
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].alias("doc_id"), F.length(text).alias("n_chars"), F.xxhash64(text).alias("hash"), digest_of(text).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "digests")
    hot = materialize(frequent(rows, counters), "frequent")
    best = F.min(F.struct((-F.col("n_chars")).alias("short"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id"), "hash", "row")).alias("best")
    size = F.count(F.lit(1)).alias("group_size")
    winners = materialize(rows.join(F.broadcast(hot), "digest", "left_semi").groupBy("digest").agg(best, size), "winners")
    rest = rows.join(F.broadcast(winners), "digest", "left_anti")
    return rows.join(F.broadcast(winners), "digest"), rest.join(rest.groupBy("digest").agg(best, size), "digest"), winners


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chars, digest."""
    stay, moved, _ = _decided(docs, id_col, text_col, counters)
    return stay.unionByName(moved).select(
        "doc_id",
        F.col("best.keep_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("n_chars").cast("long").alias("n_chars"),
        "digest",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 256) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns."""
    _, moved, winners = _decided(docs, id_col, text_col, counters)
    key, chars, hashed, d, i, n, h, best, once = (fresh(docs, c) for c in ("key_digest", "key_chars", "key_hash", "of_digest", "of_id", "of_chars", "of_hash", "of_best", "of_once"))
    text = text_of(docs, text_col)
    rows = docs.withColumns({key: digest_of(text), chars: F.length(text), hashed: F.xxhash64(text)})
    won = winners.select(F.col("digest").alias(d), F.col("best").alias(best))
    rows = rows.join(F.broadcast(won), rows[key] == won[d], "left")
    is_best = (F.col(chars) == -F.col(best)["short"]) & F.col(id_col).eqNullSafe(F.col(best)["keep_id"]) & (F.col(hashed) == F.col(best)["hash"])
    frequent_rows = rows.filter(F.col(best).isNotNull() & is_best).dropDuplicates([key]).drop(d, best)
    rows = rows.filter(F.col(best).isNull()).drop(d, best)

    wins = (F.col("n_chars") == -F.col("best.short")) & F.col("doc_id").eqNullSafe(F.col("best.keep_id")) & (F.col("hash") == F.col("best.hash"))
    odd = moved.filter("group_size > 1").groupBy("digest", "doc_id", "n_chars", "hash").agg(F.max(wins).alias("wins"), F.count(F.lit(1)).alias("times")).filter("NOT wins OR times > 1")
    odd = materialize(odd.select(F.col("digest").alias(d), F.col("doc_id").alias(i), F.col("n_chars").alias(n), F.col("hash").alias(h), F.col("wins").alias(once)), "odd")
    on = (rows[key] == odd[d]) & rows[id_col].eqNullSafe(odd[i]) & (rows[chars] == odd[n]) & (rows[hashed] == odd[h])
    rows = rows.join(maybe_broadcast(odd, odd.count(), LOSERS), on, "left").drop(d, i, n, h)
    alone = rows.filter(F.col(once).isNull())
    repeats = rows.filter(F.col(once)).dropDuplicates([key])
    return alone.unionByName(repeats).drop(once).unionByName(frequent_rows).drop(key, chars, hashed)
