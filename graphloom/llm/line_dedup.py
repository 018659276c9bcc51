"""Repeated three-line windows across all documents.

Each window of three consecutive lines gets two 64-bit hashes. Windows that
occur more than once are found by a grouped minimum with map-side
aggregation; every occurrence but the first, in the order of document id and
position, covers its three lines. Covered positions merge: the lines between the
end of one window and the start of the next one stay, so a document takes time
in proportion to its lines. Windows of very many occurrences meet their first one by a broadcast,
without moving. Built-in functions only.

Defined cases: a null text has no lines and stays null. Texts of fewer than
three lines have no windows and stay. Rows that repeat an id and a text count as one
document. A null id sorts after all others. A very long text is one array of lines in its task. An empty table gives an empty result. Extra columns are
carried by ``line_dedup``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, materialize, maybe_broadcast

WINDOW = 3
#: Occurrences from which a window is joined by a broadcast; such windows are fewer than all occurrences divided by this.
HOT = 100_000


def _windows(lines: DataFrame) -> DataFrame:
    """``lines`` (doc_id, text_hash, lines) with a row for each window: at, h1, h2. Every line is hashed once, and windows hash line hashes."""
    hashed = lines.select("doc_id", "text_hash", F.transform("lines", lambda x: F.xxhash64(x)).alias("a"), F.transform("lines", lambda x: F.xxhash64(F.lit(7), x)).alias("b"))
    rows = hashed.filter(F.size("a") >= WINDOW).select("doc_id", "text_hash", "b", "a", F.explode(F.sequence(F.lit(1), F.size("a") - (WINDOW - 1))).alias("at"))
    part = lambda c: F.xxhash64(*[F.get(F.col(c), F.col("at") + (k - 1)) for k in range(WINDOW)])
    return rows.select("doc_id", "text_hash", "at", part("a").alias("h1"), part("b").alias("h2"))


def repeated(docs: DataFrame, id_col: str, text_col: str, hot: int = HOT) -> DataFrame:
    """doc_id, text_hash, starts: where windows to remove begin, in order, for documents that have any."""
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.split(text, "\n", -1).alias("lines"))
    found = materialize(_windows(rows), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "at")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("times")).filter("first <> last")
    first = materialize(first.select("h1", "h2", "first", "times"), "repeated")
    many = first.filter(F.col("times") >= hot)
    n = many.count()
    later = found.join(first.drop("times"), ["h1", "h2"])
    if n:
        many = maybe_broadcast(many.drop("times"), n, 500_000)
        rest = first.filter(F.col("times") < hot).drop("times")
        later = found.join(many, ["h1", "h2"]).unionByName(found.join(many, ["h1", "h2"], "left_anti").join(rest, ["h1", "h2"]))
    return later.filter(place != F.col("first")).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("at")).alias("starts"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its texts cut, and two columns more: n_lines, n_removed (named afresh if taken)."""
    n_lines, n_removed = fresh(docs, "n_lines"), fresh(docs, "n_removed")
    key, mark_id, mark_hash, starts, split, stay = (fresh(docs, c) for c in ("text_hash_", "mark_id_", "mark_hash_", "starts_", "lines_", "stay_"))
    marks = repeated(docs, id_col, text_col).select(F.col("doc_id").alias(mark_id), F.col("text_hash").alias(mark_hash), F.col("starts").alias(starts))
    keyed = docs.withColumn(key, F.xxhash64(docs[text_col].cast("string")))
    joined = keyed.join(marks, keyed[id_col].eqNullSafe(marks[mark_id]) & (keyed[key] == marks[mark_hash]), "left")
    text = joined[text_col].cast("string")
    joined = joined.withColumn(split, F.when(F.col(starts).isNotNull(), F.split(text, "\n", -1)))

    def between(i):
        """The lines from the end of window i - 1 up to the start of window i, counted from 0."""
        begin = F.when(i == 0, 1).otherwise(F.get(F.col(starts), i - 1) + WINDOW)
        end = F.coalesce(F.get(F.col(starts), i), F.size(split) + 1)
        return F.slice(F.col(split), begin, F.greatest(end - begin, F.lit(0)))

    joined = joined.withColumn(stay, F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts)), between)))
    whole = F.when(F.col(starts).isNull(), text).otherwise(F.array_join(stay, "\n"))
    size = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1)))
    gone = F.when(F.col(starts).isNull(), 0).otherwise(F.size(split) - F.size(stay))
    out = [whole.alias(c) if c == text_col else joined[c] for c in docs.columns]
    return joined.select(*out, size.cast("long").alias(n_lines), gone.cast("long").alias(n_removed))
