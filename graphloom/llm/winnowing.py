"""Document fingerprints by winnowing, with built-in functions only.

The grams are runs of ``GRAM`` words (blanks separate words); a text of fewer
words has one gram, all of it. Gram hashes roll by doubling: the hash of two
neighbouring runs follows from theirs. Of every ``WINDOW`` consecutive grams
the smallest hash is chosen, the rightmost of equal ones, and kept once with
its position. So two texts with a common run of ``WINDOW + GRAM - 1`` words
share a fingerprint, and the positions say where.

To choose, the front half of a hash and its position counted down share a 64-bit number, so
the minimum of numbers is the minimum hash with rightmost
ties, and window minima too follow by doubling. What is kept of the chosen grams is the whole
64-bit hash, looked up by position.

The next document is found without one global sort: approximate quantiles of
the ids cut them into buckets, each bucket also gets the first document of the
bucket before it, and neighbours are found inside buckets. Past ``BUCKETS`` of them
all buckets grow alike, and a window over one spills.

Defined cases: a null text is the empty text; its fingerprint is empty. Two empty fingerprints have
likeness 1, an empty and another one 0. Rows with a null id come last in the
order of ids, ties follow the text. A very long text is an array of words in its own task. A single document is its own next one. An empty table
gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import text_of

GRAM, WINDOW = 4, 8
_SPLIT = "[\\x20\\x09-\\x0D]+"
#: Positions are counted down from here; hashes take the bits above.
_TOP = (1 << 31) - 1
BUCKETS = 1 << 16
#: Cuts that are compared one by one to find a bucket.
_STEP = 256


def _neighbours(a: Column, step: int, join) -> Column:
    """Each element joined with the one ``step`` later; the last ``step`` elements have none."""
    return F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - step, F.lit(0))), F.slice(a, step + 1, F.greatest(F.size(a) - step, F.lit(0))), join)


def with_fingerprints(df: DataFrame, text_col: str, out_col: str, at_col: str) -> DataFrame:
    """``df`` with the hashes of the chosen grams and their positions, two arrays in order of position.

    Every step is a projection of its own, so an array is computed once.
    """
    kept = df.columns
    words = F.filter(F.split(F.col(text_col), _SPLIT, -1), lambda w: w != "")
    df = df.select(*kept, F.transform(words, lambda w: F.xxhash64(w)).alias("h_"))
    size = 1
    while size < GRAM:
        step = size
        rolled = _neighbours(F.col("h_"), step, lambda a, b: F.xxhash64(a, b))
        df = df.select(*kept, F.when(F.size("h_") > step, rolled).otherwise(F.when(F.size("h_") > 0, F.array(F.xxhash64(F.to_json(F.col("h_"))))).otherwise(F.col("h_"))).alias("h_"))
        size *= 2
    packed = F.transform("h_", lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 32), 31).bitwiseOR(F.lit(_TOP).cast("long") - i))
    df = df.select(*kept, F.col("h_").alias("g_"), packed.alias("h_"))
    size = 1
    while size < WINDOW:
        step = size
        low = _neighbours(F.col("h_"), step, lambda a, b: F.least(a, b))
        df = df.select(*kept, "g_", F.when(F.size("h_") > step, low).otherwise(F.when(F.size("h_") > 0, F.array(F.array_min("h_"))).otherwise(F.col("h_"))).alias("h_"))
        size *= 2
    at = F.transform(F.array_distinct("h_"), lambda x: (F.lit(_TOP) - x.bitwiseAND(_TOP)).cast("int"))
    df = df.select(*kept, "g_", at.alias(at_col))
    return df.select(*kept, F.transform(at_col, lambda i: F.get(F.col("g_"), i)).alias(out_col), at_col)


def shown(fingerprint: Column, at: Column) -> Column:
    """The fingerprint as text: hash in hexadecimal @ position, separated by blanks."""
    return F.array_join(F.zip_with(fingerprint, at, lambda x, i: F.concat(F.lower(F.hex(x)), F.lit("@"), i.cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes, each counted once."""
    both, total = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(both / F.greatest(total - both, F.lit(1)))


def cut_shares(rows: int, bucket_rows: int, most: int = BUCKETS) -> list[float]:
    """The quantiles that cut ``rows`` into equal buckets of about ``bucket_rows``; past ``most`` buckets, all of them grow alike."""
    buckets = min(rows // bucket_rows + 1, most)
    return [i / buckets for i in range(1, buckets)]


def _numbers(values: list[int | None], kind: str) -> Column:
    """A constant array, parsed once."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def with_next(rows: DataFrame, carried: list[str], bucket_rows: int = 4000) -> DataFrame:
    """``rows`` (doc_id, ...) with next_<column> of the next row in descending order of ids; after the last comes the first."""
    ids = rows.select("doc_id")
    shares = cut_shares(ids.count(), bucket_rows)
    cuts = sorted({int(c) for c in ids.approxQuantile("doc_id", shares, 0.1 * shares[0]) if c is not None}) if shares else []
    # Buckets count from 1; 0 is that of null ids. The tier is found first, then the place in it.
    every = _numbers(cuts, "long")
    tier = F.size(F.filter(_numbers(cuts[_STEP - 1 :: _STEP], "long"), lambda c: c <= F.col("doc_id")))
    bucket = F.col("tier") * _STEP + F.size(F.filter(F.slice(every, F.col("tier") * _STEP + 1, F.lit(_STEP)), lambda c: c <= F.col("doc_id"))) + 1
    placed = rows.withColumn("tier", F.when(F.col("doc_id").isNotNull(), tier)).withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(bucket)).drop("tier")
    # The first document of each bucket follows the last one of the next bucket that has rows.
    heads = sorted(((r["bucket"], r["head"]) for r in placed.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()), reverse=True)  # a row per bucket
    head, into = [None] * (len(cuts) + 2), [None] * (len(cuts) + 2)
    for i, (b, first) in enumerate(heads):
        head[b], into[b] = first, heads[i - 1][0]
    is_head = F.get(_numbers(head, "long"), F.col("bucket")).eqNullSafe(F.col("doc_id"))
    placed = placed.withColumn("into", F.when(is_head, F.get(_numbers(into, "int"), F.col("bucket"))))
    homes = F.array_compact(F.array(F.struct(F.col("bucket").alias("home"), F.lit(0).alias("guest")), F.when(F.col("into").isNotNull(), F.struct(F.col("into").alias("home"), F.lit(1).alias("guest")))))
    placed = placed.withColumn("at", F.explode(homes)).select(*rows.columns, "at.home", "at.guest")
    order = W.partitionBy("home").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    nexts = [F.lead(c).over(order).alias(f"next_{c}") for c in carried]
    return placed.select(*rows.columns, "guest", *nexts).filter("guest = 0").drop("guest")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint: one row per row of ``docs``."""
    rows = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text"))
    return with_fingerprints(rows, "text", "fp", "fp_at").select("doc_id", shown(F.col("fp"), F.col("fp_at")).alias("fingerprint"))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 4000) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The edited text has its last third replaced by the start of the next one.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    rows = with_next(with_fingerprints(rows, "text", "fp", "fp_at"), ["text", "fp"], bucket_rows)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), shown(F.col("fp"), F.col("fp_at")).alias("fingerprint"), F.array_distinct("fp").alias("own"), F.array_distinct("next_fp").alias("next"), edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "fingerprint", "own", likeness(F.col("own"), F.col("next")).alias("near_next"), "edited", F.sha2("edited", 256).alias("edited_sha256"))
    rows = with_fingerprints(rows, "edited", "edited_fp", "edited_at")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", shown(F.col("edited_fp"), F.col("edited_at")).alias("edited_fingerprint"), likeness(F.col("own"), F.array_distinct("edited_fp")).alias("near_edited"), "near_next")
