"""Quality rules: counts of each text, and a hashed n-gram likelihood ratio against a trusted target.

N-grams are three code points long, over the words of a text with one space
before, between and behind them, so they see spelling, signs, case and spacing
in any language. Each is hashed into one of ``BUCKETS``. Two multinomials are
counted: the target over all trusted rows, the raw one over all documents. A
bucket's weight is the logarithm of their ratio, with one more in each bucket,
in whole thousandths. A document's verdict is the mean weight of its n-grams against
``THRESHOLD``: integers only, so sums don't depend on their order and reruns
agree on every document.

Counting and scoring are one pass over the texts each. Tasks add up buckets and
send at most ``BUCKETS`` rows; the weights, as many numbers, are broadcast.

Defined cases: a null, empty or blank text has no words, and fails the base
rules as it has fewer than 20. Rows that repeat are counted and judged each. A
null id is trusted by no label; rows that repeat a trusted id are all trusted,
and a label that repeats counts once. Without trusted rows every
weight is 0 and the base rules decide. A very long text is read in pieces by
its own task. An empty table gives an empty result. Other columns are kept by
``keep_good``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, maybe_broadcast, small_batches, text_of, tidy
from ._shingles import CASED, pieces, spread_windows, word_hashes

#: Buckets of n-grams.
BUCKETS = 1 << 16
#: Thousandths of a nat that a kept document has in the mean, at least.
THRESHOLD = -300
#: The multiplier and the modulus of the n-gram hash.
MULTIPLIER, MODULUS = 1_000_003, 2_147_483_647
#: Words of a window, words of a text at least, and the percentage of words in repeated windows at most.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Trusted ids that are broadcast at most; more are joined by a shuffle.
TRUSTED = 500_000
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def n_grams(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text in UTF-8, piece by piece."""
    carried = np.zeros(0, np.int64)
    for part in pieces(text):
        words = b" ".join(part.split())
        if words:
            x = np.concatenate((carried, np.frombuffer((b" " + words).decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)))
            yield _hashed(x)
            carried = x[-2:]
    if len(carried):
        yield _hashed(np.append(carried, 32))


def _hashed(x: np.ndarray) -> np.ndarray:
    return ((x[:-2] * MULTIPLIER + x[1:-1]) * MULTIPLIER + x[2:]) % MODULUS % BUCKETS


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = symbols = 0
    for part in pieces(text):
        b = np.frombuffer(part, np.uint8)
        chars += int(((b & 0xC0 != 0x80) & ~_BLANK[b]).sum())
        symbols += int(_SYMBOL[b].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    hashes = word_hashes(text, CASED)
    return len(hashes), chars, symbols, len(lines) - len(set(lines)), repeated_words(hashes)


def repeated_words(hashes: np.ndarray) -> int:
    """Words in windows that the text has twice or more."""
    if len(hashes) <= WINDOW:
        return 0
    windows = spread_windows(hashes, WINDOW)
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(again)
    edge[at] += 1
    edge[at + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, trusted in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
            for found in n_grams(text.as_py()):
                counts = np.bincount(found, minlength=BUCKETS)
                raw += counts
                if trusted:
                    target += counts
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def train(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The weight of each bucket; ``trusted`` lists ids of trusted rows in its first column."""
    ids = trusted.select(F.col(trusted.columns[0]).alias("id_")).filter("id_ IS NOT NULL").distinct().withColumn("trusted", F.lit(True))
    rows = docs.select(docs[id_col].alias("id_"), text_of(docs, text_col).alias("text")).join(maybe_broadcast(ids, ids.count(), TRUSTED), "id_", "left")
    with small_batches(docs.sparkSession):
        counted = rows.select("text", F.coalesce("trusted", F.lit(False))).mapInArrow(tidy(_counted), "bucket long, raw long, target long")
        found = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # so many rows as buckets, at most
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    raw[found["bucket"]], target[found["bucket"]] = found["raw"], found["target"]
    if not target.sum():
        return np.zeros(BUCKETS, np.int64)
    ratio = ((target + 1) / (target.sum() + BUCKETS)) / ((raw + 1) / (raw.sum() + BUCKETS))
    return np.round(1000 * np.log(ratio)).astype(np.int64)


_JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_grams long, ratio_sum long"


def verdict(text: bytes, weights: np.ndarray, threshold: int) -> tuple:
    counts = base_counts(text)
    grams = total = 0
    for found in n_grams(text):
        grams += len(found)
        total += int(weights[found].sum())
    failed = counts[0] < LEAST_WORDS or 100 * counts[4] > MOST_REPEATED * counts[0]
    return (*counts, failed, not failed and total >= threshold * grams, grams, total)


def _judged(weights: Broadcast, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [verdict(text.as_py(), weights.value, threshold) for text in batch.column(1).cast(pa.binary())]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[x.split()[0] for x in _JUDGED.split(", ")])

    return run


def judge(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, the five counts, base_failed, kept, n_grams, ratio_sum."""
    spread = docs.sparkSession.sparkContext.broadcast(weights)
    with small_batches(docs.sparkSession):
        return docs.select(docs[id_col].cast("long"), text_of(docs, text_col)).mapInArrow(tidy(_judged(spread, threshold)), _JUDGED)


def keep_good(docs: DataFrame, weights: np.ndarray, text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    spread, flag = docs.sparkSession.sparkContext.broadcast(weights), fresh(docs, "is_good")

    @F.pandas_udf("boolean")
    def good(texts):
        return texts.map(lambda x: bool(verdict(x.encode("utf-8", "replace"), spread.value, threshold)[6]))

    return docs.withColumn(flag, good(text_of(docs, text_col))).filter(F.col(flag)).drop(flag)
