"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its subwords: the 3- and 4-byte pieces
of words, word ends included, hashed into ``BUCKETS`` rows. A linear softmax
maps the mean to languages. Both layers are trained together by stochastic
gradient descent in numpy on the driver, on a sample of at most ``per_lang``
documents of each language and two snippets of each. A temperature fitted on a
fifth of the sample calibrates the score, and a text is rejected if its score
is below ``MARGIN`` times the ``REJECT_RATE`` quantile of the correct ones there. Texts
of fewer than ``LONG`` bytes are held against the short snippets and texts
there, others against the longer ones.

At prediction, the layers are multiplied out into one table of ``BUCKETS``
times languages, which is what tasks receive: its size doesn't depend on the
corpus. Texts are read whole, long ones in overlapping blocks.

Defined cases: a null text, or one without a letter (Unicode category L, so superscripts and fractions are none), is ``und`` with score 0
and is rejected. Without labelled rows, every text is ``und`` with score 0, and none is rejected for its score. Rows with a null id
are held out. Repeated rows are predicted alike. An empty table gives an empty
result. Extra columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import give_back, held_out, text_of, tidy

BUCKETS = 1 << 15
WIDTH = 16
EPOCHS = 12
REJECT_RATE = 0.001
#: Room below that quantile for texts unlike the sample.
MARGIN = 0.85
LONG = 120
BLOCK = 1 << 20
_ASCII_LETTER = re.compile(rb"[A-Za-z]")

#: Bytes as subwords see them: letters in lower case, anything else in ASCII as the end of a word.
_FOLD = np.array([c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], np.uint32)


def subwords(text: bytes) -> Iterator[np.ndarray]:
    """Bucket numbers of the text's subwords, block by block."""
    for at in range(0, max(1, len(text) - 3), BLOCK):
        part = text[at : at + BLOCK + 3]
        if not at:
            part = b" " + part
        if at + BLOCK + 3 >= len(text):
            part += b" "
        b = _FOLD[np.frombuffer(part, np.uint8)]
        inner = b != 32
        h = b[:-2] * np.uint32(0x01000193) + b[1:-1] * np.uint32(0x9E3779B1) + b[2:] * np.uint32(0x85EBCA6B)
        yield (h[inner[1:-1]] * np.uint32(0xC2B2AE35)) >> np.uint32(17)
        h = h[:-1] * np.uint32(0x27D4EB2F) + b[3:]
        yield (h[inner[1:-2] & inner[2:-1]] * np.uint32(0xC2B2AE35)) >> np.uint32(17)


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The text's buckets and how often each is in it."""
    parts = [np.zeros(0, np.uint32), *subwords(text)]
    found, n = np.unique(np.concatenate(parts), return_counts=True)
    return found.astype(np.int16), n.astype(np.int32)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # a row of class scores for each bucket
    bias: np.ndarray
    temperature: float
    thresholds: tuple[float, float]  # of short texts and of others

    def accepts(self, score: float, size: int) -> bool:
        return score >= self.thresholds[size >= LONG]

    def score(self, text: bytes) -> tuple[str, float]:
        total, n = np.zeros(len(self.langs)), 0
        for found in subwords(text):
            total += self.table.take(found, axis=0).sum(axis=0, dtype=np.float64)
            n += len(found)
        z = (total / max(1, n) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode()))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bags of whole texts (part 0) and of two snippets of each, at places that follow from the text."""
    for batch in batches:
        rows = []
        for lang, rank, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            seed = zlib.crc32(text)
            places = [(0, len(text))]
            for k, size in enumerate((24, LONG)):
                start = (seed >> (8 * k)) % max(1, len(text) - size)
                start = text.find(b" ", start) + 1 if len(text) > size else 0
                places.append((start, start + size))
            for part, (a, b) in enumerate(places):
                piece = text[a:b] if part == 0 else text[a:b].rpartition(b" ")[0] or text[a:b]
                if has_letter(piece.decode(errors="ignore").encode()):
                    rows.append((lang, rank, part, part == 1 or len(text) < LONG, *bag(piece)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int16()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["lang", "rank", "part", "short", "found", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 500, seed: int = 1) -> Model | None:
    """A model fitted on at most ``per_lang`` documents of each language, none of them held out."""
    rank = F.pmod(F.xxhash64(docs[id_col].cast("string"), F.lit(seed)), F.lit(1 << 30))
    known = docs.select(docs[lang_col].cast("string").alias("lang"), rank.alias("rank"), docs[text_col].cast("string").alias("text"), held_out(docs[id_col]).alias("out"))
    known = known.filter("NOT out AND lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not counts:
        return None
    limit = F.lit(0)
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, int(min(1.0, 1.2 * per_lang / n) * (1 << 30))).otherwise(limit)
    sample = known.filter(F.col("rank") < limit).select("lang", "rank", "text")
    table = sample.mapInArrow(tidy(_bags), "lang string, rank long, part int, short boolean, found array<short>, n array<int>").toArrow()
    found, many = (_split(table.column(c)) for c in ("found", "n"))
    rows = [dict(zip(("lang", "rank", "part", "short", "found", "share"), (*r, n / max(1, n.sum())), strict=True)) for *r, n in zip(*(table.column(i).to_pylist() for i in range(4)), found, many, strict=True)]
    del table, many
    kept = {lang: set(sorted({r["rank"] for r in rows if r["lang"] == lang})[:per_lang]) for lang in counts}
    rows = sorted((r for r in rows if r["rank"] in kept[r["lang"]]), key=lambda r: (r["lang"], r["rank"], r["part"], len(r["found"])))
    model = fitted(rows, seed) if rows else None
    del rows, found
    give_back()  # the driver goes on with other stages
    return model


def _split(lists: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists as views of one array: as Python numbers they would take ten times the memory."""
    whole = lists.combine_chunks()
    if not len(whole):
        return []
    values, edges = whole.values.to_numpy(), whole.offsets.to_numpy()
    return [values[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def fitted(rows: list[dict], seed: int) -> Model:
    langs = sorted({r["lang"] for r in rows})
    bags = [(r["found"], r["share"], langs.index(r["lang"]), r["rank"] % 5 == 0, r["short"]) for r in rows]
    learn = [x for x in bags if not x[3]] or bags
    check = [x for x in bags if x[3]] or bags
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    out, bias = rng.normal(0, 0.1, (WIDTH, len(langs))), np.zeros(len(langs))
    for epoch in range(EPOCHS):
        rate = 0.5 * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(learn)):
            found, share, lang, *_ = learn[i]
            x = share @ embed[found]
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[lang] -= 1
            step = out @ p
            out -= rate * np.outer(x, p)
            bias -= 0.1 * rate * p
            embed[found] -= rate / (share @ share) * np.outer(share, step)
    table = (embed @ out).astype(np.float32)
    logits = np.array([share @ table[found] + bias for found, share, *_ in check])
    truth = np.array([lang for _, _, lang, *_ in check])
    loss = []
    grid = np.geomspace(0.25, 8, 31)
    for t in grid:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        loss.append(-(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(axis=1))).mean())
    t = float(grid[int(np.argmin(loss))])
    z = np.exp((logits - logits.max(axis=1, keepdims=True)) / t)
    top = z.max(axis=1) / z.sum(axis=1)
    right, short = logits.argmax(axis=1) == truth, np.array([x[4] for x in check])
    alike = [top[right & (short == s)] for s in (True, False)]
    short_level, long_level = (MARGIN * float(np.quantile(x, REJECT_RATE)) if len(x) else 0.0 for x in alike)
    return Model(langs, table, bias, t, (short_level, long_level))


def _labels(model: Model | None, texts: pa.Array) -> tuple[list[str], list[float], list[bool]]:
    langs, scores, kept = [], [], []
    for text in texts.cast(pa.binary()):
        text = text.as_py()
        named = bool(text) and has_letter(text)
        lang, score = model.score(text) if named and model else ("und", 0.0)
        langs.append(lang)
        scores.append(score)
        kept.append(named and (model is None or model.accepts(score, len(text))))
    return langs, scores, kept


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted: one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS times languages floats
    source = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), text_of(docs, text_col).alias("text"))
    schema = source.drop("text").schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, kept = _labels(shared.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())], names=schema.names)

    return source.mapInArrow(tidy(run), schema)


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't rejected, unchanged and without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_labels(shared.value, batch.column(at))[2], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
