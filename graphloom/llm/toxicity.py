"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel compares words by their three-letter subsequences with gaps: each
occurrence counts ``DECAY`` to the power of its span, up to span ``SPAN``, and a
word's sums are divided by a norm that follows from its length, which leaves the
kernel positive. Characters are folded first: accents and letter forms go, digits and
signs that stand for letters become them, letters of other scripts are one class,
other signs inside a word go, invisible ones too, and runs of single letters are
one word. So inserted signs disappear and inserted letters only cost a gap.

The SVM is trained on labelled texts, a text being a bag of words: its decision
is that of its worst word, and the hinge loss is on the text's label. A clean
text asks all of its words to be negative; a toxic one asks its witnesses to be
positive. These are its words with pieces that toxic texts have more often than chance
gives, each of them, so that an insult is learned beside others too; or else its worst
word. Training alternates: given witnesses it solves the SVM in the feature space of
the Nyström landmarks, then every toxic text without a telling word chooses its worst
one anew, until none changes. Witnesses are also shown with letters
inserted. Clean words enter as they come near the margin. All of this is numpy on the driver, on a sample.
A rising curve, the shares of toxic texts in a quarter of the sample, turns the worst
word of a text into its score.

As the decision is linear in the kernel, landmarks and weights multiply out
into one weight for each of the 32,768 subsequences. Tasks receive that table:
the same decision, at a cost that doesn't depend on the number of landmarks.
A very long text is scored in pieces, cut between two words of two letters or more.

Defined cases: null and empty texts get the score of a text without words.
Without labels of both classes every score is 0. Rows with a null id are held
out. Repeated labels of an id count as toxic if any is; of rows that repeat an id, the smallest text is learned from. Rows are scored one by
one, so repeated rows score alike. An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held_out, text_of, tidy

DECAY = 0.7
SPAN = 4
LANDMARKS = 192
#: Weight of the hinge loss of a text, or of a clean word, against the norm.
COST = 20.0
#: Turns of choosing witnesses, at most.
ROUNDS = 8
#: Variants of a witness with letters inserted.
VARIANTS = 8
BLOCK = 1 << 20
#: Offsets of the second and third letter from the first.
GAPS = [(a, b) for a in range(1, SPAN) for b in range(a + 1, SPAN + 1)]
#: Class of letters that no Latin letter stands behind.
_OTHER = 27
_GONE, _BETWEEN = 255, " qq "
_CUT = re.compile(r"[A-Za-z]{2}[\x20\x09-\x0D]+(?=[A-Za-z]{2})")


def _folded(point: int) -> int:
    """Class of a code point: 1 to 26 for letters, 0 for a blank, ``_GONE`` for what is left out."""
    char = chr(point)
    kind = unicodedata.category(char)
    if char in " \t\n\x0b\x0c\r" or kind == "Zs":
        return 0
    c = unicodedata.normalize("NFKD", char)[0].lower()[0]
    c = {"ß": "s", "æ": "a", "ð": "d", "ø": "o", "þ": "t"}.get(c, c)
    c = dict(zip("013457@$", "oieastas", strict=True)).get(c, c)
    if "a" <= c <= "z":
        return ord(c) - 96
    return _OTHER if kind[0] == "L" else _GONE


#: Classes of the first two planes' code points; further ones are left out.
_FOLD = np.full(0x20000, _GONE, np.uint8)
for _point in [*range(0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800)]:
    _FOLD[_point] = _folded(_point)


def letters(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of the letters with one blank around each word, where each word's first blank is, and the place of its first letter.

    ``text`` starts and ends with a blank.
    """
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    c = _FOLD[np.minimum(points, len(_FOLD) - 1)]
    at = np.flatnonzero(c != _GONE)
    c = c[at]
    blank = c == 0
    keep = ~(blank & np.concatenate(([False], blank[:-1])))
    c, at = c[keep], at[keep]
    gaps = np.flatnonzero(c == 0)
    single = np.diff(gaps) == 2
    keep = np.ones(len(c), bool)
    keep[gaps[1:-1][single[:-1] & single[1:]]] = False
    c, at = c[keep], at[keep]
    starts = np.flatnonzero(c == 0)[:-1]
    return c, starts, at[starts + 1]


def _pieces(text: str, size: int) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut where no run of single letters is parted."""
    at = 0
    while at < len(text):
        found = _CUT.search(text, at + size) if len(text) > at + size else None
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end


def _scale(length: np.ndarray) -> np.ndarray:
    """Square root of a word's kernel with itself, by its length with both blanks, repeated subsequences counted apart."""
    own = sum(np.maximum(length - b, 0) * DECAY ** (2 * b) for _, b in GAPS)
    return np.sqrt(np.maximum(own, DECAY**4))


def word_sums(c: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each word the sum of ``table`` over its gapped subsequences, normalised. A blank ends one word and starts the next."""
    n = len(c)
    if not len(starts):
        return np.zeros(0, np.float32)
    size = np.diff(starts, append=n - 1)
    blank = c == 0
    opens = np.cumsum(blank, dtype=np.int32)
    closes = opens - blank
    low = c.astype(np.int32)
    high, middle = low << 10, low << 5
    total = np.zeros(n, np.float32)
    for a, b in GAPS:
        if n > b:
            seen = table.take(high[:-b] + middle[a : n - b + a] + low[b:])
            total[:-b] += seen * (np.float32(DECAY**b) * (opens[:-b] == closes[b:]))
    total[-1] = 0
    return np.add.reduceat(total, starts) / _scale(size + 1).astype(np.float32)


def subsequences(word: bytes) -> tuple[list[int], list[float]]:
    """Codes and normalised weights of the subsequences of a word of letter classes, its blanks included."""
    codes, weights = [], []
    word = b"\0" + word + b"\0"
    scale = float(_scale(np.array([len(word)]))[0])
    for a, b in GAPS:
        for i in range(len(word) - b):
            codes.append((word[i] << 10) + (word[i + a] << 5) + word[i + b])
            weights.append(DECAY**b / scale)
    return codes, weights


@dataclass
class Model:
    table: np.ndarray  # a weight for each subsequence
    at: np.ndarray  # worst words, rising, and the scores at them
    share: np.ndarray
    floor: float  # the worst word of a text without words

    def scores(self, texts: list[str], size: int = BLOCK) -> np.ndarray:
        """Scores of texts, in blocks of about ``size`` characters."""
        worst = np.full(len(texts), self.floor)
        block, owners, held = [], [], 0
        for i, text in enumerate(texts):
            for piece in _pieces(text, size):
                block.append(piece)
                owners.append(i)
                held += len(piece)
                if held >= size:
                    self._block(block, owners, worst)
                    block, owners, held = [], [], 0
        if block:
            self._block(block, owners, worst)
        return np.interp(worst, self.at, self.share)

    def _block(self, pieces: list[str], owners: list[int], worst: np.ndarray) -> None:
        ends = np.cumsum([len(t) + len(_BETWEEN) for t in pieces]) + 1
        c, starts, at = letters(" " + _BETWEEN.join(pieces) + _BETWEEN)
        owner = np.array(owners)[np.minimum(np.searchsorted(ends, at, side="right"), len(pieces) - 1)]
        np.maximum.at(worst, owner, word_sums(c, starts, self.table))


def words_of(text: str) -> set[bytes]:
    c, _, _ = letters(" " + text + " ")
    return {w for w in c.tobytes().split(b"\0") if w}


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, seed: int) -> list[dict]:
    """At most ``per_class`` toxic and twice as many clean labelled texts: toxic, rank, text. None is held out."""
    known = labels.select(labels[id_col].alias("id_"), labels[label_col].cast("int").alias("toxic"), held_out(labels[id_col]).alias("out"))
    known = known.filter("NOT out AND toxic IS NOT NULL").groupBy("id_").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("rank", F.pmod(F.xxhash64(F.col("id_").cast("string"), F.lit(seed)), F.lit(1 << 30)))
    chosen = known.filter("toxic = 1").orderBy("rank", "id_").limit(per_class).unionByName(known.filter("toxic = 0").orderBy("rank", "id_").limit(2 * per_class))
    source = docs.select(docs[id_col].alias("id_"), text_of(docs, text_col).alias("text"))
    rows = source.join(F.broadcast(chosen), "id_")  # 3 * per_class ids
    rows = rows.groupBy("id_", "toxic", "rank").agg(F.min("text").alias("text")).select("toxic", "rank", "text").toArrow().to_pylist()  # a row for each of them
    return sorted(rows, key=lambda r: (r["rank"], r["toxic"], r["text"]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 800, seed: int = 5) -> Model | None:
    rows = sample(docs, labels, id_col, text_col, label_col, per_class, seed)
    return fitted(rows, seed) if {r["toxic"] for r in rows} >= {0, 1} else None


def _variants(word: bytes, rng: np.random.Generator) -> list[bytes]:
    """The word with a letter inserted, and with two each fourth time."""
    out = []
    for n in [1, 1, 1, 2] * (VARIANTS // 4):
        grown = list(word)
        for _ in range(n):
            grown.insert(int(rng.integers(1, len(grown))), int(rng.integers(1, 27)))
        out.append(bytes(grown))
    return out


def _grams(word: bytes) -> set[bytes]:
    """Pieces of five letters, blanks included, that tell where to start looking for the worst word."""
    word = b"\0" + word + b"\0"
    return {word[i : i + 5] for i in range(max(1, len(word) - 4))}


def _features(words: list[bytes], dense: np.ndarray) -> np.ndarray:
    """Kernel of each word with each landmark; ``dense`` holds the landmarks' subsequences, one in a column."""
    out = np.zeros((len(words), dense.shape[1]), np.float32)
    for i, word in enumerate(words):
        codes, weights = subsequences(word)
        out[i] = np.array(weights, np.float32) @ dense[codes]
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, passes: int = 30) -> tuple[np.ndarray, float]:
    """The SVM with squared hinge loss, by Newton steps on the rows inside the margin until these stay the same."""
    x = np.column_stack((x, np.ones(len(x))))
    w, inside = np.zeros(x.shape[1]), np.ones(len(x), bool)
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(passes):
        held = x[inside] * cost[inside, None]
        target = np.linalg.solve(ridge + held.T @ x[inside], held.T @ y[inside])
        w = w + (target - w) * (1.0 if _ < 4 else 0.5)
        now = y * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w[:-1], float(w[-1])


def fitted(rows: list[dict], seed: int) -> Model:
    rng = np.random.default_rng(seed)
    docs = [(r["toxic"], r["rank"] % 4 == 0, words_of(r["text"])) for r in rows]
    learn = [d for d in docs if not d[1]] if {d[0] for d in docs if not d[1]} >= {0, 1} else docs
    check = [d for d in docs if d[1]]
    check = check if {d[0] for d in check} >= {0, 1} else docs
    toxic = _distinct([d[2] for d in learn if d[0]])  # copies would make any of their words tell
    clean = Counter(w for d in learn if not d[0] for w in d[2])
    seen = Counter(w for words in toxic for w in words)
    telling = sorted((w for w in seen if not clean[w]), key=lambda w: (-seen[w], w))
    plain = sorted(clean)
    marks = telling[:LANDMARKS] + [plain[i] for i in rng.choice(len(plain), min(LANDMARKS, len(plain)), replace=False)] if plain else telling[:LANDMARKS]
    dense = np.zeros((1 << 15, len(marks)), np.float32)
    for j, word in enumerate(marks):
        codes, weights = subsequences(word)
        np.add.at(dense[:, j], codes, np.array(weights, np.float32))
    values, vectors = np.linalg.eigh(_features(marks, dense).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])

    negative = [plain[i] for i in rng.choice(len(plain), min(12_000, len(plain)), replace=False)] if plain else []
    first = _worst_words(toxic, Counter(g for d in learn if not d[0] for g in {g for w in d[2] for g in _grams(w)})) - set(clean)
    bags = [found for words in toxic if (found := sorted(w for w in words if len(w) > 2))]
    # All telling words of a toxic text are witnesses; one without any waits until there is a decision to choose by.
    known = [sorted(first & set(bag)) for bag in bags]
    witness = known
    shown: dict[bytes, list[bytes]] = {}
    table, bias = np.zeros(1 << 15, np.float32), 0.0
    for _ in range(ROUNDS):
        texts = Counter(w for found in witness for w in found)
        if not texts or not negative:
            break
        for w in sorted(texts):
            if w not in shown:
                shown[w] = _variants(w, rng)
        grown = [(v, texts[w]) for w in sorted(texts) for v in shown[w]]
        x = [*sorted(texts), *(v for v, _ in grown), *negative]
        # A word counts once for each of its texts, and a witness's variants as much together.
        cost = [COST * texts[w] for w in sorted(texts)] + [COST * n / VARIANTS for _, n in grown] + [COST * clean[w] for w in negative]
        y = np.repeat([1.0, -1.0], [len(x) - len(negative), len(negative)])
        w, bias = _svm((_features(x, dense) @ root).astype(np.float64), y, np.array(cost))
        table = (dense @ (root @ w)).astype(np.float32)
        near = _sums(plain, table) + bias
        hard = [plain[i] for i in np.argsort(-near)[:4000] if near[i] > -1]
        chosen = [told or [bag[int(np.argmax(_sums(bag, table)))]] for bag, told in zip(bags, known, strict=True)]
        settled = chosen == witness and set(hard) <= set(negative)
        witness, negative = chosen, sorted({*negative, *hard})
        if settled:
            break
    top = np.array([max(_sums(sorted(d[2]), table).max(initial=-1.0), -1.0) + bias for d in check])
    at, share = _curve(top, np.array([d[0] for d in check]))
    return Model(table, at - bias, share, -1.0)


def _sums(words: list[bytes], table: np.ndarray) -> np.ndarray:
    whole = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
    return word_sums(whole, np.flatnonzero(whole == 0)[:-1], table) if words else np.zeros(0, np.float32)


def _distinct(texts: list[set[bytes]]) -> list[set[bytes]]:
    """The texts without near copies: of those that share four of eight minima of their words' hashes, the first."""
    kept, known = [], Counter()
    for words in texts:
        minima = [(k, min(zlib.crc32(w, 0x9E37 * (k + 1)) for w in words)) for k in range(8)] if words else []
        if sum(m in known for m in minima) < 4:
            kept.append(words)
            known.update(minima)
    return kept


def _worst_words(toxic: list[set[bytes]], tame: Counter) -> set[bytes]:
    """Words that explain toxic texts, no two of them copies: those with a piece that hardly a clean text has (``tame``) and more toxic ones than chance would give.

    With twice as many clean texts, a neutral piece of n texts is in toxic ones
    alone with a chance of 3 ** -n, so n follows from how many pieces there are.
    """
    pieces = [{g for w in words for g in _grams(w)} for words in toxic]
    held = Counter(g for found in pieces for g in found)
    need = 3
    while need < len(toxic) and sum(3.0**-n for n in held.values() if n >= need) > 1:
        need += 1
    telling = {g for g, n in held.items() if n >= need and tame[g] <= 0.1 * n}
    words: dict[bytes, Counter] = {}
    for text in toxic:
        for w in text:
            for g in _grams(w) & telling:
                words.setdefault(g, Counter())[w] += 1
    return {w for g in words for w, _ in sorted(words[g].items(), key=lambda x: (-x[1], x[0]))[:25]}


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decisions and shares of toxic texts at them, rising: neighbours are pooled until none is out of order.

    Some labels have other reasons than words, so no logistic curve fits: it would be flattened for all.
    """
    blocks: list[list[float]] = []  # first and last decision, toxic texts, texts
    for value in np.unique(x):
        here = x == value
        blocks.append([float(value), float(value), float((y[here] == 1).sum()), float(here.sum())])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, end, toxic, texts = blocks.pop()
            blocks[-1] = [blocks[-1][0], end, blocks[-1][2] + toxic, blocks[-1][3] + texts]
    # Most are toxic from the margin on, 1, whichever the check's first toxic text behind its last clean one is.
    at, end = [], -np.inf
    for first, last, toxic, texts in blocks:
        if 2 * toxic > texts and not any(2 * b[2] > b[3] for b in blocks if b[1] < first):
            first = min(max(end, 1.0), last)
        at.append((first, last))
        end = last
    share = np.maximum.accumulate([(toxic + 0.5) / (texts + 1) for _, _, toxic, texts in blocks])
    return np.concatenate(at), np.repeat(share, 2)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 32,768 weights
    source = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), text_of(docs, text_col).alias("text"))
    schema = source.drop("text").schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = shared.value.scores(texts) if shared.value else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= cut).astype(np.int32))], names=schema.names)

    return source.mapInArrow(tidy(run), schema)
