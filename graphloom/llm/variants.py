"""Spelling variants: words at distance one, by a trie self-join with active-node sets.

Distance one is exactly one inserted, deleted or replaced code point. The
vocabulary trie is cut into subtries that tasks join on their own. Of two words
at distance one, let m be the length of the shorter one and h = m // 2. Either
the edit lies behind the first h code points, then both words are in the subtrie
of that prefix; or it lies within them, then both share their last m - h code points
and meet in a subtrie of the mirrored kind, whose root is a suffix. A word
therefore goes to four subtries: of two lengths m and of two kinds. Only a
subtrie of more than ``leaf`` words is halved again by the same rule on what is
left between the fixed ends, so a prefix that a third of the vocabulary has
spreads over ever longer prefixes, and what can't be halved is bounded by the
alphabet. Sizes come from counts; every word stays in.

Inside a subtrie the active-node set of a node, all trie nodes within distance
one of it, is derived from its parent's on the way down; a terminal node and a
terminal node in its set are a pair. A node with one word below it ends the
descent: its rest is searched below each active node.

Defined cases: a null text has no words; a null id is the empty string in the
hash that deletes code points; rows that repeat an id count each. Only A-Z are
folded. Words don't depend on other columns, whatever their names. A very long
text is read by its own task; a very long word is a word. An empty table gives
no rows. Of near words with equal counts the first in code-point order wins.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, maybe_broadcast, small_batches, text_of, tidy

#: Code points and occurrences that make a run a word, at least.
CHARS, TIMES = 6, 5
#: A word's form has so many times its occurrences, at least.
FACTOR = 5
#: Of so many runs, one loses a code point.
DELETES = 199
#: Words of a subtrie that one task joins at once; larger ones are halved.
LEAF = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", deletes: int = DELETES, chars: int = CHARS) -> DataFrame:
    """word: one row for each run of letters that has ``chars`` code points after folding and deletion."""
    runs = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id_"), F.explode(F.regexp_extract_all(text_of(docs, text_col), F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{chars},}})"), F.lit(1))).alias("run"))
    runs = runs.select("id_", F.translate("run", UPPER, LOWER).alias("run")).withColumn("h", F.crc32(F.concat("id_", F.lit(":"), "run").cast("binary")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % deletes == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= chars)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES) -> DataFrame:
    """word, n of the words that occur ``times`` times or more."""
    return occurrences(docs, id_col, text_col).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= times)


class SubTrie:
    """The trie over sorted distinct words; a node is (first word, end, depth), a range of words that share ``depth`` code points."""

    def __init__(self, words: list[str]):
        self.words, self.known = words, {}

    def children(self, node: tuple[int, int, int]) -> dict[str, tuple[int, int, int]]:
        found = self.known.get(node)
        if found is None:
            at, end, depth = node
            found = {}
            if len(self.words[at]) == depth:
                at += 1
            while at < end:
                c = self.words[at][depth]
                to = at + 1
                while to < end and self.words[to][depth] == c:
                    to += 1
                found[c] = (at, to, depth + 1)
                at = to
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[node] = found
        return found

    def is_word(self, node: tuple[int, int, int]) -> bool:
        return len(self.words[node[0]]) == node[2]

    def below(self, node: tuple[int, int, int], rest: str) -> int:
        """The word of ``node`` that goes on with ``rest``, or -1."""
        first, end, depth = node
        wanted = self.words[first][:depth] + rest
        at = bisect_left(self.words, wanted, first, end)
        return at if at < end and self.words[at] == wanted else -1

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Places of words at distance one, the smaller first."""
        if len(self.words) < 2:
            return
        root = (0, len(self.words), 0)
        stack = [(root, set(self.children(root).values()))]
        while stack:
            node, active = stack.pop()
            first, end, depth = node
            if end - first == 1:
                rest = self.words[first][depth:]
                for other in active:
                    at = self.below(other, rest)
                    if at > first:
                        yield first, at
                continue
            if self.is_word(node):
                for other in active:
                    if other[0] > first and self.is_word(other):
                        yield first, other[0]
                    elif other[0] < first and self.is_word(other):
                        yield other[0], first
            own = self.children(node)
            for c, child in own.items():
                near = {node, *self.children(child).values()}  # c deleted, or another one inserted behind it
                near.update(x for k, x in own.items() if k != c)  # replaced
                near.update(x for other in active if (x := self.children(other).get(c)) is not None)  # edited before, equal since
                stack.append((child, near))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of near words in sorted runs of (key, middle, n); key is m, a, b, head and tail."""

    def ended(key: str, middles: list[str], counts: list[int]) -> list[tuple]:
        m, a, b, head, tail = key.split(" ")
        least = int(m) - int(a) - int(b)
        found = {p for p in SubTrie(middles).pairs() if min(len(middles[p[0]]), len(middles[p[1]])) == least}
        return [(head + middles[i] + tail, counts[i], head + middles[j] + tail, counts[j]) for x, y in found for i, j in ((x, y), (y, x))]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[k for k, _ in kinds])

    now, middles, counts, out = None, [], [], []
    for part in batches:
        for key, middle, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if key != now:
                if len(middles) > 1:
                    out += ended(now, middles, counts)
                    if len(out) > 10_000:
                        yield batch(out)
                        out = []
                now, middles, counts = key, [], []
            middles.append(middle)
            counts.append(n)
    if len(middles) > 1:
        out += ended(now, middles, counts)
    yield batch(out)


def subtries(words: DataFrame, leaf: int = LEAF) -> DataFrame:
    """word, n, m, a, b: each word in each subtrie it belongs to, whose words share the first a and the last b code points."""

    def key() -> list[Column]:
        return ["m", "a", "b", F.col("word").substr(F.lit(1), F.col("a")).alias("head"), F.col("word").substr(F.length("word") - F.col("b") + 1, F.col("b")).alias("tail")]

    def halved(rows: DataFrame) -> DataFrame:
        left = F.col("m") - F.col("a") - F.col("b")
        half = F.floor(left / 2).cast("int")
        ways = F.array(F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("b") + left - half).alias("b")))
        return rows.select("word", "n", "m", F.explode(F.array_distinct(ways)).alias("way")).select("word", "n", "m", "way.a", "way.b")

    lengths = F.array(F.length("word"), F.length("word") - 1)
    done, rows = None, halved(words.select("word", "n", F.explode(lengths).alias("m")).select("word", "n", "m", F.lit(0).alias("a"), F.lit(0).alias("b")))
    while True:
        rows = materialize(rows.select("word", "n", *key()), "subtries")
        large = rows.groupBy("m", "a", "b", "head", "tail").agg(F.count(F.lit(1)).alias("words")).filter((F.col("words") > leaf) & (F.col("m") - F.col("a") - F.col("b") > 1))
        large = materialize(large.drop("words"), "large")
        many = large.count()
        stay = rows.join(maybe_broadcast(large, many, 100_000), ["m", "a", "b", "head", "tail"], "left_anti") if many else rows
        done = stay if done is None else done.unionByName(stay)
        if not many:
            return done
        rows = halved(rows.join(maybe_broadcast(large, many, 100_000), ["m", "a", "b", "head", "tail"], "left_semi"))


def near_words(words: DataFrame, leaf: int = LEAF) -> DataFrame:
    """word, n, near, near_n: both directions of each pair of ``words`` (word, n) at distance one, once."""
    middle = F.col("word").substr(F.col("a") + 1, F.length("word") - F.col("a") - F.col("b"))
    rows = subtries(words, leaf).select(F.concat_ws(" ", F.col("m").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"), "head", "tail").alias("key"), middle.alias("middle"), "n")
    rows = rows.repartition("key").sortWithinPartitions("key", "middle")
    return rows.mapInArrow(tidy(_joined), "word string, n long, near string, near_n long").distinct()


def variants(words: DataFrame, factor: int = FACTOR, leaf: int = LEAF) -> DataFrame:
    """word, n, n_near, form, form_n, root for ``words`` (word, n).

    Each form has ``factor`` times the occurrences of its word, so chains are as short as a logarithm
    of the largest count; their ends are found by doubling.
    """
    words = materialize(words, "words")
    best = F.min(F.when(F.col("near_n") >= factor * F.col("n"), F.struct((-F.col("near_n")).alias("short"), F.col("near").alias("form")))).alias("best")
    near = near_words(words, leaf).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.short")).alias("form_n"))
    rows = materialize(rows, "forms")
    steps = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        steps = materialize(steps, "roots")
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if steps.join(onward, "root", "left_semi").isEmpty():
            break
        steps = steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return rows.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``docs``."""
    with small_batches(docs.sparkSession, 10_000):
        return variants(vocabulary(docs, id_col, text_col)).select("word", "form", "root", "n", "n_near", "form_n")
