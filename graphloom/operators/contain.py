"""Which strings contain which: an inverted index of q-grams instead of a nested loop.

A string that contains another contains all its q-grams. A needle of up to ``most``
characters is a gram itself, so hays that have it are those that contain it. A longer one
is looked up by one of its grams, the one that fewest haystacks have, and what is
found is verified; grams of haystacks leave their task for it only if some needle has them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.naming import tokens
from .graph import keep

#: Needles, or grams of them, that are broadcast at most; more are joined by a shuffle.
GRAMS = 200_000
#: Hays that are cut into words at once.
ROWS = 1000
#: Characters of the grams between names: few names are longer, so nearly all are looked up whole. Shorter grams meet more names the more there are.
WHOLE = 16


def _grams(text: Column, size: Column) -> Column:
    """The distinct substrings of ``size`` code points; a long text is cut into code points once, as finding the nth one in it takes n steps."""
    starts = lambda n: F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    of = lambda points: F.transform(starts(F.size(points)), lambda i: F.array_join(F.slice(points, i, size), ""))
    cut = F.flatten(F.transform(F.array(F.split(text, "")), of))
    return F.array_distinct(F.when(F.length(text) <= 64, F.transform(starts(F.length(text)), lambda i: F.substring(text, i, size))).otherwise(cut))


def containing(needles: DataFrame, hays: DataFrame, most: int = 3) -> DataFrame:
    """All columns of ``needles`` (needle, ...) and ``hays`` (hay, ...): one row for each two rows whose hay contains the needle.

    Null and empty needles are contained in nothing. Comparison is case-sensitive. Column names must differ.
    """
    needles, hays = needles.filter("needle <> ''"), hays.filter("hay <> ''")
    counted = needles.groupBy(F.least(F.length("needle"), F.lit(most + 1)).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    rows = {r["size"]: r["n"] for r in counted.collect()}  # ``most`` numbers and one
    columns = ["needle", *hays.columns, *(c for c in needles.columns if c != "needle")]
    if not rows:
        return needles.limit(0).join(hays.limit(0), F.lit(True)).select(columns)

    def known(listed: DataFrame, many: int) -> DataFrame:
        return F.broadcast(listed) if many <= GRAMS else listed

    def held(sizes: list[int]) -> DataFrame:
        return hays.withColumn("gram", F.explode(F.flatten(F.array(*[_grams(F.col("hay"), F.lit(k)) for k in sorted(sizes)]))))

    out, whole = None, {k: n for k, n in rows.items() if k <= most}
    if whole:
        short = needles.filter(F.length("needle") <= most).withColumn("gram", F.col("needle"))
        out = held(list(whole)).join(known(short, sum(whole.values())), "gram").select(columns)
    if most + 1 in rows:
        own = keep(needles.filter(F.length("needle") > most).select("needle").distinct().withColumn("gram", F.explode(_grams(F.col("needle"), F.lit(most)))))
        wanted = keep(own.select("gram").distinct())
        counts = keep(held([most]).join(known(wanted, wanted.count()), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
        rarest = own.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
        keys = keep(rarest.filter("best.n > 0").select("needle", "best.gram"))
        far = held([most]).join(known(keys, keys.count()), "gram").filter(F.col("hay").contains(F.col("needle"))).drop("gram").join(needles, "needle").select(columns)
        out = far if out is None else out.unionByName(far)
    return out


def _hashes(codes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A number for the ``size`` codes from each start on; equal runs have equal numbers."""
    out = np.full(len(starts), size, np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[starts + j].astype(np.uint64)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _with_runs(hays: DataFrame, words: list[str], runs: dict[int, list[int]]) -> DataFrame:
    """The ``hays`` (hay, ...) that have one of the ``runs`` (hashes by size, of places in ``words``), and run, those of each."""
    columns = hays.columns

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, known = pa.array(words, pa.string()), {k: np.array(v, np.int64) for k, v in runs.items()}
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            parts = pc.split_pattern(pc.fill_null(batch.column(columns.index("hay")).cast(pa.string()), ""), " ")
            codes = pc.fill_null(pc.index_in(parts.flatten(), value_set=listed), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
            unknown, pairs = np.concatenate([[0], np.cumsum(codes < 0)]), []
            for size, wanted in known.items():
                ends = np.arange(size, len(codes) + 1)
                starts = np.flatnonzero((unknown[ends] == unknown[ends - size]) & (of[ends - 1] == of[ends - size]))
                found = _hashes(codes, starts, size)
                hit = np.isin(found, wanted)
                pairs.append(np.stack([of[starts[hit]], found[hit]]))
            pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
            rows, first = np.unique(pairs[0], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, pairs.shape[1]).astype(np.int32)), pa.array(pairs[1], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows, pa.int64())).columns, lists], [*columns, "run"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hays.schema)
    return hays.mapInArrow(held, f"{schema}, run array<long>")


def containing_passages(needles: DataFrame, hays: DataFrame, most: int = 6) -> DataFrame:
    """As ``containing``, for needles of several words in long hays.

    Words that have a blank on both sides in a needle are whole words, in the same order, of every hay that contains it. So a needle is
    looked up by the hash of ``most`` such words in a row, those that fewest hays have, and hays by their words instead of
    their characters. Hays are read once, in Arrow batches, and those that have such words of some needle are written.
    Needles of less than three words go by their grams, and so do all if they have more than ``GRAMS`` words.
    """
    needles, hays = needles.filter("needle <> ''"), hays.filter("hay <> ''")
    distinct = needles.select("needle").distinct().withColumn("inner", F.split("needle", " "))
    distinct = keep(distinct.withColumn("inner", F.slice("inner", 2, F.greatest(F.size("inner") - 2, F.lit(0)))))
    total = distinct.agg(F.sum(F.size("inner")).alias("n")).first()["n"] or 0
    if not 0 < total <= GRAMS:
        return containing(needles, hays)
    short = distinct.filter("size(inner) = 0").select("needle")
    few = containing(needles.join(short, "needle", "left_semi"), hays) if not short.isEmpty() else None
    asked = [(r["needle"], r["inner"]) for r in distinct.filter("size(inner) > 0").collect()]  # ``total`` words
    words = sorted({w for _, inner in asked for w in inner})
    place, own, runs = {w: i for i, w in enumerate(words)}, [], {}
    for needle, inner in asked:
        size = min(len(inner), most)
        found = set(_hashes(np.array([place[w] for w in inner]), np.arange(len(inner) - size + 1), size).tolist())
        own += [(needle, run) for run in found]
        runs.setdefault(size, set()).update(found)
    held = keep(_with_runs(hays, words, {k: sorted(v) for k, v in runs.items()})).withColumn("run", F.explode("run"))
    counts = held.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    listed = needles.sparkSession.createDataFrame(own, "needle string, run long")
    rarest = listed.join(counts, "run").groupBy("needle").agg(F.min(F.struct("n", "run")).alias("best"))
    keys = keep(rarest.select("needle", "best.run"))  # a row for each needle of ``asked``
    found = held.join(F.broadcast(keys), "run").filter(F.col("hay").contains(F.col("needle"))).drop("run").join(needles, "needle")
    return found if few is None else found.unionByName(few)


def _first(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The first ``limit`` names of each key by (ord, name)."""
    return rows.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("ord", "name"))).filter(F.col("r") <= limit).drop("r")


#: A word that so many logs have is frequent. So many frequent words bring their names by a broadcast.
FREQUENT, FREQUENT_WORDS = 100_000, 1000


def anchors(logs: DataFrame, entries: DataFrame, limit: int = 10) -> DataFrame:
    """log, name: the first ``limit`` entries (name, namespace, ord) that a log (log, text) points to.

    A word of four letters or more points to a name that it contains, to a name that contains it, and to the names of a namespace that contains it.
    Since only the first names of a log count, each word keeps its first ones only, and brings them to its logs as one row.
    """
    text = F.array_distinct(F.regexp_extract_all("text", F.lit("[a-zA-Z0-9_:]{4,}"), F.lit(0)))  # the pattern of a split is compiled for every row
    words = logs.select("log", F.explode(text).alias("w"))
    distinct = keep(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    names = keep(entries.filter("name <> ''").groupBy("name").agg(F.min("ord").alias("ord")))
    spaces = keep(_first(entries.filter("namespace <> '' AND name <> ''").select("namespace", "name", "ord").distinct(), "namespace", limit))
    found = containing(distinct.select(F.col("w").alias("needle")), names.withColumnRenamed("name", "hay"), WHOLE).select(F.col("needle").alias("w"), F.col("hay").alias("name"), "ord")
    inside = containing(names.withColumnRenamed("name", "needle"), distinct.select(F.col("w").alias("hay")), WHOLE).select(F.col("hay").alias("w"), F.col("needle").alias("name"), "ord")
    spaced = containing(distinct.select(F.col("w").alias("needle")), spaces.select(F.col("namespace").alias("hay")).distinct(), WHOLE)
    spaced = spaced.join(spaces, spaced["hay"] == spaces["namespace"]).select(F.col("needle").alias("w"), "name", "ord").distinct()
    hit = _first(found.unionByName(inside).unionByName(spaced), "w", 3 * limit).distinct()  # each of the three has a row once at most
    hit = keep(_first(hit, "w", limit).groupBy("w").agg(F.sort_array(F.collect_list(F.struct("ord", "name"))).alias("names")))
    frequent = keep(distinct.filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "w").limit(FREQUENT_WORDS).select("w"))
    named = words.join(F.broadcast(frequent), "w", "left_anti").join(hit, "w")
    named = named.unionByName(words.join(F.broadcast(keep(hit.join(F.broadcast(frequent), "w", "left_semi"))), "w"))
    once = lambda found: F.filter(found, lambda x, i: ~x.eqNullSafe(F.get(found, i - 1)))
    firsts = F.slice(F.flatten(F.transform(F.array(F.sort_array(F.flatten(F.collect_list("names")))), once)), 1, limit)
    return named.groupBy("log").agg(firsts.alias("names")).select("log", F.explode("names.name").alias("name"))


def entry_tokens(name: Column, namespace: Column, responsibility: Column, interfaces: Column, targets: Column) -> Column:
    """Distinct tokens that an entry is found by; dependencies count as they are, in lower case."""
    text = lambda c: tokens(F.coalesce(c, F.lit("")))
    none = F.array().cast("array<string>")
    said = F.flatten(F.transform(F.coalesce(interfaces, none), lambda i: text(i)))
    used = F.filter(F.transform(F.coalesce(targets, none), lambda t: F.lower(t)), lambda t: t != "")
    return F.array_distinct(F.concat(text(name), text(namespace), text(responsibility), said, used))


def relevant(queries: DataFrame, entries: DataFrame, limit: int = 20) -> DataFrame:
    """query, name, score, rank: the best ``limit`` entries (name, ord, tokens) of each query (query, text).

    The score is the share of the query's tokens that contain a token of the entry or are contained in one. Ties go by ``ord``, then name.
    """
    asked = keep(queries.select("query", F.explode(tokens(F.col("text"))).alias("q")))
    sizes = asked.groupBy("query").agg(F.count(F.lit(1)).alias("size"))
    held = keep(entries.select("name", "ord", F.explode("tokens").alias("t")))
    qs, ts = keep(asked.select("q").distinct()), keep(held.select("t").distinct())
    within = containing(qs.withColumnRenamed("q", "needle"), ts.withColumnRenamed("t", "hay"), WHOLE).select(F.col("needle").alias("q"), F.col("hay").alias("t"))
    around = containing(ts.withColumnRenamed("t", "needle"), qs.withColumnRenamed("q", "hay"), WHOLE).select(F.col("hay").alias("q"), F.col("needle").alias("t"))
    hit = held.join(within.unionByName(around).distinct(), "t").select("name", "ord", "q").distinct()
    scored = asked.join(hit, "q").groupBy("query", "name", "ord").agg(F.count(F.lit(1)).alias("n")).join(sizes, "query")
    scored = scored.select("query", "name", "ord", (F.col("n") / F.col("size")).alias("score"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "ord", "name"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query", "name", "score", "rank")
