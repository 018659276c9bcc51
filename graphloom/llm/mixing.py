"""Mixing sources to target weights, along a curriculum that varies with time.

Every source has a weight, which fixes how many words the mix takes from it,
and a schedule, a piecewise-linear intensity over training time 0..1. The words
of a source form a stream: its documents in the order of a hash of their id,
epoch after epoch. The integral of the schedule, scaled to 1, is the share of
that stream that has been demanded by time t; inverting it turns the place of a
document in the stream into its training position, epoch by epoch, so each copy
has its own. Copies are then range-sorted by position.

No more than one document of a source is taken in part. Running sums use hash
shards, so a hot source is spread over many tasks.

Defined cases: a null or blank text has size 0, and none of it is taken, so its
position is null. A null source is a source of its own and sorts last. A null id hashes like
the empty string. Rows that repeat an id are separate documents, ordered by
size. A very long text only counts by its size. Extra columns are carried by ``mix``, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import WORD, fresh, materialize, maybe_broadcast, text_of

#: Weights by place in the order of the sources, repeating.
WEIGHTS = (1, 2, 3)
#: Intensities at equally spaced knots over 0..1, one schedule for each weight: fading, steady, growing.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
MAX_EPOCHS = 3


def integrated(schedule: tuple[float, ...]) -> list[tuple[float, ...]]:
    """Segments (t0, width, w0, slope, d0, d1, total) of a schedule; d is the integral up to the knot, as a share of the total."""
    width = 1.0 / (len(schedule) - 1)
    areas = [(a + b) / 2 * width for a, b in zip(schedule, schedule[1:], strict=False)]
    total, done, out = sum(areas), 0.0, []
    for i, area in enumerate(areas):
        out.append((i * width, width, schedule[i], (schedule[i + 1] - schedule[i]) / width, done / total, (done + area) / total, total))
        done += area
    return out


def inverted(share: Column, schedules: tuple[tuple[float, ...], ...], which: Column) -> Column:
    """The time at which the integral of schedule number ``which`` reaches ``share`` of its total."""
    at = F.lit(None).cast("double")
    for n, schedule in enumerate(schedules):
        for t0, width, w0, slope, d0, d1, total in reversed(integrated(schedule)):
            area = (share - F.lit(d0)) * F.lit(total)
            step = area / F.lit(w0) if slope == 0 else (F.sqrt(F.greatest(F.lit(w0 * w0) + area * F.lit(2 * slope), F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
            last = d1 >= 1.0 - 1e-12
            at = F.when((which == n) & (share >= d0) & (F.lit(True) if last else share < d1), F.lit(t0) + step).otherwise(at)
    return F.when(at > 1, F.lit(1.0)).otherwise(at)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """source, source_size, rank, target: the share by weight, water-filled under ``max_epochs`` times each source's size.

    Sources in rising order of cap over weight fill up first: a source is full
    if its cap is within its share of what the full ones before it leave over.
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    big = "decimal(38,0)"
    per = per.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumns({"weight": weight.cast("long"), "cap": F.col("source_size") * max_epochs})
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank").asc())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    per = per.withColumns({"left": left, "rivals": F.sum("weight").over(after)})
    full = F.col("cap").cast(big) * F.col("rivals") <= F.col("weight").cast(big) * F.col("left")
    per = per.withColumn("full", full)
    spare = F.sum("source_size").over(every) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * spare.cast("double") / open_weight)
    return per.withColumn("target", target).select("source", "source_size", "rank", "target")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, schedules: tuple[tuple[float, ...], ...] = SCHEDULES, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per row of ``docs``, range-sorted: doc_id, source, size, source_size, target, taken, position, positions.

    ``positions`` has one of each copy, the part of a copy included, between 0
    and 1 and rising; ``position`` is the first. A source has about as many shards
    as the largest one has documents in a shard; results don't depend on it.
    """
    size = F.regexp_count(text_of(docs, text_col), F.lit(WORD)).cast("long")
    place = F.md5(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary"))
    sizes = materialize(docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), size.alias("size"), place.alias("place")), "sizes")
    digits = 1
    most = sizes.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    while 16 ** (2 * digits) < most:
        digits += 1
    targets = materialize(source_targets(sizes, weights, max_epochs), "targets")
    n = targets.count()
    t = maybe_broadcast(targets.withColumnRenamed("source", "source_"), n, 100_000)
    rows = sizes.join(t, sizes["source"].eqNullSafe(t["source_"])).drop("source_").withColumn("shard", F.substring("place", 1, digits))
    sums = rows.groupBy("rank", "shard").agg(F.sum("size").alias("words"))
    base = sums.withColumn("base", F.coalesce(F.sum("words").over(W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("words")
    rows = rows.join(maybe_broadcast(base, n * 16**digits, 100_000), ["rank", "shard"])
    inside = W.partitionBy("rank", "shard").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("epochs", F.floor(ratio))
    rows = rows.withColumn("part", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size"))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("before")))
    rows = rows.withColumn("taken", (F.col("epochs") * F.col("size") + extra).cast("long"))
    some = (F.col("taken") > 0) & (F.col("target") > 0)
    which = F.col("rank") % len(schedules)

    def at(epoch: Column) -> Column:
        part = F.least(F.col("size"), F.col("taken") - epoch * F.col("size"))
        middle = (epoch * F.col("source_size") + F.col("before") + part / 2) / F.col("target")
        return inverted(F.least(middle, F.lit(1.0)), schedules, which)

    copies = F.ceil(F.col("taken") / F.when(some, F.col("size")))
    rows = rows.withColumn("positions", F.when(some, F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), at)).otherwise(F.array().cast("array<double>")))
    rows = rows.withColumn("position", F.get("positions", 0))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "position", "positions").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: each document as often as the mix takes it, range-sorted by the position of each copy.

    Copies are whole: a document that is taken in part stays if at least half
    of it is taken. Documents of size 0 hold no words to weigh and stay once, after the others.
    """
    plan = plan_mix(docs, id_col, text_col, source_col, **options)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    here, place, i, s, z, n = (fresh(docs, c) for c in ("words_here", "place_here", "plan_id", "plan_source", "plan_size", "plan_copies"))
    plan = plan.groupBy(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(z)).agg(F.max(F.struct(copies.alias("n"), F.col("positions").alias("at"))).alias(n))
    sized = docs.withColumn(here, F.regexp_count(text_of(docs, text_col), F.lit(WORD)).cast("long"))
    on = sized[id_col].eqNullSafe(plan[i]) & sized[source_col].eqNullSafe(plan[s]) & (sized[here] == plan[z])
    out = sized.join(plan, on).withColumn(place, F.explode(F.when(F.col(z) == 0, F.array(F.lit(None).cast("double"))).otherwise(F.slice(F.col(n)["at"], F.lit(1), F.col(n)["n"]))))
    return out.orderBy(out[place].asc_nulls_last(), out[id_col]).select(*docs.columns)
