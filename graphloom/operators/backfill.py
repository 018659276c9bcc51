"""Bodies that are defined outside their class go to the declarations that lack one.

Bodies come in order. Each takes the first free declaration of its class with its
very signature, or else the first free one that declares its name; public
declarations stand before private ones. One that finds none is left over. A body
may so take what a later one would match exactly, hence a fold over the bodies of a
class in order: a column expression, one row per class, as large as the class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def owners(bodies: DataFrame, classes: DataFrame) -> DataFrame:
    """``bodies`` (class, ...) with ``owner``: the class of that very name, or else the one named by its last part; others go."""
    known = classes.select(F.col("class").alias("owner")).distinct()
    exact = bodies.join(known, bodies["class"] == known["owner"], "left")
    rest = exact.filter("owner IS NULL").drop("owner").withColumn("owner", F.element_at(F.split("class", "::"), -1))
    return exact.filter("owner IS NOT NULL").unionByName(rest.join(known, "owner", "left_semi"))


def backfill(methods: DataFrame, bodies: DataFrame) -> DataFrame:
    """class, signature, place, body: each of ``methods`` (class, signature, place, filled) with the body that it gets, or null.

    ``bodies``: class, body, ord, name, signature; bodies without steps aren't listed. ``place`` orders declarations, public first.
    """
    classes = methods.select("class").distinct()
    todo = owners(bodies, classes).groupBy(F.col("owner").alias("class")).agg(F.sort_array(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), "body", "name", "signature"))).alias("bodies"))
    slots = methods.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("place", "signature", "filled"))).alias("slots"))
    start = F.transform("slots", lambda s: F.struct(s["signature"].alias("signature"), s["place"].alias("place"), s["filled"].alias("filled"), F.lit(None).cast("string").alias("body")))

    def placed(state, body):
        free = lambda ok: F.filter(F.transform(state, lambda s, i: F.when(~s["filled"] & ok(s["signature"]), i)), lambda i: i.isNotNull())
        exact = free(lambda sig: sig == body["signature"])
        quoted = F.concat(F.lit(r"\b\Q"), body["name"], F.lit(r"\E\s*\("))
        named = free(lambda sig: F.regexp_like(sig, quoted) & (body["name"] != ""))
        at = F.coalesce(F.get(exact, 0), F.get(named, 0))
        return F.transform(state, lambda s, i: F.when(i == at, F.struct(s["signature"].alias("signature"), s["place"].alias("place"), F.lit(True).alias("filled"), body["body"].alias("body"))).otherwise(s))

    joined = slots.join(todo, "class", "left").select("class", F.explode(F.aggregate(F.coalesce("bodies", F.expr("CAST(array() AS array<struct<ord:bigint,body:string,name:string,signature:string>>)")), start, placed)).alias("s"))
    return joined.select("class", "s.signature", "s.place", "s.body")
