"""Ordinary tables as graph data: nodes, typed edges, methods, call steps, documents, snapshots.

Operators take these shapes, so they run on a code index and on any table that
can be brought into them. Plans stay lazy; nothing here is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edge types by return flag.
EDGE_TYPES = {"A": "aggregation", "R": "composition", "N": "association"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, type, pos: suppliers depend on parts; pos is the first order line that says so."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_orderkey", "l_linenumber")
    kind = F.coalesce(*[F.when(F.col("l_returnflag") == k, v) for k, v in EDGE_TYPES.items()], F.lit("dependency"))
    rows = lines.select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), kind.alias("type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return rows.groupBy("src", "dst", "type").agg(F.min("pos").alias("pos"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, namespace, file, responsibility, ord: suppliers by region and nation, parts by type."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = s.select(F.concat(F.lit("S"), "s_suppkey").alias("name"), F.concat_ws("::", F.lower("r_name"), F.lower("n_name")).alias("namespace"), F.concat(F.lower("r_name"), F.lit("/"), F.lower("n_name"), F.lit("/"), "s_suppkey").alias("file"), F.when(F.col("s_acctbal") < 0, "Debtor").otherwise("Creditor").alias("responsibility"), F.col("s_suppkey").alias("ord"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("name"), F.lit("").alias("namespace"), F.concat(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")), F.lit("/"), "p_partkey").alias("file"), F.col("p_type").alias("responsibility"), (F.col("p_partkey") + 1_000_000_000).alias("ord"))
    return s.unionByName(p)


def layered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src depends on dst: region, nation, customer, order, part."""
    t = lambda name: table(spark, sf_dir, name)
    parts = [
        t("nation").select(F.concat(F.lit("R"), "n_regionkey").alias("src"), F.concat(F.lit("N"), "n_nationkey").alias("dst")),
        t("customer").select(F.concat(F.lit("N"), "c_nationkey").alias("src"), F.concat(F.lit("C"), "c_custkey").alias("dst")),
        t("orders").select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("O"), "o_orderkey").alias("dst")),
        t("lineitem").select(F.concat(F.lit("O"), "l_orderkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def call_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class, method, step, target, member, kind, is_write: a user's events in order."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    step = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    target = F.when(F.col("event_type") == "error", "_self_").otherwise(F.concat(F.lit("U"), (F.col("event_id") * 7 % 50).cast("string")))
    return e.select(F.concat(F.lit("U"), "user_id").alias("class"), F.lit("run").alias("method"), step.alias("step"), target.alias("target"), F.col("event_type").alias("member"), F.when(F.col("event_type").isin("view", "click", "error"), "call").otherwise("field").alias("kind"), (F.col("event_type") == "purchase").alias("is_write"))


def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, namespace, file, responsibility, ord: the classes of ``call_steps``, by region and nation of the customer with the user's number; called ones too."""
    users = table(spark, sf_dir, "events").select(F.explode(F.array("user_id", F.col("event_id") * 7 % 50)).alias("id")).distinct()
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = c.select(F.col("c_custkey").alias("id"), F.concat_ws("::", F.lower("r_name"), F.lower("n_name")).alias("namespace"), F.col("c_mktsegment").alias("responsibility"))
    none = F.lit("")
    return users.join(c, "id", "left").select(F.concat(F.lit("U"), "id").alias("name"), F.coalesce("namespace", none).alias("namespace"), none.alias("file"), F.coalesce("responsibility", none).alias("responsibility"), F.col("id").cast("long").alias("ord"))


def _assemblies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, z, brand, class of each part, spread over the tasks: a part becomes many rows, but the table is a small file that one task reads."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")).alias("brand")).repartition("k")
    short = F.concat(F.lit("P"), "k")
    return p.withColumn("class", F.when(F.col("z") % 11 == 0, short).otherwise(F.concat_ws("::", "brand", short)))


def assembly_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class, file, ord, namespace: each part as a class; some have no namespace."""
    return _assemblies(spark, sf_dir).select("class", F.concat(F.col("brand"), F.lit("/"), "k", F.lit(".h")).alias("file"), F.col("k").alias("ord"), F.col("brand").alias("namespace"))


def assembly_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class, signature, place, is_public, used_types: how a part is made; some have an overload, a longer name or both."""
    none = F.expr("CAST(array() AS array<string>)")
    remake = lambda place, when: F.when(when, F.struct(F.lit("void remake(Part p)").alias("signature"), F.lit(place).alias("place"), F.lit(True).alias("is_public"), F.array(F.lit("Part"), F.concat(F.lit("P"), F.floor(F.col("k") / 4))).alias("used_types")))
    plain = lambda place, signature, public: F.struct(F.lit(signature).alias("signature"), F.lit(place).alias("place"), F.lit(public).alias("is_public"), none.alias("used_types"))
    third = F.col("z") % 3 == 0
    rows = F.array(remake(0, third), plain(1, "void make(int n)", True), plain(2, "int cost() const", True), remake(3, ~third), F.when(F.col("z") % 5 == 0, plain(4, "void make(long n)", False)), plain(5, "void check(int n)", False))
    return _assemblies(spark, sf_dir).select("class", F.explode(F.filter(rows, lambda m: m.isNotNull())).alias("m")).select("class", "m.*")


def assembly_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class, signature, step, target, member, kind, is_write, line: parts are made of parts with smaller numbers, some call back; every other one names the part without namespace."""
    k, z, nothing = F.col("k"), F.col("z"), F.lit(None)
    part = lambda by: F.floor(k / by)

    def step(signature, nth, other, target, member, kind, write, when):
        fields = {"signature": F.lit(signature), "step": F.lit(nth), "other": other.cast("long"), "target": F.lit(target).cast("string"), "member": F.lit(member), "kind": F.lit(kind), "is_write": write}
        return F.when(when, F.struct(*(v.alias(n) for n, v in fields.items())))

    make, cost, check, always = "void make(int n)", "int cost() const", "void check(int n)", F.lit(True)
    unknown, no = nothing.cast("boolean"), F.lit(False)
    rows = F.array(
        step(make, 1, part(4), None, "make", "call", unknown, part(4) >= 1),
        step(make, 2, part(6), None, "check", "call", unknown, part(6) >= 1),
        step(make, 3, nothing, "_self_", "stock", "field", z % 4 == 0, always),
        step(make, 4, part(4), None, "price", "field", no, part(4) >= 1),
        step(make, 5, nothing, "_self_", "cost", "call", unknown, always),
        step(make, 6, 4 * k + 1, None, "make", "call", unknown, z % 10 == 0),
        step(cost, 1, nothing, "_self_", "price", "field", no, always),
        step(cost, 2, nothing, "_meta_", "truncated", "call", unknown, always),
        step(check, 1, part(5), None, "remake", "call", unknown, part(5) >= 1),
        step(check, 2, nothing, "_self_", "make", "call", unknown, z % 7 == 0),
    )
    own = _assemblies(spark, sf_dir)
    steps = own.select("class", "z", F.explode(F.filter(rows, lambda s: s.isNotNull())).alias("s")).select("class", "z", "s.*")
    named = steps.join(own.select(F.col("k").alias("other"), F.col("class").alias("full")), "other", "left")
    called = F.when((F.col("z") % 2 == 0) & F.col("full").isNotNull(), F.col("full")).otherwise(F.concat(F.lit("P"), "other"))
    return named.select("class", "signature", "step", F.coalesce("target", called).alias("target"), "member", "kind", "is_write", (F.col("step") * 3 + 1).alias("line"))


def assembly_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class, target, dep_type: what a part has, takes and is derived from, by names without namespace."""
    k = F.col("k")
    dep = lambda by, kind, when: F.when(when & (k >= by), F.struct(F.concat(F.lit("P"), F.floor(k / by)).alias("target"), F.lit(kind).alias("dep_type")))
    rows = F.array(dep(4, "composition", F.lit(True)), dep(6, "association", F.lit(True)), dep(5, "inheritance", F.col("z") % 13 == 0), dep(7, "dependency", F.col("z") % 3 == 0))
    return _assemblies(spark, sf_dir).select("class", F.explode(F.filter(rows, lambda d: d.isNotNull())).alias("d")).select("class", "d.*")
