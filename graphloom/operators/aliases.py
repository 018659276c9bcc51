"""Type aliases that stand for other aliases, and the dependencies of fields that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extraction import alias_dependency, field_dependency, inner_template, trivial
from .graph import keep


def bare_name(type_: Column) -> Column:
    """A type without arguments, blanks, qualifiers and signs: what an alias is looked up by."""
    plain = F.regexp_replace(F.substring_index(type_, "<", 1), r"\b(const|volatile)\b|[*&\s]", "")
    return F.regexp_replace(plain, "^:+", "")


def resolved(aliases: DataFrame) -> DataFrame:
    """alias, canonical: the first type on an alias's way that is none itself; null for aliases that lead into a cycle.

    ``aliases``: alias, canonical; of several the smallest canonical counts. Each round every alias jumps as
    far as its target has come, so a chain ends after the logarithm of its length; what hasn't ended after as
    many rounds as all aliases together allow goes round.
    """
    known = aliases.filter("alias <> '' AND canonical <> ''").groupBy("alias").agg(F.min("canonical").alias("canonical")).withColumn("next", bare_name(F.col("canonical")))
    names = known.select(F.col("alias").alias("next"))
    plain = known.filter(F.col("canonical").contains("<")).select("alias").withColumn("is_end", F.lit(True))
    steps = known.join(plain, "alias", "left").join(names.withColumn("goes_on", F.lit(True)), "next", "left")
    steps = keep(steps.select("alias", "canonical", F.when(F.col("goes_on") & F.col("is_end").isNull(), F.col("next")).alias("next")))
    rounds = max(1, steps.count()).bit_length()
    for _ in range(rounds):
        if steps.filter("next IS NOT NULL").isEmpty():
            break
        onward = steps.select(F.col("alias").alias("next"), F.col("canonical").alias("far"), F.col("next").alias("beyond"))
        steps = keep(steps.join(onward, "next", "left").select("alias", F.coalesce("far", "canonical").alias("canonical"), F.col("beyond").alias("next")))
    return steps.select("alias", F.when(F.col("next").isNull(), F.col("canonical")).alias("canonical"))


def alias_table(aliases: DataFrame) -> DataFrame:
    """alias, canonical, inner, dep_type of the ``resolved`` aliases: the innermost template argument and the kind of dependency."""
    found = resolved(aliases).filter("canonical IS NOT NULL")
    return found.select("alias", "canonical", inner_template(F.col("canonical")).alias("inner"), alias_dependency(F.col("canonical")).alias("dep_type"))


def field_dependencies(fields: DataFrame, aliases: DataFrame) -> DataFrame:
    """``fields`` (type, ...) with dep (target, type, cardinality) and alias, the one that it's by.

    An alias with a template argument stands for it; fields of other types follow their own text.
    """
    table = alias_table(aliases).filter("inner <> ''").select(F.col("alias").alias("bare_"), "inner", "dep_type")
    rows = fields.withColumn("bare_", bare_name(F.col("type"))).join(table, "bare_", "left")
    by_alias = F.when(~trivial(F.col("inner")), F.struct(F.col("inner").alias("target"), F.col("dep_type").alias("type"), F.lit(None).cast("string").alias("cardinality")))
    dep = F.when(F.col("inner").isNotNull(), by_alias).otherwise(field_dependency(F.col("type")))
    return rows.withColumn("dep", dep).withColumn("alias", F.when(F.col("inner").isNotNull(), F.col("bare_"))).drop("bare_", "inner", "dep_type")
