"""What is said of classes, modules and projects: rules, and a model's answers behind a memo.

Each thing has a hash of what an answer rests on. Answers are kept in a table by hash;
only hashes that it lacks are asked for, once each, in batches inside tasks, by a
callable that the user gives. Answers are checked by column expressions; where one
is missing or unsound, the rules' own words stand in. New answers are published at
once or not at all, so a run that is lost asks again but leaves the memo as it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming
from ..sources.snapshots import Store
from .graph import keep

#: Takes prompts and gives as many answers, JSON text or None.
Ask = Callable[[list[str]], list[str | None]]
RISKS = ("high", "medium", "low")
_NO_DEPS = "CAST(array() AS array<struct<target:string,type:string>>)"
_NO_TEXTS = "CAST(array() AS array<string>)"


def _texts(c: str) -> Column:
    return F.coalesce(c, F.expr(_NO_TEXTS))


def heuristics(entries: DataFrame, in_degrees: DataFrame) -> DataFrame:
    """``entries`` with intent, tradeoffs, risk, pattern by rule.

    ``entries``: name, responsibility, interfaces, bases, deps (target, type), other columns. ``in_degrees``: name, in_degree.
    """
    rows = entries.join(in_degrees.select("name", "in_degree"), "name", "left")
    deps, degree = F.coalesce("deps", F.expr(_NO_DEPS)), F.coalesce("in_degree", F.lit(0))
    shared = F.size(F.filter(deps, lambda d: d["type"] == "aggregation"))
    said = {
        "intent": naming.intent(F.col("name"), F.col("responsibility")),
        "tradeoffs": naming.tradeoffs(shared, F.size(deps), degree, F.size(_texts("bases"))),
        "risk": naming.change_risk(degree),
        "pattern": naming.design_pattern(F.col("name")),
    }
    return rows.withColumns(said).drop("in_degree")


# --- hashes: SHA-256 of JSON with sorted keys and a space behind commas and colons


def _quoted(text: Column) -> Column:
    """A JSON string."""
    listed = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def _strings(items: Column) -> Column:
    return _list(F.transform(F.sort_array(items), _quoted))


def _digest(prefix: str, **fields: Column) -> Column:
    parts = [F.concat(F.lit(f'"{key}": '), fields[key]) for key in sorted(fields)]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256), 1, 16))


def entry_hash() -> Column:
    """Of name, responsibility, interfaces, bases and deps; place, risk and order don't count."""
    pairs = F.sort_array(F.transform(F.coalesce("deps", F.expr(_NO_DEPS)), lambda d: F.struct(F.coalesce(d["target"], F.lit("")).alias("t"), F.coalesce(d["type"], F.lit("")).alias("k"))))
    deps = _list(F.transform(pairs, lambda d: _list(F.array(_quoted(d["t"]), _quoted(d["k"])))))
    return _digest("", className=_quoted(F.col("name")), responsibility=_quoted(F.col("responsibility")), interfaces=_strings(_texts("interfaces")), baseClasses=_strings(_texts("bases")), dependencies=deps)


def module_hash() -> Column:
    """Of a module's name, class_names and external targets."""
    return _digest("mod:", name=_quoted(F.col("name")), classNames=_strings(_texts("class_names")), externalDeps=_strings(_texts("external")))


def project_hash() -> Column:
    """Of the names of modules and entry points."""
    return _digest("proj:", modules=_strings(_texts("modules")), entryPoints=_strings(_texts("entry_points")))


# --- answers


def unfenced(answer: Column) -> Column:
    """The answer without a code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def _field(answer: Column, name: str) -> tuple[Column, Column]:
    """The value and the JSON type of a field."""
    found = F.try_variant_get(F.try_parse_json(unfenced(answer)), f"$.{name}", "variant")
    return found, F.coalesce(F.schema_of_variant(found), F.lit("MISSING"))


def sound_class(answer: Column) -> Column:
    """Whether an answer on a class has an intent that isn't blank, a known risk and a list of tradeoffs."""
    (intent, kind), (risk, risk_kind), (_, listed) = (_field(answer, x) for x in ("intent", "changeRisk", "tradeoffs"))
    text = lambda v: F.try_variant_get(F.try_parse_json(unfenced(answer)), f"$.{v}", "string")
    return F.coalesce((kind == "STRING") & (F.trim(F.regexp_replace(text("intent"), r"\s", " ")) != "") & (risk_kind == "STRING") & text("changeRisk").isin(*RISKS) & listed.startswith("ARRAY"), F.lit(False))


def sound_text(answer: Column, field: str) -> Column:
    """The text of a field, without outer blanks; null unless it is one."""
    _, kind = _field(answer, field)
    text = F.regexp_replace(F.try_variant_get(F.try_parse_json(unfenced(answer)), f"$.{field}", "string"), r"^\s+|\s+$", "")
    return F.when((kind == "STRING") & (text != ""), text)


def asked(misses: DataFrame, ask: Ask) -> DataFrame:
    """hash, answer for ``misses`` (hash, prompt); a batch that fails is answered by nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            prompts = rows["prompt"].tolist()
            try:
                answers = list(ask(prompts))
            except ImportError:
                raise
            except Exception:  # the model's side failed: the rules stand in
                answers = []
            answers = answers if len(answers) == len(prompts) else [None] * len(prompts)
            yield pd.DataFrame({"hash": rows["hash"], "answer": pd.Series(answers, index=rows.index, dtype=object)})

    return misses.select("hash", "prompt").mapInPandas(run, "hash string, answer string")


@dataclass
class Enriched:
    """The enriched rows, and how many there are, were asked for and were known."""

    rows: DataFrame
    total: int
    asked: int
    known: int


def _memoised(rows: DataFrame, store: Store, ref: str, ask: Ask | None, said: Callable[[DataFrame], DataFrame], fields: str, keep_all: bool) -> Enriched:
    """``rows`` (hash, prompt, own words, ...) with ``said``'s fields from the memo; what it lacks is asked for and published."""
    spark, kinds = rows.sparkSession, [f.split(" ", 1) for f in fields.split(", ")]

    def memo() -> DataFrame:
        found = (store.load(ref) or {}).get("memo")
        none = spark.createDataFrame([], f"hash string, {fields}")
        return (none if found is None else found).dropDuplicates(["hash"])

    total = rows.count()
    misses = rows.join(memo(), "hash", "left_anti").dropDuplicates(["hash"])
    count = misses.count()
    if count:
        answered = misses.join(asked(misses, ask), "hash") if ask else misses.withColumn("answer", F.lit(None).cast("string"))
        new = said(answered).select("hash", *(F.col(n).cast(k) for n, k in kinds))
        store.publish(ref, {"memo": new if keep_all else new.filter("by_model")}, append=True)
    own = {n: f"own_{n}" for n, _ in kinds if f"own_{n}" in rows.columns}
    out = rows.join(memo(), "hash", "left")
    out = out.withColumns({n: F.when(F.col("by_model").isNotNull(), F.col(n)).otherwise(F.col(o)) for n, o in own.items()}).withColumn("by_model", F.coalesce("by_model", F.lit(False)))
    return Enriched(out.drop("prompt", *own.values()), total, count, total - count)


CLASS_FIELDS = "intent string, tradeoffs array<string>, risk string, pattern string, by_model boolean"


def class_prompt() -> Column:
    """What is told of a class: its first eight dependencies, six methods, bases, and what the rules say."""
    listed = lambda c, n: F.coalesce(F.nullif(F.array_join(F.slice(c, 1, n), "; "), F.lit("")), F.lit("none"))
    deps = F.transform(F.coalesce("deps", F.expr(_NO_DEPS)), lambda d: F.concat(d["target"], F.lit(" ("), d["type"], F.lit(")")))
    wanted = 'Describe this class. Answer with one JSON object: "intent" (text), "tradeoffs" (list of texts, three at most), "changeRisk" (high, medium or low), "designPattern" (a name or null).'
    lines = [("Class", F.col("name")), ("Responsibility", F.coalesce("responsibility", F.lit(""))), ("Depends on", listed(deps, 8)), ("Public methods", listed(_texts("interfaces"), 6)), ("Bases", listed(_texts("bases"), 100)), ("By rule", F.concat_ws("; ", "own_intent", "own_risk", F.coalesce("own_pattern", F.lit("no pattern"))))]
    return F.concat_ws("\n", F.lit(wanted), *[F.concat(F.lit(f"{k}: "), v) for k, v in lines])


def enrich_classes(entries: DataFrame, in_degrees: DataFrame, store: Store, ask: Ask | None = None, ref: str = "classes") -> Enriched:
    """``entries`` with intent, tradeoffs, risk, pattern, hash and by_model; the rules' words are remembered, too, where an answer isn't sound."""
    fields = ("intent", "tradeoffs", "risk", "pattern")
    rows = keep(heuristics(entries, in_degrees).withColumnsRenamed({f: f"own_{f}" for f in fields}).withColumn("hash", entry_hash()))  # read for each count, look-up and result
    rows = rows.withColumn("prompt", class_prompt())

    def said(found: DataFrame) -> DataFrame:
        answer, whole = F.col("answer"), F.try_parse_json(unfenced(F.col("answer")))
        got = {"intent": F.try_variant_get(whole, "$.intent", "string"), "tradeoffs": F.try_variant_get(whole, "$.tradeoffs", "array<string>"), "risk": F.try_variant_get(whole, "$.changeRisk", "string"), "pattern": F.try_variant_get(whole, "$.designPattern", "string")}
        return found.withColumn("by_model", sound_class(answer)).withColumns({n: F.when(F.col("by_model"), v).otherwise(F.col(f"own_{n}")) for n, v in got.items()})

    return _memoised(rows, store, ref, ask, said, CLASS_FIELDS, True)


def _enrich_text(rows: DataFrame, store: Store, ask: Ask | None, ref: str, field: str) -> Enriched:
    def said(found: DataFrame) -> DataFrame:
        text = sound_text(F.col("answer"), field)
        return found.withColumn("by_model", text.isNotNull()).withColumn("summary", text)

    return _memoised(rows, store, ref, ask, said, "summary string, by_model boolean", False)


def enrich_modules(modules: DataFrame, store: Store, ask: Ask | None = None, ref: str = "modules") -> Enriched:
    """``modules`` (name, class_names, external, seed) with summary, hash and by_model; the seed stands in and isn't remembered."""
    wanted = 'Describe this module. Answer with one JSON object: "summary" (text).'
    prompt = F.concat_ws("\n", F.lit(wanted), F.concat(F.lit("Module: "), "name"), F.concat(F.lit("Classes: "), F.array_join(F.slice(_texts("class_names"), 1, 10), ", ")), F.concat(F.lit("Depends on: "), F.array_join(F.slice(_texts("external"), 1, 5), ", ")), F.col("seed"))
    rows = modules.withColumns({"hash": module_hash(), "prompt": prompt, "own_summary": F.coalesce("seed", F.lit(""))})
    return _enrich_text(rows, store, ask, ref, "summary")


def enrich_project(project: DataFrame, store: Store, ask: Ask | None = None, ref: str = "project") -> Enriched:
    """``project`` (name, modules, entry_points) with summary, null without a sound answer, hash and by_model."""
    wanted = 'Describe this project. Answer with one JSON object: "projectSummary" (text).'
    prompt = F.concat_ws("\n", F.lit(wanted), F.concat(F.lit("Project: "), "name"), F.concat(F.lit("Modules: "), F.array_join(F.slice(_texts("modules"), 1, 10), ", ")), F.concat(F.lit("Entry points: "), F.array_join(F.slice(_texts("entry_points"), 1, 5), ", ")))
    rows = project.withColumns({"hash": project_hash(), "prompt": prompt, "own_summary": F.lit(None).cast("string")})
    return _enrich_text(rows, store, ask, ref, "projectSummary")
