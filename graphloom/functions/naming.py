"""Names, labels and rules on strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The last word of a name and what it says of the rest.
VERB_TEMPLATES = {
    "manager": "Manages {noun}", "factory": "Creates {noun} instances", "pool": "Pools {noun} resources", "cache": "Caches {noun} data",
    "handler": "Handles {noun} events", "scheduler": "Schedules {noun} tasks", "controller": "Controls {noun} lifecycle", "dispatcher": "Dispatches {noun} events",
    "observer": "Observes {noun} changes", "builder": "Builds {noun} objects", "parser": "Parses {noun} data", "serializer": "Serializes {noun}",
    "validator": "Validates {noun}", "queue": "Queues {noun} work items", "listener": "Listens for {noun} events", "engine": "Core {noun} processing engine",
    "service": "Provides {noun} services", "repository": "Stores and retrieves {noun}", "adapter": "Adapts {noun} interface", "proxy": "Proxies access to {noun}",
    "provider": "Provides {noun} data", "driver": "Drives {noun} hardware", "allocator": "Allocates {noun} memory", "registry": "Registers and looks up {noun}",
    "tracker": "Tracks {noun} state", "collector": "Collects {noun} data", "iterator": "Iterates over {noun}", "visitor": "Visits {noun} nodes", "watcher": "Watches {noun} changes",
}
#: Design patterns by name, the first that matches.
PATTERNS = (
    ("Observer|Listener|Subscriber", "Observer"), ("Factory|Creator|Spawner", "Factory"), ("Singleton", "Singleton"), ("Strategy|Policy|Algorithm", "Strategy"),
    ("Decorator|Wrapper", "Decorator"), ("Proxy", "Proxy"), ("Adapter|Bridge", "Adapter"), ("Facade", "Facade"), ("Builder", "Builder"), ("Command", "Command"),
    ("Iterator", "Iterator"), ("Visitor", "Visitor"), ("Composite", "Composite"), ("Mediator", "Mediator"), ("Flyweight", "Flyweight"),
)


#: Where the words of a CamelCase name begin, runs of capitals kept together, and where one is told apart for searching.
CAPITALS, CAPITALIZED = r"([A-Z]+(?=[A-Z][a-z])|[A-Z]+$)", r"([A-Z][a-z]+)"
BOUNDARY = r"([a-z])([A-Z])|([A-Z]+)([A-Z][a-z])"


def split_camel(name: Column) -> Column:
    """Words of a CamelCase name, runs of capitals kept together."""
    spaced = F.regexp_replace(F.regexp_replace(name, CAPITALS, " $1"), CAPITALIZED, " $1")
    return F.filter(F.split(spaced, r"\s+"), lambda w: w != "")


def expand_camel(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, BOUNDARY, "$1$3 $2$4"))


def sanitize_id(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


def class_of(qualified: Column) -> Column:
    """All before the last ``::``, or the whole name."""
    return F.when(F.instr(qualified, "::") > 0, F.regexp_extract(qualified, r"(?s)^(.*)::", 1)).otherwise(qualified)


def method_of(qualified: Column) -> Column:
    return F.substring_index(qualified, "::", -1)


def sentence_case(text: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def intent(name: Column, responsibility: Column) -> Column:
    words = split_camel(name)
    n = F.size(words)
    last = F.when(n > 0, F.lower(F.get(words, n - 1))).otherwise("")
    noun = F.when(n > 1, F.lower(F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), " "))).otherwise(F.lower(name))
    table = F.create_map(*[F.lit(x) for pair in VERB_TEMPLATES.items() for x in pair])
    known = sentence_case(F.replace(F.try_element_at(table, last), F.lit("{noun}"), noun))
    spoken = F.lower(F.array_join(words, " "))
    labelled = F.when(~F.coalesce(responsibility, F.lit("")).isin("", "Unknown"), F.concat(responsibility, F.lit(": "), spoken))
    return F.coalesce(known, labelled, F.concat(F.lit("Handles "), spoken, F.lit(" operations")))


def design_pattern(name: Column) -> Column:
    return F.coalesce(*[F.when(name.rlike(f"(?i){p}"), label) for p, label in PATTERNS])


def change_risk(in_degree: Column) -> Column:
    return F.when(in_degree >= 5, "high").when(in_degree >= 2, "medium").otherwise("low")


def tradeoffs(aggregations: Column, out_degree: Column, in_degree: Column, bases: Column) -> Column:
    """Remarks on structure, in order; those that don't apply are left out."""
    s = lambda c: c.cast("string")
    return F.array_compact(F.array(
        F.when(aggregations > 0, F.concat(F.lit("Shared ownership ("), s(aggregations), F.lit(" shared_ptr/weak_ptr dep"), F.when(aggregations > 1, "s").otherwise(""), F.lit(") may cause lifecycle ambiguity"))),
        F.when(out_degree > 8, F.concat(F.lit("High fan-out ("), s(out_degree), F.lit(" dependencies) — potential god-class, consider decomposing"))),
        F.when(bases > 2, F.concat(F.lit("Deep inheritance ("), s(bases), F.lit(" base classes) increases coupling and reduces flexibility"))),
        F.when((in_degree == 0) & (out_degree > 0), F.lit("Root node — not depended on by others; changes here propagate downward widely")),
        F.when(in_degree >= 5, F.concat(F.lit("High fan-in ("), s(in_degree), F.lit(" dependents) — changes here have wide blast radius"))),
    ))


def method_label(signature: Column) -> Column:
    """name(first, two, ...) of a signature; what isn't one is cut to 60 characters."""
    sig = F.trim(signature)
    params = F.regexp_extract(sig, r"(?s)\(([^(]*)\)$", 1)
    name = F.regexp_extract(sig, r"(?s)(\S+)\s*\([^(]*\)$", 1)
    parts = F.filter(F.transform(F.split(params, ","), lambda p: F.trim(p)), lambda p: p != "")
    short = F.concat(F.array_join(F.slice(parts, 1, 2), ", "), F.when(F.size(parts) > 2, ", ...").otherwise(""))
    return F.when(sig.rlike(r"(?s)\S\s*\([^(]*\)$"), F.concat(name, F.lit("("), short, F.lit(")"))).otherwise(F.substring(sig, 1, 60))


#: Roles by how method names start, the first with enough hits.
ROLES = (
    (("parse", "decode", "deserialize", "tokenize", "lex"), "Parser / Decoder"),
    (("encode", "serialize", "format", "render"), "Serializer / Formatter"),
    (("connect", "listen", "accept", "send", "recv", "read", "write", "fetch"), "I/O Handler"),
    (("handle", "on", "dispatch", "notify", "emit", "trigger"), "Event Handler"),
    (("create", "build", "make", "spawn", "allocate"), "Factory / Builder"),
    (("destroy", "close", "shutdown", "cleanup", "free", "release"), "Lifecycle Manager"),
    (("schedule", "run", "execute", "submit", "enqueue"), "Executor / Scheduler"),
    (("get", "set", "fetch", "load", "store", "update"), "Data Accessor"),
    (("validate", "check", "verify", "assert"), "Validator"),
    (("log", "trace", "record", "report", "audit"), "Logger / Monitor"),
)


def method_role(names: Column) -> Column:
    """Role of an array of lower-case method names: at least min(2, a quarter of them) start alike."""
    need = F.least(F.lit(2), F.ceil(F.size(names) * 0.25))
    hit = lambda prefixes: F.size(F.filter(names, lambda n: n.rlike("^(" + "|".join(prefixes) + ")")))
    return F.coalesce(*[F.when(hit(p) >= need, role) for p, role in ROLES])


def tokens(text: Column) -> Column:
    """Distinct lower-case words of two letters or more, CamelCase split."""
    split = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.array_distinct(F.transform(F.filter(F.split(split, r"[\s_:,.()\[\]<>]+"), lambda w: F.length(w) > 1), lambda w: F.lower(w)))


def explain_step(target: Column, member: Column, kind: Column, is_write: Column) -> Column:
    own = F.concat(F.when(is_write, "writes field `").otherwise("reads field `"), member, F.lit("`"))
    full = F.concat(F.when(kind == "call", "calls `").when(is_write, "writes `").otherwise("reads `"), target, F.lit("::"), member, F.lit("`"))
    return F.when(target == "_self_", own).otherwise(full)
