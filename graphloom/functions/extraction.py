"""What a parser's strings say: dependencies from types, flags, signatures, responsibilities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types that are no dependency, and namespaces whose types are none.
BUILTIN = (
    "void", "bool", "char", "short", "int", "long", "float", "double", "unsigned", "signed", "size_t", "uint8_t", "uint16_t", "uint32_t", "uint64_t",
    "int8_t", "int16_t", "int32_t", "int64_t", "ptrdiff_t", "nullptr_t", "string", "wstring", "u16string", "u32string", "auto", "decltype",
)
LIBRARIES = ("std::", "__gnu_cxx::", "__cxx11::", "boost::", "absl::")
#: Flags that only one compiler knows.
FOREIGN_FLAGS = r"^-(?:Werror=stringop-overflow|Werror=stringop-truncation|Werror=implicit-fallthrough=\d*|fstack-protector-strong|fstack-clash-protection|fcf-protection(?:=\w+)?|fno-semantic-interposition|mno-omit-leaf-frame-pointer|Wno-error=deprecated-declarations|fvar-tracking-assignments)$"
#: Responsibilities by name, the first that matches.
RESPONSIBILITIES = (
    ("Manager$", "Resource Lifecycle"), ("Handler$", "Event Processing"), ("Provider$", "Data Supply"), ("Factory$", "Object Creation"), ("Driver$", "Hardware Abstraction"),
    ("Scheduler$", "Task Ordering"), ("Controller$", "Orchestration"), ("Dispatcher$", "Event Routing"), ("Observer$", "Event Observation"), ("Builder$", "Object Construction"),
    ("Parser$", "Data Parsing"), ("Serializer$", "Data Serialization"), ("Validator$", "Data Validation"), ("Pool$", "Resource Pooling"), ("Cache$|Cach", "Data Caching"),
    ("Queue$", "Work Queuing"), ("Listener$", "Event Listening"), ("Engine$", "Core Processing"), ("Service$", "Service Provision"), ("Repository$", "Data Storage"),
    ("Adapter$", "Interface Adaptation"), ("Proxy$", "Access Proxying"),
)
#: Groups of free functions by words in them, the first that matches.
FREE_FUNCTIONS = (
    ("(util|utils|helper|common|misc)", "Utility Helpers"), ("(parse|parser|decode|encode|codec|format|serialize)", "Data Transformation"),
    ("(raid|md|disk|nvme|io|driver)", "Storage / IO Helpers"), ("(test|mock|fixture|stub)", "Test Support"),
)


def bare(type_: Column) -> Column:
    """A type without const, pointers and references."""
    return F.trim(F.regexp_replace(type_, r"\b(const|volatile|restrict)\b|[*&]", ""))


def canonical(type_: Column) -> Column:
    return F.regexp_replace(bare(type_), "^:+", "")


def trivial(type_: Column) -> Column:
    plain = F.trim(F.substring_index(F.regexp_replace(type_, "^:+", ""), "<", 1))
    known = plain.isin(*BUILTIN)
    for name in LIBRARIES:
        known = known | plain.startswith(name)
    return known


#: Containers whose first argument is what they hold, and those whose second one is.
HOLDS_FIRST, HOLDS_SECOND = "vector|list|deque|set|unordered_set", "map|unordered_map|multimap"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _held(type_: Column, depth: int = 3) -> Column:
    """What a container holds, or the container in it, down to ``depth`` levels; other types as they are."""
    from .signatures import template_arguments

    if not depth:
        return type_

    def inner(t: Column) -> Column:
        nth = F.when(t.rlike(rf"^(?:std::)?(?:{HOLDS_FIRST})\s*<"), 0).when(t.rlike(rf"^(?:std::)?(?:{HOLDS_SECOND})\s*<"), 1)
        found = F.when(nth.isNotNull(), F.get(template_arguments(t), nth))
        return let(found, lambda x: F.when(F.coalesce(x, F.lit("")) == "", t).otherwise(_held(x, depth - 1)))

    return let(type_, inner)


def field_dependency(type_: Column) -> Column:
    """Struct (target, type, cardinality) that a field's type stands for; null if it is trivial.

    Arguments of templates are told by their brackets, so one with arguments of its own stays whole.
    """
    from .signatures import template_arguments

    def nth(t: Column, pattern: str, n: int) -> Column:
        found = F.get(template_arguments(F.regexp_extract(t, rf"(?s)(?:{pattern})\s*(<.*)$", 1)), n)
        # One without brackets ends at its first blank, so a const argument tells nothing.
        return let(F.coalesce(found, F.lit("")), lambda a: bare(F.when(a.rlike(r"[<(]"), a).otherwise(F.regexp_extract(a, r"^(\S+)", 1))))

    def dep(target: Column, kind: str, card: str | None = None) -> Column:
        return let(target, lambda t: F.when(~trivial(t) & (t != ""), F.struct(t.alias("target"), F.lit(kind).alias("type"), F.lit(card).cast("string").alias("cardinality"))))

    def of(t: Column) -> Column:
        many = let(bare(_held(nth(t, HOLDS_FIRST, 0))), lambda x: F.when(x != "", x))
        mapped = let(bare(_held(nth(t, HOLDS_SECOND, 1))), lambda x: F.when(x != "", x))
        held = F.coalesce(many, mapped)
        plain = F.when(t.rlike(r"[*&]\s*$"), dep(canonical(t), "aggregation")).otherwise(dep(canonical(t), "composition"))
        return (
            F.when(t.rlike(r"unique_ptr\s*<"), dep(nth(t, "unique_ptr", 0), "composition"))
            .when(t.rlike(r"(shared_ptr|weak_ptr)\s*<"), dep(nth(t, "shared_ptr|weak_ptr", 0), "aggregation"))
            .otherwise(let(held, lambda x: F.when(x.isNotNull(), dep(x, "aggregation", "1..*")).otherwise(plain)))
        )

    return let(type_, of)


def alias_dependency(canonical_type: Column) -> Column:
    c = F.replace(canonical_type, F.lit(" "), F.lit(""))
    pointer = canonical_type.contains("*") | c.rlike(r"\b(raw_ptr|ptr)\b")
    return F.when(c.rlike(r"\bunique_ptr\b"), "composition").when(c.rlike(r"\b(shared_ptr|weak_ptr)\b") | pointer, "aggregation").otherwise("association")


def inner_template(canonical_type: Column) -> Column:
    return canonical(F.regexp_extract(canonical_type, "<([^<>]+)>", 1))


def responsibility(comment: Column, name: Column, signatures: Column) -> Column:
    """A comment of more than 10 characters, cut to 200; else by name; else from the first three methods."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(comment, r"/\*+|\*/|//+", ""), r"\s*\*\s*", " "), r"@\w+[^\n]*", "")
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    by_name = F.coalesce(*[F.when(name.rlike(p), label) for p, label in RESPONSIBILITIES])
    called = F.transform(F.slice(signatures, 1, 3), lambda s: F.regexp_extract(F.substring_index(s, "(", 1), r"(\S+)\s*$", 1))
    provides = F.when(F.size(signatures) > 0, F.concat(F.lit("Provides "), F.array_join(called, ", "), F.lit(" functionality")))
    return F.coalesce(F.when(F.length(c) > 10, F.substring(c, 1, 200)), by_name, provides, F.concat(F.lit("Manages "), name, F.lit(" operations")))


def free_function_group(name: Column, signatures: Column) -> Column:
    text = F.lower(F.concat_ws(" ", name, F.array_join(signatures, " ")))
    return F.coalesce(*[F.when(text.rlike(p), label) for p, label in FREE_FUNCTIONS], F.lit("Free Functions"))


def attribute(access: Column, type_: Column, name: Column) -> Column:
    """A field with its sign for public, private or protected."""
    sign = F.when(access == "public", "+").when(access == "protected", "#").otherwise("-")
    return F.concat(sign, type_, F.lit(" "), name)


def compiler_arguments(arguments: Column, file: Column) -> Column:
    """Arguments after the compiler's name, without output options and their values, the file and objects."""
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, a: Column) -> Column:
        option = a.isin("-o", "-MF", "-MT", "-MQ")
        drop = state["skip"] | option | (a == file) | a.endswith(".o")
        return F.struct((option & ~state["skip"]).alias("skip"), F.when(drop, state["kept"]).otherwise(F.concat(state["kept"], F.array(a))).alias("kept"))

    return F.aggregate(F.slice(arguments, 2, F.greatest(F.size(arguments) - 1, F.lit(0))), start, step)["kept"]


def known_flags(arguments: Column) -> Column:
    return F.filter(arguments, lambda a: ~a.rlike(FOREIGN_FLAGS))
