"""Signatures, types and command lines as strings, read character by character.

A fold over the characters keeps the depth of brackets, or the quote that is open,
so what nests stays together. Each is one column expression, linear in the text
but for the parts it builds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extraction import canonical, let, trivial

_NO_TEXTS = "CAST(array() AS array<string>)"


def _closes(c: Column, before: Column) -> Column:
    """Closing brackets; the end of an arrow is none."""
    return c.isin(")", "]", "}") | ((c == ">") & (before != "-"))


def split_top(text: Column, separator: str = ",") -> Column:
    """The trimmed parts of a text between separators outside all brackets; empty parts are left out."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.expr(_NO_TEXTS).alias("parts"), F.lit("").alias("last"))

    def step(s: Column, c: Column) -> Column:
        cut = (c == separator) & (s["depth"] == 0)
        depth = F.when(c.isin("<", "(", "[", "{"), s["depth"] + 1).when(_closes(c, s["last"]), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        part = F.when(cut, "").otherwise(F.concat(s["part"], c))
        return F.struct(depth.alias("depth"), part.alias("part"), F.when(cut, F.array_append(s["parts"], s["part"])).otherwise(s["parts"]).alias("parts"), c.alias("last"))

    whole = F.aggregate(F.split(text, ""), start, step, lambda s: F.array_append(s["parts"], s["part"]))
    return F.filter(F.transform(whole, lambda p: F.trim(p)), lambda p: p != "")


def _group(text: Column, opening: str, closing: str, first: bool) -> Column:
    """Struct (start, end) of the first or last outermost pair of brackets, counted from 1; 0 where there is none."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("open"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("last"))

    def step(s: Column, c: Column) -> Column:
        at = s["at"] + 1
        shut = (c == closing) & (s["last"] != "-") & (s["depth"] == 1)
        takes = shut & (s["end"] == 0) if first else shut
        depth = F.when(c == opening, s["depth"] + 1).when((c == closing) & (s["last"] != "-"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        opened = F.when((c == opening) & (s["depth"] == 0), at).otherwise(s["open"])
        return F.struct(at.alias("at"), depth.alias("depth"), opened.alias("open"), F.when(takes, s["open"]).otherwise(s["start"]).alias("start"), F.when(takes, at).otherwise(s["end"]).alias("end"), c.alias("last"))

    return F.aggregate(F.split(text, ""), start, step)


def template_arguments(type_: Column) -> Column:
    """The arguments of a type's first template, nested ones whole; none of a plain type."""

    def of(t: Column) -> Column:
        inside = lambda g: F.when(g["end"] > 0, t.substr(g["start"] + 1, g["end"] - g["start"] - 1)).otherwise("")
        return split_top(let(_group(t, "<", ">", first=True), inside))

    return let(type_, of)


def signature_parts(signature: Column) -> Column:
    """Struct (returns, name, params) of a signature; params are the parts of its last outermost parentheses.

    Conditions behind them aren't looked at. A text without parentheses is a name.
    """

    def named(head: Column, params: Column) -> Column:
        name = F.regexp_extract(head, r"(operator\s*\(\s*\)|operator\s*[^\s\w]+|~?\w+)$", 1)
        return let(name, lambda n: F.struct(F.trim(head.substr(F.lit(1), F.length(head) - F.length(n))).alias("returns"), n.alias("name"), split_top(params).alias("params")))

    def of(t: Column) -> Column:
        def apart(g: Column) -> Column:
            head = F.trim(F.when(g["end"] > 0, t.substr(F.lit(1), g["start"] - 1)).otherwise(t))
            params = F.when(g["end"] > 0, t.substr(g["start"] + 1, g["end"] - g["start"] - 1)).otherwise("")
            return let(head, lambda h: named(h, params))

        return let(_group(t, "(", ")", first=False), apart)

    return let(F.regexp_replace(signature, r"\b(noexcept|throw)\s*\([^()]*\)", ""), of)


#: Last words of a parameter that belong to its type.
_WORDS = r"(void|bool|char|short|int|long|float|double|unsigned|signed|const|volatile|auto)$"


def parameter_type(param: Column) -> Column:
    """A parameter without its name and default."""

    def of(plain: Column) -> Column:
        named = F.trim(F.regexp_extract(plain, r"^(.*[\s*&>])\w+$", 1))
        return let(named, lambda n: F.when((n == "") | plain.rlike(r"(^|\W)" + _WORDS), plain).otherwise(n))

    return let(F.trim(F.regexp_replace(param, r"\s*=.*$", "")), of)


def used_types(signature: Column) -> Column:
    """The types that a method's parameters and then its result name, without trivial ones, each once."""

    def of(parts: Column) -> Column:
        returns = canonical(F.regexp_replace(parts["returns"], r"\b(virtual|static|inline|explicit|constexpr)\b", ""))
        return F.concat(F.transform(parts["params"], lambda p: canonical(parameter_type(p))), F.array(returns))

    return F.array_distinct(F.filter(let(signature_parts(signature), of), lambda t: (t != "") & ~trivial(t)))


def rendered(kind: Column, returns: Column, name: Column, params: Column, parent: Column) -> Column:
    """A signature from its parts: constructors and destructors have no result, and a destructor's name begins with ~.

    ``params`` is an array of (type, name).
    """
    said = F.array_join(F.transform(params, lambda p: F.trim(F.concat_ws(" ", p["type"], p["name"]))), ", ")
    gone = F.when(F.coalesce(name, F.lit("")).startswith("~"), name).otherwise(F.concat(F.lit("~"), F.coalesce(parent, F.lit(""))))
    head = F.when(kind == "constructor", F.coalesce(name, F.lit(""))).when(kind == "destructor", gone).otherwise(F.concat(F.coalesce(F.nullif(returns, F.lit("")), F.lit("void")), F.lit(" "), name))
    return F.concat(head, F.lit("("), said, F.lit(")"))


def dependencies(found: Column, *own: Column) -> Column:
    """The dependencies (target, type, cardinality) in order: of equal (target, type) the first, with its cardinality; none on trivial types or the ``own`` names."""
    keys = F.transform(found, lambda d: F.concat_ws("\x1f", d["target"], d["type"]))
    mine = lambda t: F.array_contains(F.array(*own), t) if own else F.lit(False)
    return F.filter(found, lambda d, i: (F.array_position(keys, F.concat_ws("\x1f", d["target"], d["type"])) == i + 1) & (F.coalesce(d["target"], F.lit("")) != "") & ~trivial(d["target"]) & ~mine(d["target"]))


# --- command lines and paths


def shell_words(command: Column) -> Column:
    """The words of a command as a shell splits it; null where a quote or an escape isn't closed.

    Blanks part words. Single quotes keep all, double quotes keep all but a backslash before a double
    quote or a backslash, and elsewhere a backslash keeps the next character.
    """
    start = F.struct(F.expr(_NO_TEXTS).alias("words"), F.lit("").alias("word"), F.lit(False).alias("begun"), F.lit("").alias("mode"))

    def step(s: Column, c: Column) -> Column:
        mode, escaped, quoted = s["mode"], s["mode"] == "\\", s["mode"].isin("'", '"', '"\\')
        plain = mode == ""
        blank = plain & c.isin(" ", "\t", "\n", "\r")
        after = (
            F.when(escaped, "").when(mode == '"\\', '"').when(plain & c.isin("'", '"', "\\"), c)
            .when((mode == "'") & (c == "'"), "").when((mode == '"') & (c == '"'), "").when((mode == '"') & (c == "\\"), '"\\').otherwise(mode)
        )
        kept = (
            F.when(escaped, c).when(mode == '"\\', F.when(c.isin('"', "\\"), c).otherwise(F.concat(F.lit("\\"), c)))
            .when(plain & c.isin("'", '"', "\\", " ", "\t", "\n", "\r"), "").when((mode == "'") & (c == "'"), "").when((mode == '"') & c.isin('"', "\\"), "").otherwise(c)
        )
        ends = blank & s["begun"]
        begun = F.when(blank, False).otherwise(F.lit(True) | quoted)
        return F.struct(F.when(ends, F.array_append(s["words"], s["word"])).otherwise(s["words"]).alias("words"), F.when(blank, "").otherwise(F.concat(s["word"], kept)).alias("word"), begun.alias("begun"), after.alias("mode"))

    def end(s: Column) -> Column:
        return F.when(s["mode"] == "", F.when(s["begun"], F.array_append(s["words"], s["word"])).otherwise(s["words"]))

    return F.aggregate(F.filter(F.split(command, ""), lambda c: c != ""), start, step, end)


def absolute(directory: Column, path: Column) -> Column:
    """A path below its directory, without . and .. parts."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", directory, path))

    def step(kept: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), kept).when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, part))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(whole, "/"), F.expr(_NO_TEXTS), step), "/"))
