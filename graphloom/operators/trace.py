"""Traces: backtrace text to frames and call edges; state machines from source text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: a frame of a debugger's backtrace.
FRAME = r"#(\d+)\s+(?:0x[0-9a-fA-F]+\s+in\s+)?([\w:<>~,\s*&]+?)\s*\(([^)]*)\)(?:\s+at\s+([\w./]+):(\d+))?"


def without_this(args: Column) -> Column:
    """Arguments but for ``this=``, joined by comma and blank."""
    parts = F.transform(F.split(args, ","), lambda a: F.trim(a))
    return F.array_join(F.filter(parts, lambda a: ~a.startswith("this=")), ", ")


def frames(traces: DataFrame, trace: str = "trace", text: str = "text") -> DataFrame:
    """trace, frame, class, method, args, file, line: one row for each frame of each text."""
    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(FRAME), F.lit(0)), lambda m: m)
    rows = traces.select(F.col(trace).alias("trace"), F.explode(found).alias("m"))
    part = lambda i: F.regexp_extract("m", FRAME, i)
    name = F.trim(part(2))
    rows = rows.select("trace", part(1).cast("int").alias("frame"), name.alias("name"), without_this(F.trim(part(3))).alias("args"), part(4).alias("file"), F.coalesce(part(5).try_cast("int"), F.lit(0)).alias("line"))
    owner = F.when(F.instr("name", "::") > 0, F.regexp_extract("name", r"(?s)^(.*)::", 1)).otherwise("global")
    return rows.select("trace", "frame", owner.alias("class"), F.substring_index("name", "::", -1).alias("method"), "args", "file", "line")


def call_edges(found: DataFrame) -> DataFrame:
    """trace, pos, caller, callee, args: each frame is called by the next outer one, outermost first."""
    order = W.partitionBy("trace").orderBy("frame")
    name = F.concat_ws("::", "class", "method")
    rows = found.select("trace", "frame", name.alias("callee"), "args", F.lead(name).over(order).alias("caller"), F.lead("frame").over(order).alias("outer"))
    return rows.filter("outer IS NOT NULL").select("trace", (-F.col("frame")).alias("pos"), "caller", "callee", "args")


def adjacent(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group, pos, src, dst: neighbouring values of a sequence as edges."""
    w = W.partitionBy(group).orderBy(order)
    out = rows.select(F.col(group).alias("group"), F.col(order).alias("pos"), F.lag(value).over(w).alias("src"), F.col(value).alias("dst"))
    return out.filter("src IS NOT NULL")


@dataclass
class _Switch:
    variable: str
    labels: list[str] = field(default_factory=list)
    moves: list[tuple[str, str]] = field(default_factory=list)


class _Reader:
    """One pass over the words and signs of a source text, gathering enums and switch blocks."""

    def __init__(self, source: str):
        self.words = re.findall(r"\w+|::|\S", source)
        self.at = 0
        self.enums: dict[str, list[str]] = {}
        self.switches: list[_Switch] = []
        while self.at < len(self.words):
            word = self.words[self.at]
            self.at += 1
            if word == "enum":
                self.enum()
            elif word == "switch":
                self.switch()

    def ahead(self, n: int = 0) -> str:
        return self.words[self.at + n] if self.at + n < len(self.words) else ""

    def enum(self) -> None:
        self.at += self.ahead() == "class"
        if not _is_word(self.ahead()) or self.ahead(1) != "{":
            return
        name, member = self.ahead(), []
        self.at += 2
        members = [member]
        while self.at < len(self.words) and self.ahead() != "}":
            if self.ahead() == ",":
                members.append(member := [])
            else:
                member.append(self.ahead())
            self.at += 1
        named = (m[: m.index("=")] if "=" in m else m for m in members)
        self.enums[name] = [m[0] for m in named if len(m) == 1 and _is_word(m[0])]

    def switch(self) -> None:
        if [self.ahead(k) for k in (0, 2, 3)] != ["(", ")", "{"]:
            return
        found, depth = _Switch(self.ahead(1)), 1
        self.at += 4
        while depth and self.at < len(self.words):
            word = self.ahead()
            self.at += 1
            depth += (word == "{") - (word == "}")
            if word == "case" and (state := self.state(":")):
                found.labels.append(state)
            elif word == found.variable and self.ahead() == "=":
                self.at += 1
                state = self.state(";")
                if state and found.labels and state != found.labels[-1]:
                    found.moves.append((found.labels[-1], state))
        if found.labels and not depth:
            self.switches.append(found)

    def state(self, end: str) -> str | None:
        """The state named next, with its scope or without, if ``end`` follows it."""
        skip = 2 if self.ahead(1) == "::" else 0
        return self.ahead(skip) if _is_word(self.ahead(skip)) and self.ahead(skip + 1) == end else None

    def rows(self) -> Iterator[tuple[str, str, str | None, str | None]]:
        for found in self.switches:
            enum = next((e for e, states in self.enums.items() if set(states) & set(found.labels)), None)
            states = ",".join(self.enums[enum] if enum else found.labels)
            for source, target in found.moves or [(None, None)]:
                yield enum or found.variable, states, source, target


def _is_word(text: str) -> bool:
    return bool(text) and (text[0] == "_" or text[0].isalnum())


def state_machines(sources: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """key, enum, states, source, target: transitions that switch blocks assign.

    A state is named by the enum that has a label of the block, the first of
    them in the text, else by the switched variable. A block without
    transitions gives one row without source and target, one without labels or
    without an end gives none; a null text is empty. Words in order need
    Python; texts go by Arrow batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *m) for k, s in zip(batch["key"], batch["text"], strict=True) for m in _Reader(s or "").rows()]
            yield pd.DataFrame(rows, columns=["key", "enum", "states", "source", "target"])

    return sources.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInPandas(run, "key string, enum string, states string, source string, target string")
