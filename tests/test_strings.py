"""Signatures, types, aliases and command lines against plain loops and the standard library."""

import json
import os
import random
import shlex

import pytest
from pyspark.sql import functions as F

from graphloom.functions import extraction, signatures
from graphloom.operators import aliases, filters
from graphloom.sources import files


def values(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_shell_words_are_those_of_the_shell(spark):
    rng = random.Random(2)
    texts = ["", " ", 'a "" b', "-D'x y'\"z\"", "a\\ b", '"a\\"b\\\\c\\d"', "'a\\'", "open 'x", 'open "x', "end\\", "tab\tnl\nx", "日本 'ü'"]
    texts += ["".join(rng.choice("ab '\"\\\t") for _ in range(rng.randint(0, 14))) for _ in range(400)]

    def want(text):
        try:
            return shlex.split(text)
        except ValueError:
            return None

    assert values(spark, texts, signatures.shell_words) == [want(x) for x in texts]


def test_absolute_paths(spark):
    pairs = [("/w", "a.c"), ("/w/b", "../a.c"), ("/w", "./x/../y/a.c"), ("/w", "/r//s/./a.c"), ("/", "../../a"), ("/w/", "a/"), ("/w", "..")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, d string, f string")
    got = [r[1] for r in rows.select("i", signatures.absolute(F.col("d"), F.col("f"))).orderBy("i").collect()]
    assert got == [os.path.normpath(os.path.join(d, f)) for d, f in pairs]


def test_compile_commands_split_and_join(spark, tmp_path):
    path = tmp_path / "compile_commands.json"
    path.write_text(json.dumps([
        {"directory": "/w/build", "file": "../a.cpp", "command": 'cc -D"A B" -I../x -o a.o -c /w/a.cpp'},
        {"directory": "/w", "file": "/w/b.cpp", "arguments": ["cc", "-Wall", "/w/b.cpp", "-MF", "d"], "command": "ignored"},
        {"directory": "/w", "file": "c.cpp", "command": "cc 'open"}, {"directory": "/w", "command": "cc x"}, {"directory": "/w", "file": ""},
    ]))
    got = {r["file"]: r["arguments"] for r in files.compile_commands(spark, str(path)).collect()}
    assert got == {"/w/a.cpp": ["-DA B", "-I../x", "-c"], "/w/b.cpp": ["-Wall"], "/w/c.cpp": []}


def test_parts_outside_brackets(spark):
    def want(text):
        parts, depth, part, last = [], 0, "", ""
        for c in text:
            if c == "," and not depth:
                parts, part = [*parts, part], ""
            else:
                part += c
            depth = depth + 1 if c in "<([{" else max(0, depth - 1) if c in ")]}" or (c == ">" and last != "-") else depth
            last = c
        return [p.strip(" ") for p in [*parts, part] if p.strip(" ")]

    rng = random.Random(3)
    texts = ["", "a", "a, b", "map<string, vector<Foo>>, int", "function<void(A, B)>, x", "a->b<c,d>,e", ",,a,", "x[1,2],{3,4}", "a>b,c"]
    texts += ["".join(rng.choice("ab,<>()-[] ") for _ in range(rng.randint(0, 16))) for _ in range(200)]
    assert values(spark, texts, signatures.split_top) == [want(x) for x in texts]


def test_template_arguments_keep_what_nests(spark):
    cases = {"map<string, vector<Foo>>": ["string", "vector<Foo>"], "function<void(A, B)>": ["void(A, B)"], "int": [], "A<B>::C<D>": ["B"], "std::pair<A<B, C>, D<E>> &": ["A<B, C>", "D<E>"], "A<": [], "": []}
    assert values(spark, cases, signatures.template_arguments) == list(cases.values())


def test_signatures_come_apart_and_together(spark):
    cases = {
        "void f(int a, map<string, vector<Foo>> m = g(1, 2)) const noexcept(true)": ("void", "f", ["int a", "map<string, vector<Foo>> m = g(1, 2)"]),
        "Foo & operator()(int)": ("Foo &", "operator()", ["int"]), "bool operator==(const X &)": ("bool", "operator==", ["const X &"]), "~X()": ("", "~X", []), "X(X &&)": ("", "X", ["X &&"]),
        "function<void(A)> on(function<void(B)> b)": ("function<void(A)>", "on", ["function<void(B)> b"]), "plain": ("", "plain", []), "": ("", "", []),
    }
    assert [tuple(x) for x in values(spark, cases, signatures.signature_parts)] == list(cases.values())
    rows = spark.createDataFrame([("method", "int", "f", [("A *", "a"), ("B", "")], "X"), ("constructor", "void", "X", [], "X"), ("destructor", "void", "~X", [], "X"), ("destructor", "void", "X", [], "X"), ("destructor", None, None, [], None), ("method", "", "g", [], None)], "kind string, returns string, name string, params array<struct<type:string,name:string>>, parent string")
    assert [r[0] for r in rows.select(signatures.rendered(*(F.col(c) for c in rows.columns))).collect()] == ["int f(A * a, B)", "X()", "~X()", "~X()", "~()", "void g()"]


def test_used_types_are_told_once_and_in_order(spark):
    cases = {
        "Foo f(const Foo & a, Bar * b, int c, std::string d, Bar e)": ["Foo", "Bar"], "static const Foo * f()": ["Foo"], "void f(unsigned int)": ["unsigned int"], "X(const ::ns::Y &)": ["ns::Y"],
        "map<string, vector<Foo>> f(function<void(A, B)> g)": ["function<void(A, B)>", "map<string, vector<Foo>>"], "~X()": [], "void f(...)": ["..."],
    }
    assert values(spark, cases, signatures.used_types) == list(cases.values())


def test_first_of_equal_dependencies_stays(spark):
    dep = [("A", "agg", "1..*"), ("A", "agg", None), ("", "x", None), ("int", "x", None), ("A", "comp", None), ("Me", "x", None), (None, "x", None), ("A", "agg", "2")]
    rows = spark.createDataFrame([(dep, "Me")], "d array<struct<target:string,type:string,cardinality:string>>, own string")
    assert [tuple(x) for x in rows.select(signatures.dependencies(F.col("d"), F.col("own"))).first()[0]] == [("A", "agg", "1..*"), ("A", "comp", None)]


def test_nested_fields(spark):
    cases = {
        "map<string, vector<Foo>>": ("Foo", "aggregation", "1..*"), "vector<vector<map<int, Foo>>>": ("Foo", "aggregation", "1..*"), "std::function<void(A, B)>": None, "function<void(A, B)>": ("function<void(A, B)>", "composition", None),
        "unique_ptr<Foo>": ("Foo", "composition", None), "std::shared_ptr<const Foo>": None, "shared_ptr<Foo>": ("Foo", "aggregation", None), "Foo *": ("Foo", "aggregation", None), "int": None, "Foo": ("Foo", "composition", None), "map<int, int>": None,
    }
    got = values(spark, cases, extraction.field_dependency)
    assert [x and tuple(x) for x in got] == list(cases.values())


@pytest.mark.parametrize("chain", [1, 2, 7, 33])
def test_alias_chains_end_and_cycles_do_not(spark, chain):
    rows = [(f"A{i}", f"const ns::A{i + 1} &" if False else f"A{i + 1}") for i in range(chain)] + [(f"A{chain}", "std::unique_ptr<ns::Foo>"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("me", "me"), ("v", "vector<v>"), ("p", "Bar *"), ("", "q"), ("dup", "B"), ("dup", "A0")]
    got = {r["alias"]: r["canonical"] for r in aliases.resolved(spark.createDataFrame(rows, "alias string, canonical string")).collect()}
    want = {f"A{i}": "std::unique_ptr<ns::Foo>" for i in range(chain + 1)} | {"x": None, "y": None, "z": None, "w": None, "me": None, "v": "vector<v>", "p": "Bar *", "dup": "std::unique_ptr<ns::Foo>"}
    assert got == want
    fields = spark.createDataFrame([("A0",), ("const A0 &",), ("x *",), ("p",), ("Foo<A0>",), (None,)], "type string")
    found = {r["type"]: (r["alias"], r["dep"] and tuple(r["dep"])) for r in aliases.field_dependencies(fields, spark.createDataFrame(rows, "alias string, canonical string")).collect()}
    assert found["A0"] == ("A0", ("ns::Foo", "composition", None)) and found["const A0 &"] == found["A0"]
    assert found["x *"] == (None, ("x", "aggregation", None)) and found["p"] == (None, ("p", "composition", None)) and found[None] == (None, None)


def test_exclusion_of_slashes(spark):
    cases = [("a/build/x.c", ["build"], True), ("a/build/x.c", ["build/"], True), ("a\\build\\x.c", ["build"], True), ("src/gen/x.c", ["src\\gen\\*.c"], True), ("third/x.c", ["third/**"], True)]
    for path, patterns, want in cases:
        assert values(spark, [path], lambda p, patterns=patterns: filters.excluded(p, patterns)) == [want]


def test_free_functions_become_entries(spark):
    from graphloom.operators import free_functions

    rows = [
        (1, "/s/a.cpp", "", "main", "int main()", 3, []), (2, "/s/b.cpp", "", "main", "int main()", 4, ["X"]), (3, "/s/a.cpp", None, "go", "void go(Foo)", 5, ["Foo", "Bar"]), (4, "/s/a.cpp", "", "go", "void go(Foo)", 9, ["Baz"]),
        (5, "/s/a.cpp", "n::m", "parse_it", "int parse_it()", 6, []), (6, "/t/c.d.h", "n::m", "helper", "int helper()", 7, ["Bar"]), (7, "/t/c.d.h", "", "raid", "int raid(Foo)", 8, ["Foo"]),
    ]
    df = spark.createDataFrame(rows, "ord int, file string, namespace string, name string, signature string, line int, param_types array<string>")
    out = free_functions.synthetic(df)
    got = {r["key"]: tuple(r)[1:] for r in out.entries.collect()}
    assert got == {
        "__entrypoint__/s/a.cpp": ("main@a", "", "/s/a.cpp", 3, "Program Entry Point"), "__entrypoint__/s/b.cpp": ("main@b", "", "/s/b.cpp", 4, "Program Entry Point"),
        "__file__/s/a.cpp": ("a", "", "/s/a.cpp", 5, "Free Functions"), "n::m": ("n::m", "n::m", "/s/a.cpp", 6, "Utility Helpers"), "__file__/t/c.d.h": ("c.d", "", "/t/c.d.h", 8, "Storage / IO Helpers"),
    }
    assert sorted(tuple(r) for r in out.methods.filter("key = '__file__/s/a.cpp' OR key = 'n::m'").collect()) == [("__file__/s/a.cpp", 1, "void go(Foo)", 5), ("n::m", 1, "int parse_it()", 6), ("n::m", 2, "int helper()", 7)]
    assert sorted(tuple(r)[1:3] for r in out.dependencies.filter("key = '__file__/s/a.cpp'").collect()) == [(1, "Foo"), (2, "Bar"), (3, "Baz")]
    w = spark.createDataFrame([("unary", 3, None, True), ("assignment", 0, None, True), ("assignment", 1, None, False), ("compound", 0, "x", True), ("member", 0, "push_back", True), ("member", 0, "size", False), (None, 0, "clear", False), ("member", 0, None, False)], "p string, o int, m string, want boolean")
    assert all(r[0] == r[1] for r in w.select(free_functions.is_write(F.col("p"), F.col("o"), F.col("m")), "want").collect())
    a = spark.createDataFrame([("ioctl", ["fd", "CMD"], "ioctl @ CMD"), ("ioctl", ["fd"], None), ("open", ["a", "b"], None), ("mmap", ["a", ""], None), ("fcntl", None, None)], "f string, a array<string>, want string")
    assert [r[0] for r in a.select(free_functions.annotation(F.col("f"), F.col("a"))).collect()] == [r["want"] for r in a.collect()]
