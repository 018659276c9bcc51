"""Diagrams as documents against plain string building."""

import re

from pyspark.sql import functions as F

from graphloom.operators import documents
from graphloom.sources import files

ENTRY = "document string, ord long, name string, namespace string, template_params array<string>, attributes array<string>, interfaces array<string>, deps array<struct<target:string,type:string,cardinality:string>>"
ROWS = [
    ("m", 1, "Disk", "io", ["T"], [f"+int a{i}" for i in range(14)], ["void read(int a, int b, int c)", "vector<int> all()"], [("Pool", "composition", None), ("mem::Pool<int>", "composition", None), ("Base", "inheritance", None), ("Gone", "association", None), ("Pool", "association", "1..*")]),
    ("m", 2, "Pool", "io::mem", [], None, [f"void f{i}()" for i in range(9)], [("Disk", "dependency", None)]), ("m", 3, "Base", "", None, [], [], None),
    ("n", 1, "Pool", "x", [], [], [], [("Disk", "composition", None)]),
]
ARROWS = {"inheritance": "<|--", "composition": "*--", "aggregation": "o--", "association": "-->", "dependency": "..>"}


def plain(rows, pattern=None, namespace=None, title=None):
    shown = [r for r in rows if (not namespace or (r[3] or "").startswith(namespace)) and (not pattern or re.search(pattern, r[2], re.I))]
    if not shown:
        return ["classDiagram", '    note "No matching classes found"']
    out, relations = ["classDiagram", *([f"    title {title}"] if title else [])], []
    tilde = lambda s: s.replace("<", "~").replace(">", "~")
    labels = {"void read(int a, int b, int c)": "read(int a, int b, ...)", "vector<int> all()": "all()"}
    for _, _, name, ns, params, attributes, interfaces, deps in shown:
        out += [f"    class {name} {{", *(["        <<template>>"] if params else [])]
        out += ["        " + tilde(a) for a in (attributes or [])[:12]] + ([f"        ... {len(attributes) - 12} more fields"] if len(attributes or []) > 12 else [])
        out += ["        +" + tilde(labels.get(i, i.removeprefix("void "))) for i in interfaces[:6]] + ([f"        ... {len(interfaces) - 6} more"] if len(interfaces) > 6 else [])
        out += ["    }", *([f'    note for {name} "ns: {ns}"'] if ns else [])]
        for target, kind, card in deps or []:
            base = re.sub("<.*>", "", target).strip().split("::")[-1]
            if {base, target} & {r[2] for r in shown}:
                line = f"    {base} {ARROWS[kind]} {name}" if kind == "inheritance" else f"    {name} {ARROWS[kind]} {base} : {kind}" + (f" [{card}]" if card else "")
                relations += [line] if line not in relations else []
    return out + relations


def told(lines):
    out = {}
    for r in documents.numbered(lines).orderBy("document", "line").collect():
        out.setdefault(r["document"], []).append(r["value"])
    return out


def test_class_diagrams_of_many_documents(spark):
    entries = spark.createDataFrame(ROWS, ENTRY)
    for kw in ({}, {"title": "All"}, {"pattern": "^p"}, {"namespace": "io"}, {"pattern": "zzz", "title": "None"}, {"namespace": "io::mem", "pattern": "POOL"}):
        assert told(documents.class_diagrams(entries, **kw)) == {d: plain([r for r in ROWS if r[0] == d], **kw) for d in ("m", "n")}, kw


def test_sequence_diagrams(spark):
    calls = [("d", 1, "ns::A::f", "B::g", "x, y", None), ("d", 2, "B::g", "main", "", "int"), ("d", 3, "ns::A::f", "ns::A::" + "h" * 70, None, "r" * 80), ("e", 1, "C::f", "C::g", "", "")]
    df = spark.createDataFrame(calls, "document string, pos long, caller string, callee string, args string, returns string")
    docs = spark.createDataFrame([("d",), ("e",), ("none",)], "document string")
    got = told(documents.sequence_diagrams(df, docs, title="T"))
    assert got["d"] == [
        "sequenceDiagram", "    title T", "    participant ns__A", "    participant B", "    participant main", "", "    ns__A->>+B: g(x, y)", "    B-->>-ns__A: return",
        "    B->>+main: main()", "    main-->>-B: int", "    ns__A->>+ns__A: " + "h" * 57 + "...", "    ns__A-->>-ns__A: " + "r" * 60,
    ]
    assert got["none"] == ["sequenceDiagram", "    Note over System: No call graph data"]
    got = told(documents.sequence_diagrams(df, docs, pattern="^b$"))
    assert got["e"] == ["sequenceDiagram", "    Note over System: No matching call graph edges"] and [x for x in got["d"] if "->>+" in x] == ["    ns__A->>+B: g(x, y)", "    B->>+main: main()"]
    assert [x for x in told(documents.sequence_diagrams(df, docs, namespace="ns"))["d"] if "->>+" in x][1].startswith("    ns__A->>+ns__A")


def test_documents_are_written_in_order_whatever_their_size(spark, tmp_path):
    entries = spark.createDataFrame([("big", i, f"C{i}", "n", [], [], [], [(f"C{i - 1}", "association", None)]) for i in range(3000)] + [(r[0], *r[1:]) for r in ROWS], ENTRY)
    path = f"{tmp_path}/out"
    documents.write(documents.class_diagrams(entries), f"file://{path}", files=7)
    import pathlib

    def read(name):
        return "".join(f.read_text() for f in sorted(pathlib.Path(path, f"document={name}").glob("part-*"))).splitlines()

    assert len(list(pathlib.Path(path, "document=big").glob("part-*"))) > 1
    assert read("big") == told(documents.class_diagrams(entries.filter("document = 'big'")))["big"] and read("m") == plain([r for r in ROWS if r[0] == "m"])
    documents.write_all(spark.createDataFrame(ROWS, ENTRY), f"file://{tmp_path}/all")
    assert sorted(p.name for p in pathlib.Path(tmp_path, "all").glob("document=*")) == ["document=m.class", "document=m.sequence", "document=n.class", "document=n.sequence"]


def test_an_index_document_is_lines_in_one_file(spark, tmp_path):
    entries = spark.range(1000).select(F.col("id").alias("ordinal"), F.concat(F.lit("C"), "id").alias("className")).repartition(8)
    path = f"file://{tmp_path}/index"
    files.write_index(entries, path)
    got = files.read_index(spark, path)
    assert [r["className"] for r in got.orderBy("ordinal").collect()] == [f"C{i}" for i in range(1000)]
    files.write_index(entries.limit(0), f"{path}0")
    assert files.read_index(spark, f"{path}0").isEmpty()
