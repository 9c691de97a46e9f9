"""Folders of diagrams as a source and sink, and the reader of their lines, on hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import diagrams as D
from lodestone.sources import diagrams

TEXT = """@startuml
class Order <<entity>> {
  - total : Money = 0
  int lines {frozen}
  + pay(x) : bool
}
enum State <<enum>> {
OPEN
DONE (late)
}
class Old {
  a : int
}
note "said" as N1
N1 .. Order
N1 .. (Order, State)
N2 .. (Order, State)
(Order , Buyer) . Sale
note right of Order as N2
Order "1 {ordered} lines" *-- "0..*" Line : has >
Buyer <|-- Company
class Old <<interface>> {
  b : int
}
abstract  class Shape {}
what is this
@enduml"""


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def read(spark, *texts):
    lines = [(k, i, t) for k, x in enumerate(texts) for i, t in enumerate(x.splitlines(), 1)]
    return D.read(spark.createDataFrame(lines, "doc long, i int, t string"))


def test_a_diagram_line_by_line(spark):
    got = read(spark, TEXT)
    assert rows(got["classes"], "name", "kind") == [("Buyer", "implicit"), ("Company", "implicit"), ("Line", "implicit"), ("N2", "implicit"), ("Old", "interface"), ("Order", "class"), ("Sale", "implicit"), ("Shape", "abstract class"), ("State", "enum")]
    assert rows(got["members"], "owner", "kind", "name", "typ") == [
        ("Old", "attribute", "b", "int"), ("Order", "attribute", "lines", "int"), ("Order", "attribute", "total", "Money"), ("Order", "method", "+ pay(x) : bool", ""), ("State", "value", "DONE (late)", ""), ("State", "value", "OPEN", ""),
    ]
    # a note counts from its line on: N2 is an association class above it
    assert rows(got["relations"], "i", "typ", "source", "target", "source_mult", "target_mult", "source_role", "target_role", "label") == [
        (17, "association class", "Order", "State", "", "", "", "", "N2"), (18, "association class", "Order", "Buyer", "", "", "", "", "Sale"),
        (20, "ClassComposition", "Line", "Order", "0..*", "1", "", "lines", "has"), (21, "ClassInheritance", "Company", "Buyer", "", "", "", "", ""),
    ]
    want = {("stereotype", "entity", 2), ("note on class", "N1", 15), ("note on pair", "N1", 16), ("end constraint", "{ordered}", 20), ("unknown line", "what is this", 26)} | {("implicit class", n, None) for n in ("Buyer", "Company", "Line", "N2", "Sale")}
    assert {(r.issue, r.subject, r.i) for r in got["issues"].collect()} == want


def test_a_diamond_makes_a_diagram_unsupported(spark):
    got = read(spark, "<> d\nA -- B", "A -- B", "", "class X {\nnote as <> y\n<> z")
    assert rows(got["classes"], "doc", "name", "kind") == [(1, "A", "implicit"), (1, "B", "implicit"), (3, "X", "class")]
    assert rows(got["relations"], "doc", "source", "target") == [(0, "A", "B"), (1, "A", "B")]
    assert rows(got["issues"].where("issue = 'unsupported'"), "doc", "i", "subject") == [(0, 1, "d")]
    assert got["members"].count() == 2  # inside a block each line is a member


def test_lines_that_are_null_or_missing(spark):
    got = D.read(spark.createDataFrame([(1, 1, None), (1, 2, "\t class A {} \r"), (1, 3, "  ")], "doc long, i int, t string"))
    assert {k: v.count() for k, v in got.items()} == {"classes": 1, "members": 0, "relations": 0, "issues": 0}
    assert all(v.count() == 0 for v in D.read(spark.createDataFrame([], "doc long, i int, t string")).values())


@pytest.mark.parametrize("files", [1, 2, 200])
def test_folders_are_written_and_read(spark, tmp_path, files):
    diagrams.register(spark)
    texts = [("b", f"d{k}.puml", f"class A{k}\n\nclass é{k}") for k in range(5)] + [("a", "x.plantuml", TEXT), ("a", "empty.puml", None), ("a", "notes.md", "no"), ("_images", "y.puml", "no")]
    frame = spark.createDataFrame(texts, "folder string, name string, text string").repartition(3)
    for _ in range(2):  # a second run leaves the same files
        frame.write.format("diagrams").mode("append").save(str(tmp_path))
    (tmp_path / "stray.puml").write_text("not in a folder")
    (tmp_path / "b" / "_staged").write_text("left by a task that was lost")
    lines = spark.read.format("diagrams").option("files", files).load(str(tmp_path))
    assert {p.name for p in tmp_path.glob("*/*")} >= {n for _, n, _ in texts}
    want = {(f, n, i, t) for f, n, x in texts if not f.startswith("_") and not n.endswith(".md") for i, t in enumerate((x or "").splitlines(), 1)}
    got = [tuple(r) for r in lines.collect()]
    assert len(got) == len(want) and set(got) == want
    assert lines.rdd.getNumPartitions() == {1: 7, 2: 4, 200: 2}[files]


def test_names_that_leave_their_folder_and_empty_roots(spark, tmp_path):
    diagrams.register(spark)
    assert spark.read.format("diagrams").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="not the name of a folder"):
        spark.createDataFrame([("a", "../x.puml", "")], "folder string, name string, text string").write.format("diagrams").mode("append").save(str(tmp_path))
    long = spark.createDataFrame([("a", "long.puml", 1)], "folder string, name string, k int").select("folder", "name", F.repeat(F.lit("class A\n"), 20000).alias("text"))
    long.write.format("diagrams").mode("append").save(str(tmp_path))
    assert spark.read.format("diagrams").load(str(tmp_path)).agg(F.max("i"), F.count("t")).first() == (20000, 20000)
