"""Scripts of corrections, read from YAML and folded over lines: hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions.edits import run_script
from lodestone.sources.tables import read_ops

LINES = ["@startuml", "class Order {", "  total : Money", "}", 'Order "1 sold" *-- "0..*" Line : has >', "Order -- Line", 'Order "1" -- "1" Order : twin', " @EndUml"]


def run(spark, *ops, lines=LINES):
    df = spark.createDataFrame([(lines, [dict(o) for o in ops])], "lines array<string>, ops array<map<string,string>>")
    r = df.select(run_script(F.col("lines"), F.col("ops")).alias("x")).first().x
    return r.lines, r.applied, r.error


def edited(old, new):
    return [new if x == old else x for x in LINES]


ENDS = {"class_a": "Line", "class_b": "Order"}
CASES = [
    ({"type": "rename_token", "from": "Order", "to": r"A$1\b"}, [x.replace("Order", r"A$1\b") for x in LINES]),
    ({"type": "rename_token", "from": "Ord", "to": "x"}, "rename_token: Ord not found"),
    ({"type": "rename_token", "to": "x"}, "rename_token:  not found"),
    ({"type": "remove_line", "match": " }  "}, [x for x in LINES if x != "}"]),
    ({"type": "remove_line", "match": "{"}, "remove_line: { not found"),
    ({"type": "replace_line", "match": "total : Money", "replacement": "  sum : Money"}, edited("  total : Money", "  sum : Money")),
    ({"type": "change_edge_type", **ENDS, "label": "has", "new_type": "aggregation", "container": "Line"}, edited(LINES[4], 'Order "1 sold" --o "0..*" Line : has')),
    ({"type": "change_edge_type", **ENDS, "label": "has", "new_type": "composition", "container": "Z"}, "change_edge_type: no arrow for composition"),
    ({"type": "change_edge_type", **ENDS, "new_type": "dependency"}, edited(LINES[5], 'Order "" ..> "" Line')),
    ({"type": "change_edge_type", **ENDS, "label": "had", "new_type": "dependency"}, "change_edge_type: Line Order found 0 times"),
    ({"type": "remove_label", **ENDS, "label": "has"}, edited(LINES[4], 'Order "1 sold" *-- "0..*" Line')),
    ({"type": "set_role", **ENDS, "label": "has", "endpoint_mult": "0..*", "role": "parts"}, edited(LINES[4], 'Order "1 sold" *-- "0..* parts" Line : has')),
    ({"type": "set_role", "class_a": "Order", "class_b": "Order", "label": "twin", "endpoint_mult": "1", "role": "r"}, "set_role: 1 isn't at one end"),
    ({"type": "add_line", "line": " A -- B "}, [*LINES[:-1], "A -- B", LINES[-1]]),
    ({"type": "add_line", "line": "Order -- Line"}, "add_line: Order -- Line is there already"),
    ({"type": "add_block", "block": "enum E {\n  X  \n}\n"}, [*LINES[:-1], "enum E {", "  X", "}", "", LINES[-1]]),
    ({"type": "add_block", "block": "class Order {\n}"}, "add_block: Order is there already"),
    ({"type": "add_block", "block": "class A {\n}\nclass B {\n}"}, "add_block: not one declaration"),
    ({"type": "turn"}, "turn: unknown type"),
]


@pytest.mark.parametrize("op,want", CASES)
def test_one_edit(spark, op, want):
    assert run(spark, op) == ((LINES, 0, want) if isinstance(want, str) else (want, 1, ""))


def test_a_script_from_a_file_stops_at_its_first_error(spark, tmp_path):
    (tmp_path / "d.yaml").write_text("- type: rename_token\n  from: Line\n  to: Item\n- type: remove_line\n  match: Order -- Item\n- type: remove_line\n  match: Order -- Line\n- type: add_line\n  line: never\n")
    script = read_ops(spark, str(tmp_path / "*.yaml")).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.to_json("op").alias("op")))), lambda x: F.from_json(x["op"], "map<string,string>")).alias("ops"))
    got = script.select(run_script(F.array(*map(F.lit, LINES)), F.col("ops")).alias("x")).first().x
    assert (got.lines, got.applied, got.error) == ([x.replace("Line", "Item") for x in LINES if x != "Order -- Line"], 2, "remove_line: Order -- Line not found")


def test_nothing_to_edit(spark):
    df = spark.createDataFrame([(1, None, None), (2, [], [{"type": "add_line", "line": "a"}]), (3, ["x"], [])], "k int, lines array<string>, ops array<map<string,string>>")
    got = {r.k: (r.x.lines, r.x.applied, r.x.error) for r in df.select("k", run_script(F.col("lines"), F.col("ops")).alias("x")).collect()}
    assert got == {1: ([], 0, ""), 2: (["a"], 1, ""), 3: (["x"], 0, "")}
