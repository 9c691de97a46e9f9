"""Cases of the findings of round 3 that tell how queries grow."""

import json
import random

from pyspark.sql import functions as F

from lodestone.functions import compact as C
from lodestone.functions import responses as A
from lodestone.functions import tokens
from lodestone.plans import registry

from .conftest import TINY


def plan(spark, name, d=TINY):
    return registry.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()


def test_levels_decode_once(spark):
    """rows are dealt to all cores, and a response is decoded for the whole text, its fences, its spans and the level, not for each check."""
    p = plan(spark, "level_ladder")
    assert "RoundRobinPartitioning" in p and p.count("parseJson(") <= 8


def test_levels_of_odd_diagrams(spark):
    node = lambda **k: {"id": "n", "data": {"name": "N"}, **k}
    edge = lambda **k: {"id": "e", "source": "n", "target": "n", "data": {}, **k}
    whole = lambda nodes, edges, **k: json.dumps({"version": "4", "type": "T", "nodes": nodes, "edges": edges, **k})
    part = lambda k, *names: node(data={"name": "N", k: [{"id": f"p{i}", "name": n} for i, n in enumerate(names)]})
    cases = [
        (None, -1, "no_json", 0), ("{", 0, "invalid_json", 0), ("[1]", 0, "not_object", 0), ("1", 0, "not_object", 0), ("{} 7", 0, "invalid_json", 0), ("{}", 1, "schema", 0), (whole([], []), 4, "", 0),
        (whole([], [], type=3), 1, "schema", 0), (whole({}, []), 1, "schema", 0), (whole([7], []), 1, "schema", 0), (whole([None], []), 1, "schema", 0), (whole([node(id=7)], []), 1, "schema", 0),
        (whole([node(data=[])], []), 1, "schema", 0), (whole([node(data={"name": "N", "methods": None})], []), 1, "schema", 0), (whole([node(data={"name": "N", "methods": [7]})], []), 1, "schema", 0),
        (whole([node()], [edge(data=None)]), 1, "schema", 0), (whole([node()], [edge(data=[])]), 1, "schema", 0), (whole([node()], [edge()]), 4, "", 0), (whole([node(), node()], []), 2, "integrity", 0),
        (whole([node(width=0)], []), 2, "integrity", 0), (whole([node(width="x", height=None)], []), 4, "", 0), (whole([node()], [edge(data={"points": [1]})]), 2, "integrity", 0), (whole([node()], [edge(data={"points": "a"})]), 4, "", 0),
        (whole([node()], [edge(source="m")]), 2, "integrity", 0), (whole([part("attributes", "+ a : int", "+ b : N[] = 1", "+ c")], []), 4, "", 0), (whole([part("attributes", "+ a : M")], []), 3, "style", 0),
        (whole([part("methods", "run()", "+ go()")], [edge(data={"sourceMultiplicity": "1..n", "targetMultiplicity": None})]), 4, "", 2), (whole([part("methods", "run()", "stop")], []), 3, "style", 1),
        (whole([node()], [edge(data={"sourceMultiplicity": "2..n"})]), 3, "style", 0),
    ]
    x = spark.createDataFrame([(i, "", c[0], False) for i, c in enumerate(cases)], "i int, t string, json string, cut_off boolean")
    got = {r.i: (r.lvl, r.failure, r.rewrites) for r in A.levels(x).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1:] for c in cases]
    cut = A.levels(x.limit(2).withColumn("cut_off", F.lit(True))).collect()
    assert {(r.lvl, r.failure) for r in cut} == {(-1, "truncated"), (0, "truncated")}


def test_compact_records_stay_whole(spark):
    """a record is read in its own row: dealt to all cores, and neither shuffled by names nor joined back."""
    p = plan(spark, "compact_read")
    assert p.count("Exchange") == p.count("Exchange RoundRobinPartitioning") == 1 and "Join" not in p and "Window" not in p and p.count("Scan parquet") == 1


def test_compact_records_of_odd_kinds(spark):
    rows = [
        (0, None), (1, "[]"), (2, '{"classes":[]}'), (3, '{"classes":{},"x":1}'), (4, '{"classes":[null,{"name":"A"},{"name":"A","kind":"bad"},{"name":"A","kind":""},{"name":"A "}],"relations":""}'),
        (5, '{"classes":[{"name":"A","methods":["m",""," ",1],"z":1}],"relations":[null,[],{"type":"association","source":"A","target":"A","label":7},{"type":7},{"type":"inheritance","child":"A","parent":"","whole":"A"}]}'),
    ]
    classes, relations, issues = C.read_compact(spark.createDataFrame(rows, "id int, t string"))
    assert {(r.id, r.pos, r.name, r.kind, *r.members, "/", *r.methods) for r in classes.collect()} == {(4, 1, "A", "class", "/"), (4, 4, "A ", "class", "/"), (5, 0, "A", "class", "/", "m")}
    assert [tuple(r) for r in relations.collect()] == [(5, 2, "ClassBidirectional", "A", "A", "", "", "", "", "")]
    want = [
        (0, "record", 0, "not json"), (1, "record", 0, "not an object"), (3, "record", 0, "no class list"), (3, "record", 0, "top-level key"), (4, "class", 0, "class without a name"), (4, "class", 2, "class kind"), (4, "class", 3, "class repeated"),
        *[(5, "class", 0, i) for i in ("class key", "element of methods", "element of methods", "element of methods")], (5, "relation", 0, "relation type"), (5, "relation", 1, "relation type"), (5, "relation", 2, "value not text"),
        (5, "relation", 3, "relation type"), (5, "relation", 4, "ends of another family"),
    ]
    assert sorted(tuple(r) for r in issues.collect()) == sorted(want)


def test_differences_meet_once(spark):
    """both sides go down together from one join of records: a key with a dot is a key of its own, what is equal is left, and nothing is told below a change."""
    cases = [
        ('{"a":{"b":1},"a.b":1}', '{"a":{"b":2},"a.b":3}', {("$.a.b", "changed"), ("$.a.b", "changed")}), ('{"a":[1,{"x":null}]}', '{"a":[2,{}]}', {("$.a[0]", "changed"), ("$.a[1].x", "removed")}), ('{"a":[]}', '{"a":{}}', {("$.a", "changed")}),
        ("1", "1", set()), ("null", None, set()), ("[1]", "[1,2]", {("$", "changed")}), ('{"k":{"x":[1,2]}}', '{"k":7,"n":{"y":1}}', {("$.k", "changed"), ("$.n", "added")}), ('"{"', '"["', {("$", "changed")}), ('{"":{"é":"1"}}', '{"":{"é":1}}', {("$..é", "changed")}),
    ]
    side = lambda k: spark.createDataFrame([(i, c[k]) for i, c in enumerate(cases)] + [(100 + k, "[1]")], "id int, t string").select("id", F.parse_json("t").alias("v"))
    d = C.json_diff(side(0), side(1))
    got = sorted(tuple(r) for r in d.collect())
    assert got == sorted([(i, *x) for i, c in enumerate(cases) for x in c[2]] + [(0, "$.a.b", "changed")] + [(100, "$", "removed"), (101, "$", "added")])


def test_words_are_encoded_once(spark, monkeypatch):
    """rows are dealt to all cores, and a word that is known isn't encoded again; counts are those of whole texts."""
    assert "RoundRobinPartitioning" in plan(spark, "bpe_tokens")
    r = random.Random(5)
    texts = ["".join(r.choice(["a", "B", "don't", " ", " ", "\n", "\t", "7", "42", ".", ", ", "é", "漢", " ", " ", "'s", "🙂", "<|endoftext|>" if r.random() < 0.05 else "x"]) for _ in range(r.randrange(40))) for _ in range(3000)]
    texts += ["", " ", "a ", " a", "a  b", "a \nb", "a\n b", "one two", "it 's", "a " * 5000]
    counts = tokens.Counts(None)
    want = [len(e) for e in counts.encoder.encode_batch(texts, add_special_tokens=False)]
    assert counts(texts) == want
    sent = []
    monkeypatch.setattr(counts, "_encoded", lambda x: sent.extend(x) or [1] * len(x))
    counts(["one two", "one two two"])
    assert sent == ["one", "one"]


def test_elements_meet_by_shuffles(spark):
    """nothing that grows with the diagrams is sent to all tasks by way of the driver."""
    p = plan(spark, "element_levels")
    assert "Broadcast" not in p
