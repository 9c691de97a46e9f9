"""Reader of compact class diagrams, ``{"classes": [...], "relations": [...]}``, that keeps what fits the format and names each thing that doesn't.

Records are VARIANT; classes and relations become rows, what is wrong with one is an array of issues beside it.  A relation's keys depend on its family, which a table gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.retrieval import held
from .responses import decoded, once

# Kinds of classes, the keys of a class, the edge type and family of each relation type, and each family's keys by the field that they fill (ends first).
KINDS = ["class", "abstract class", "enum", "interface"]
CLASS_KEYS = ["name", "kind", "attributes", "methods", "values"]
TYPES = {
    "association": ("ClassBidirectional", "source_target"), "unidirectional": ("ClassUnidirectional", "source_target"), "dependency": ("ClassDependency", "source_target"), "composition": ("ClassComposition", "whole_part"),
    "aggregation": ("ClassAggregation", "whole_part"), "inheritance": ("ClassInheritance", "child_parent"), "realization": ("ClassRealization", "child_parent"),
}
FIELDS = ("source", "target", "label", "source_mult", "target_mult", "source_role", "target_role")
FAMILIES = {
    "source_target": ("source", "target", "label", "sourceMultiplicity", "targetMultiplicity", "sourceRole", "targetRole"),
    "whole_part": ("part", "whole", "label", "partMultiplicity", "wholeMultiplicity", "partRole", "wholeRole"),
    "child_parent": ("child", "parent"),
}
KNOWN = sorted({k for keys in FAMILIES.values() for k in keys})


def _type(x: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(x), r"^\w+", 0), F.lit(""))


def _issue(when: Column, category: str | Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.array(category if isinstance(category, Column) else F.lit(category))).otherwise(F.array().cast("array<string>"))


def _times(names: Column, category: str) -> Column:
    """One issue for each of an array."""
    return F.transform(names, lambda n: F.lit(category))


def _map(x: Column) -> Column:
    """An object's values by key; null for anything else."""
    return F.try_variant_get(x, "$", "map<string,variant>")


def _list(x: Column) -> Column:
    return F.try_variant_get(x, "$", "array<variant>")


def _word(x: Column) -> Column:
    """Type and text of a value, its type empty where there is none."""
    return F.struct(_type(x).alias("kind"), F.try_variant_get(x, "$", "string").alias("text"))


def _empty(w: Column) -> Column:
    """Missing, null, or an empty text."""
    return w["kind"].isin("", "VOID") | ((w["kind"] == "STRING") & (w["text"] == ""))


def _texts(x: Column) -> Column:
    """The elements of a list that are texts with something in them, null for the others; whether there is a list, and whether something else stands in its place."""
    good = lambda e: once(_word(e), lambda w: F.when((w["kind"] == "STRING") & (F.trim(w["text"]) != ""), w["text"]))
    made = lambda l: F.struct(F.coalesce(F.transform(l, good), F.array().cast("array<string>")).alias("texts"), F.when(l.isNull(), ~_empty(_word(x))).otherwise(F.lit(False)).alias("other"))
    return once(once(_list(x), made), lambda t: F.struct(F.array_compact(t["texts"]).alias("good"), F.filter(t["texts"], lambda e: e.isNull()).alias("bad"), t["other"].alias("other")))


def _class(c: Column) -> Column:
    """(named, valid, name, kind, members, methods, keys, inner) of a class: keys and inner are its issues."""
    lists = ("attributes", "methods", "values")

    def parts(m):
        at = lambda k: F.try_element_at(m, F.lit(k))
        keys = F.filter(F.coalesce(F.map_keys(m), F.array().cast("array<string>")), lambda k: ~k.isin(CLASS_KEYS))
        return F.struct(_word(at("name")).alias("name"), _word(at("kind")).alias("kind"), _times(keys, "class key").alias("keys"), *[_texts(at(k)).alias(k) for k in lists])

    def judged(x):
        name, typ = x["name"], F.when(_empty(x["kind"]), "class").when(x["kind"]["kind"] == "STRING", x["kind"]["text"]).otherwise("?")
        return F.struct(F.coalesce((name["kind"] == "STRING") & (F.trim(name["text"]) != ""), F.lit(False)).alias("named"), name["text"].alias("name"), typ.alias("kind"), x.alias("x"))

    def whole(y):
        x, listing = y["x"], y["kind"] == "enum"
        inner = [i for k in lists for i in (_issue(x[k]["other"], f"{k} not a list"), _times(x[k]["bad"], f"element of {k}"))]
        inner += [_issue(listing & (F.size(x[k]["good"]) > 0), f"enum with {k}") for k in ("attributes", "methods")] + [_issue(~listing & (F.size(x["values"]["good"]) > 0), "values without an enum")]
        members = F.when(listing, x["values"]["good"]).otherwise(x["attributes"]["good"])
        methods = F.when(listing, F.array().cast("array<string>")).otherwise(x["methods"]["good"])
        return F.struct(y["named"], (y["named"] & y["kind"].isin(KINDS)).alias("valid"), y["name"], y["kind"], members.alias("members"), methods.alias("methods"), x["keys"].alias("keys"), F.concat(*inner).alias("inner"))

    return once(once(once(_map(c), parts), judged), whole)


def _relation(r: Column, pos: Column, names: Column) -> Column:
    """(pos, typ, FIELDS, kept, issues) of a relation; ``names`` are those of its record's classes."""
    table = lambda rows: F.create_map(*[F.lit(x) if isinstance(x, str) else x for p in rows for x in p])

    def begun(m):
        rel = once(_word(F.try_element_at(m, F.lit("type"))), lambda w: F.when(w["kind"] == "STRING", w["text"]))
        return once(rel, lambda t: F.struct(m.alias("m"), t.alias("rel"), F.try_element_at(table([(k, f) for k, (_, f) in TYPES.items()]), t).alias("family")))

    def read(x):
        own = F.try_element_at(table([(k, F.array(*map(F.lit, v))) for k, v in FAMILIES.items()]), x["family"])
        part = lambda k: _word(F.try_element_at(x["m"], k))
        others = F.filter(F.map_keys(x["m"]), lambda k: (k != "type") & ~F.array_contains(own, k) & ~(k.isin(KNOWN) & _empty(part(k))))
        return F.struct(x["rel"], x["family"], F.transform(own, part).alias("f"), others.alias("others"))

    def ended(x):
        at = lambda i: F.get(x["f"], F.lit(i))
        end = lambda i: F.when(at(i)["kind"] == "STRING", F.nullif(at(i)["text"], F.lit("")))
        values = [F.coalesce(F.when(at(i)["kind"] == "STRING", at(i)["text"]), F.lit("")).alias(n) for i, n in enumerate(FIELDS) if i > 1]
        odd = _times(F.filter(F.slice(x["f"], 3, len(FIELDS)), lambda p: ~p["kind"].isin("", "VOID", "STRING")), "value not text")
        return F.struct(x["rel"], x["family"], x["others"], end(0).alias("source"), end(1).alias("target"), *values, odd.alias("odd"))

    def judged(x):
        declared = F.array_contains(names, x["source"]) & F.array_contains(names, x["target"])
        return F.struct(x.alias("x"), (x["source"].isNotNull() & x["target"].isNotNull()).alias("ends"), F.coalesce(declared, F.lit(False)).alias("declared"))

    def whole(y):
        x = y["x"]
        keys = _times(x["others"], "relation key")
        issues = (
            F.when(x["family"].isNull(), F.array(F.lit("relation type"))).when(~y["ends"], F.array(F.when(F.exists(x["others"], lambda k: k.isin(KNOWN)), "ends of another family").otherwise("end missing")))
            .when(~y["declared"], F.concat(keys, F.array(F.lit("undeclared class")))).otherwise(F.concat(keys, x["odd"]))
        )
        edge = F.try_element_at(table([(k, t) for k, (t, _) in TYPES.items()]), x["rel"])
        return F.struct(pos.alias("pos"), edge.alias("typ"), *[x[n] for n in FIELDS], (x["family"].isNotNull() & y["ends"] & y["declared"]).alias("kept"), issues.alias("issues"))

    return once(once(once(once(once(_map(r), begun), read), ended), judged), whole)


def judged_records(records: DataFrame) -> DataFrame:
    """(id, issues, classes, relations) of ``records`` (id, t), a row each: issues of the record itself; classes (pos, name, kind, members, methods, kept, issues) and relations (pos, typ, FIELDS, kept, issues) as arrays.

    Each step is a column of its own, made once; nothing is shuffled, as all that a class or relation is judged by is in its record.  A record's row, and a name's first place, are found within it."""
    m, c, names = F.col("m"), F.col("c"), F.col("names")
    x = records.select("id", decoded(F.coalesce("t", F.lit(""))).alias("v")).withColumn("m", _map(F.col("v")))
    x = x.withColumns({"cs": _list(F.try_element_at(m, F.lit("classes"))), "rs": F.try_element_at(m, F.lit("relations"))})
    loose = _list(F.col("rs")).isNull() & ~_empty(_word(F.col("rs")))
    extra = _times(F.filter(F.map_keys(m), lambda k: ~k.isin("classes", "relations")), "top-level key")
    top = F.when(F.col("cs").isNull(), F.array(F.lit("no class list"))).otherwise(_issue(loose, "relations not a list"))
    x = x.withColumn("issues", F.when(F.col("v").isNull(), F.array(F.lit("not json"))).when(m.isNull(), F.array(F.lit("not an object"))).otherwise(F.concat(extra, top)))
    x = x.select("id", "issues", F.transform("cs", _class).alias("c"), F.when(F.col("cs").isNotNull(), _list(F.col("rs"))).alias("rs"))
    x = x.withColumn("names", F.transform(c, lambda k: F.when(k["valid"], k["name"])))

    def judged(k, i):
        kept = k["valid"] & (F.array_position(names, k["name"]) == i + 1)
        issues = (
            F.when(~k["named"], F.array(F.lit("class without a name"))).when(~k["valid"], F.concat(k["keys"], F.array(F.lit("class kind"))))
            .when(~kept, F.concat(k["keys"], F.array(F.lit("class repeated")))).otherwise(F.concat(k["keys"], k["inner"]))
        )
        return F.struct(i.alias("pos"), k["name"], k["kind"], k["members"], k["methods"], F.coalesce(kept, F.lit(False)).alias("kept"), issues.alias("issues"))

    return x.select("id", "issues", F.transform(c, judged).alias("classes"), F.transform("rs", lambda r, i: _relation(r, i, names)).alias("relations"))


def read_compact(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, relations, issues) of ``records`` (id, t).

    classes: id, pos, name, kind, members, methods.  relations: id, pos, typ and FIELDS, directed as the edge types are.  issues: id, part (record, class or relation), pos, issue.  Places count from 0 within their list.  A record that is
    no JSON object or has no list of classes gives an issue alone; keys that are there but empty are no issue."""
    x = judged_records(records)
    rows = lambda k: x.select("id", F.explode(k).alias("x")).select("id", "x.*").where("kept")
    issues = x.select("id", F.explode(issue_rows()).alias("x")).select("id", "x.*")
    return rows("classes").select("id", "pos", "name", "kind", "members", "methods"), rows("relations").select("id", "pos", "typ", *FIELDS), issues


def issue_rows() -> Column:
    """(part, pos, issue) of all issues of a judged record."""
    one = lambda part, pos: lambda i: F.struct(F.lit(part).alias("part"), pos.alias("pos"), i.alias("issue"))
    each = lambda part, k: F.flatten(F.transform(k, lambda x: F.transform(x["issues"], one(part, x["pos"]))))
    lists = F.array(F.transform("issues", one("record", F.lit(0))), each("class", "classes"), each("relation", "relations"))
    return F.flatten(F.array_compact(lists))


def _inside(x: Column) -> Column:
    """(key as a path tells it, value) of what an object or array holds; null for anything else."""
    named = F.transform(F.map_entries(_map(x)), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("k"), e["value"].alias("v")))
    placed = F.transform(_list(x), lambda y, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("k"), y.alias("v")))
    return F.coalesce(named, placed)


def _sign(x: Column, text: Column) -> Column:
    """What a value is compared by before what it holds: a scalar's ``text``, an object's sign, an array's sign and length."""
    return F.when(text.startswith("{"), "{}").when(text.startswith("["), F.concat(F.lit("[] "), F.size(_list(x)).cast("string"))).otherwise(text)


def json_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, path, change) where records (id, v: VARIANT) of equal id differ: added, removed or changed (another value, type or length).

    Below a path that only one side has, or where a type or an array's length differs, nothing more is told.  Records meet once; each level of nesting is then a step of both sides together, of which only what differs in text and is
    alike in type and length goes on, and the last is the one where nothing does."""
    side = lambda df, k: df.select("id", F.struct("v").alias(k))
    at = side(a, "a").join(side(b, "b"), "id", "full").select("id", F.lit("$").alias("path"), "a", "b")
    one, two = F.col("a.v"), F.col("b.v")
    out = None
    while True:
        at = at.withColumns({"s": F.coalesce(F.to_json(one), F.lit("null")), "t": F.coalesce(F.to_json(two), F.lit("null"))}).where("a is null or b is null or s <> t")
        change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(_sign(one, F.col("s")) != _sign(two, F.col("t")), "changed")
        at = held(at.withColumn("change", change).drop("s", "t"))
        here = at.where("change is not null").select("id", "path", "change")
        out = here if out is None else out.unionByName(here)
        deep = at.where("change is null")
        if deep.isEmpty():
            return out
        keyed = lambda v: F.map_from_entries(F.transform(F.coalesce(_inside(v), F.array().cast("array<struct<k:string,v:variant>>")), lambda e: F.struct(e["k"], F.struct(e["v"].alias("v")))))
        pairs = deep.select("id", "path", keyed(one).alias("l"), keyed(two).alias("r"))
        pairs = pairs.select("id", "path", "l", "r", F.explode(F.array_union(F.map_keys("l"), F.map_keys("r"))).alias("k"))
        at = pairs.select("id", F.concat("path", "k").alias("path"), F.try_element_at("l", F.col("k")).alias("a"), F.try_element_at("r", F.col("k")).alias("b"))
