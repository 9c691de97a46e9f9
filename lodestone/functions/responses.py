"""What a response holds: its JSON, and how far that is a good diagram.  Everything but the brace scanner is columns over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import braces

# The signs of a fenced block and the tags it may have, a name, and multiplicities that may be written anew before the style is judged.
TICKS, TAG, IDENT = "```", r"[ \t]*(?:json|JSON)?[ \t]*\n", r"[A-Za-z_]\w*"
REWRITTEN = {"1..n": "1..*", "0..n": "0..*", "n": "*"}
PRIMITIVE = ["int", "string", "boolean", "double", "float", "date", "time", "datetime", "long", "void"]

FENCED = f"(?s){TICKS}{TAG}(.*?){TICKS}"
METHOD = rf"^{IDENT}\s*\(.*\)(\s*:\s*\S.*)?\s*$"
OPEN_END = r"^(.*\.\.)?[nN]$"


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def decoded(x: Column) -> Column:
    """A text that is one JSON value, as VARIANT; else null.  The parser stops after a value and leaves what follows unread, so the text must also be the one element of an array and the value of a key."""
    inside = lambda c: F.when((F.size(c) == 1) & F.try_parse_json(F.concat(F.lit('{"k":'), x, F.lit("}"))).isNotNull(), c[0])
    return once(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), x, F.lit("]"))), "$", "array<variant>"), inside)


def decodes(x: Column) -> Column:
    return decoded(x).isNotNull()


def once(x: Column, f) -> Column:
    """``f`` of a column that is made once, however often ``f`` names it."""
    return F.transform(F.array(x), f)[0]


def found_json(t: Column, spans: Column) -> Column:
    """(json, method, extra) of a text whose outermost {...} are ``spans``.

    Candidates are the whole text, fenced blocks and spans; one order decides: the whole text if it decodes, then fences, then spans; what decodes before what doesn't; the longer span first; the earlier first.  Each is decoded once, and
    none but the whole text where that decodes."""
    one = lambda kind, bad, size, at, json, method, extra: F.struct(F.lit(kind).alias("kind"), bad.alias("bad"), size.alias("size"), at.alias("at"), json.alias("json"), method.alias("method"), extra.alias("extra"))
    no, zero = F.lit(False), F.lit(0)
    judged = lambda x: F.struct(x.alias("json"), (~decodes(x)).alias("bad"))

    def best(x):
        whole = x["whole"]
        alone = lambda c: c["bad"] & (c["json"] == whole)
        fences = F.transform(F.transform(F.transform(F.regexp_extract_all(x["t"], F.lit(FENCED), F.lit(1)), stripped), judged), lambda c, i: one(1, c["bad"], zero, i, c["json"], F.lit("fence"), F.lit(True)))
        inner = F.transform(F.transform(x["spans"], judged), lambda c, i: one(2, c["bad"], -F.length(c["json"]), i, c["json"], F.when(alone(c), "raw").otherwise("braces"), ~alone(c)))
        first = F.when(whole.startswith("{") & whole.endswith("}") & decodes(whole), one(0, no, zero, zero, whole, F.lit("raw"), no)).otherwise(F.array_min(F.concat(fences, inner)))
        return once(first, lambda b: F.struct(b["json"].alias("json"), F.coalesce(b["method"], F.lit("")).alias("method"), F.coalesce(b["extra"], whole != "").alias("extra")))

    return once(F.struct(stripped(t).alias("whole"), t.alias("t"), spans.alias("spans")), best)


def json_of(t: Column) -> Column:
    return found_json(F.coalesce(t, F.lit("")), braces(t))


def at(x: Column, path: str) -> Column:
    return F.try_variant_get(x, path, "variant")


def kind(x: Column, path: str) -> Column:
    """STRING, OBJECT, ARRAY and so on of what stands at a path; empty where nothing does."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(at(x, path)), r"^\w+", 0), F.lit(""))


def text(x: Column, path: str) -> Column:
    return F.try_variant_get(x, path, "string")


def items(x: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(x, path, "array<variant>"), F.array().cast("array<variant>"))


#: What a diagram is judged by; what must be a text stays VARIANT until its type is known.
NODE = "struct<id:variant,width:double,height:double,data:struct<name:variant,stereotype:string,attributes:variant,methods:variant>>"
EDGE = "struct<id:variant,source:variant,target:variant,data:struct<points:variant,sourceMultiplicity:string,targetMultiplicity:string>>"
DIAGRAM = f"struct<version:variant,type:variant,nodes:array<{NODE}>,edges:array<{EDGE}>>"


def _string(x: Column) -> Column:
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def _parts(x: Column) -> Column:
    """(id, name) of a list of parts, null for what isn't a text; no parts where there is no list, null where there is something else."""
    part = lambda p: F.struct(_string(p["id"]).alias("id"), _string(p["name"]).alias("name"))
    return F.when(x.isNull(), F.array().cast("array<struct<id:string,name:string>>")).otherwise(F.transform(F.try_variant_get(x, "$", "array<struct<id:variant,name:variant>>"), part))


def _node(n: Column) -> Column:
    x = n["data"]
    return F.struct(
        _string(n["id"]).alias("id"), _string(x["name"]).alias("name"), _parts(x["attributes"]).alias("attributes"), _parts(x["methods"]).alias("methods"),
        ((F.coalesce(n["width"], F.lit(1.0)) > 0) & (F.coalesce(n["height"], F.lit(1.0)) > 0)).alias("sized"), (F.coalesce(x["stereotype"], F.lit("")) == "enumeration").alias("listing"),
    )


def _edge(e: Column) -> Column:
    points = F.try_variant_get(e["data"]["points"], "$", "array<variant>")
    ends = F.array_compact(F.array(e["data"]["sourceMultiplicity"], e["data"]["targetMultiplicity"]))
    return F.struct(
        _string(e["id"]).alias("id"), _string(e["source"]).alias("source"), _string(e["target"]).alias("target"), e["data"].isNotNull().alias("data"),
        (points.isNull() | (F.size(points) >= 2)).alias("drawn"), ends.alias("ends"),
    )


def fits_schema(top: Column, nodes: Column, edges: Column) -> Column:
    """Version, type, nodes with id, name and lists of named parts, edges with id, both ends and data."""
    named = lambda a: a.isNotNull() & F.forall(a, lambda p: p["id"].isNotNull() & p["name"].isNotNull())
    node = lambda n: n["id"].isNotNull() & n["name"].isNotNull() & named(n["attributes"]) & named(n["methods"])
    edge = lambda e: e["id"].isNotNull() & e["source"].isNotNull() & e["target"].isNotNull() & e["data"]
    return _string(top["version"]).isNotNull() & _string(top["type"]).isNotNull() & nodes.isNotNull() & edges.isNotNull() & F.forall(nodes, node) & F.forall(edges, edge)


def is_whole(nodes: Column, edges: Column) -> Column:
    """Ids occur once, both ends of each edge are nodes, an edge that has points has two at least, and sizes that are given are above 0."""
    every = F.concat(nodes["id"], F.flatten(F.transform(nodes, lambda n: F.concat(n["attributes"]["id"], n["methods"]["id"]))), edges["id"])
    return (F.size(F.array_distinct(every)) == F.size(every)) & F.forall(edges, lambda e: F.array_contains(nodes["id"], e["source"]) & F.array_contains(nodes["id"], e["target"]) & e["drawn"]) & F.forall(nodes, lambda n: n["sized"])


def rewrites(nodes: Column, edges: Column) -> Column:
    """How often the closed list of rewritings applies: methods without their sign, and n in multiplicities."""
    return F.size(F.filter(F.flatten(nodes["methods"])["name"], lambda m: ~m.startswith("+ ") & m.rlike(METHOD))) + F.size(F.filter(F.flatten(edges["ends"]), lambda m: m.isin(*REWRITTEN)))


def has_style(nodes: Column, edges: Column) -> Column:
    """After the rewritings: attributes as "+ name : type" with a simple or declared type, values of enumerations bare, methods with sign and brackets, no n in multiplicities."""
    declared = F.concat(nodes["name"], F.array(*map(F.lit, PRIMITIVE)))
    typ = lambda a: F.regexp_extract(F.split(F.substr(a, F.lit(3)), " = ")[0], r"^.*? : (.*)$", 1)
    plain = lambda a: a.startswith("+ ") & once(typ(a), lambda k: (k == "") | F.array_contains(declared, F.regexp_replace(k, r"\[\]$", "")))
    value = lambda a: ~(a.startswith("+ ") | a.contains(" : "))
    attribute = lambda n: F.forall(n["attributes"]["name"], lambda a: F.when(n["listing"], value(a)).otherwise(plain(a)))
    method = lambda m: F.when(m.startswith("+ "), m.contains("(") & m.contains(")")).otherwise(m.rlike(METHOD))
    return F.forall(nodes, attribute) & F.forall(F.flatten(nodes["methods"])["name"], method) & F.forall(F.flatten(edges["ends"]), lambda m: ~m.rlike(OPEN_END) | m.isin(*REWRITTEN))


def levels(x: DataFrame) -> DataFrame:
    """``x`` (t, json, cut_off, and more) with lvl, failure and rewrites: the level that a response t reaches with the JSON found in it, -1 none, 0 found, 1 an object, 2 schema, 3 integrity, 4 style; what stops it; and rewritings from
    integrity on.

    The text, the diagram and its lists are columns one after the other, each made once for all checks that read it."""
    v, top, nodes, edges = map(F.col, ("v", "top", "nodes", "edges"))
    x = x.withColumn("v", decoded(F.col("json"))).withColumn("top", F.try_variant_get(v, "$", DIAGRAM))
    x = x.withColumns({"nodes": F.transform(top["nodes"], _node), "edges": F.transform(top["edges"], _edge)})
    none = F.when(F.col("cut_off"), -1).when(F.col("t").contains("{"), -2).otherwise(-3)
    x = x.withColumn("at", F.when(F.col("json").isNull(), none).when(v.isNull(), F.when(F.col("cut_off"), -4).otherwise(-5)).when(top.isNull(), 0).when(~fits_schema(top, nodes, edges), 1).when(~is_whole(nodes, edges), 2).when(~has_style(nodes, edges), 3).otherwise(4))
    failures = {-1: "truncated", -2: "incomplete_json", -3: "no_json", -4: "truncated", -5: "invalid_json", 0: "not_object", 1: "schema", 2: "integrity", 3: "style", 4: ""}
    failure = F.element_at(F.create_map(*[F.lit(k) for p in failures.items() for k in p]), F.col("at"))
    lvl = F.when(F.col("at") >= 0, F.col("at")).when(F.col("at") >= -3, -1).otherwise(0)
    return x.withColumns({"lvl": lvl, "failure": failure, "rewrites": F.when(F.col("at") >= 3, rewrites(nodes, edges)).otherwise(0)}).drop("v", "top", "nodes", "edges", "at")
