"""Class diagrams as lines: the grammar, and a reader that turns lines into classes, members, relations and issues."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import dimension
from .retrieval import held

# Arrows, the type of edge that they stand for, whether the ends change places, and whether multiplicities and labels are left out.
OPERATORS = [
    ("<|--", "ClassInheritance", 1, 1), ("--|>", "ClassInheritance", 0, 1), ("<|-", "ClassInheritance", 1, 1), ("-|>", "ClassInheritance", 0, 1), ("..|>", "ClassRealization", 0, 1), ("<|..", "ClassRealization", 1, 1),
    ("<-->", "ClassBidirectional", 0, 0), ("*-->", "ClassComposition", 1, 0), ("*->", "ClassComposition", 1, 0), ("-->", "ClassUnidirectional", 0, 0), ("<--", "ClassUnidirectional", 1, 0),
    ("..>", "ClassDependency", 0, 0), ("<..", "ClassDependency", 1, 0), ("*--", "ClassComposition", 1, 0), ("--*", "ClassComposition", 0, 0), ("o--", "ClassAggregation", 1, 0), ("--o", "ClassAggregation", 0, 0),
    ("*-", "ClassComposition", 1, 0), ("-*", "ClassComposition", 0, 0), ("--", "ClassBidirectional", 0, 0), ("..", "ClassBidirectional", 0, 0), ("-o", "ClassAggregation", 0, 0), ("o-", "ClassAggregation", 1, 0),
    ("-", "ClassBidirectional", 0, 0), (".", "ClassBidirectional", 0, 0),
]
_ARROW = "|".join(re.escape(o[0]) for o in sorted(OPERATORS, key=lambda o: -len(o[0])))
# The grammar of class diagrams, part by part.
ID, _GAP, _END = r"(\w+)", r"\s*", r"\s*$"
_QUOTED, _LABEL = r'(?:"([^"]*)")?', r"(?::\s*(.*))?"
KIND, _STEREO, _BRACES = r"(abstract\s+class|class|enum|interface)", r"(?:\s*<<(\w+)>>)?", r"(\{)?\s*(\})?"
RELATION = _GAP.join(["^", ID, _QUOTED, f"({_ARROW})", _QUOTED, ID, _LABEL, "$"])
HEADER = rf"^{KIND}\s+{ID}{_STEREO}\s*{_BRACES}{_END}"
_PAIR = rf"\({_GAP}{ID}{_GAP},{_GAP}{ID}{_GAP}\)"
_DOTS = r"\.{1,2}"
ASSOCIATION = _GAP.join(["^", ID, _DOTS, _PAIR, "$"])
PAIR_FIRST = _GAP.join(["^", _PAIR, _DOTS, ID, "$"])
NOTE = r"(?i)^note\b.*\bas" + rf"\s+{ID}"
DIAMOND = rf"^<>\s+{ID}{_END}"
CONSTRAINT = r"\{[^}]*\}"


def relations(lines, ops):
    """Lines (..., t) that are relations: type, ends, their multiplicities and roles, and label, turned as the arrow says; lines that aren't keep a null type."""
    part = lambda k: F.regexp_extract("t", RELATION, k)
    x = lines.withColumns({"op": part(3), "a": part(1), "b": part(5), "l": X.reading_direction(part(6))})
    for side, k in (("a", 2), ("b", 4)):
        mult, role = X.mult_role(part(k))
        x = x.withColumns({f"{side}m": mult, f"{side}r": role})
    x = x.join(F.broadcast(ops), "op", "left")
    turned, bare = F.coalesce(F.col("swap") == 1, F.lit(False)), F.coalesce(F.col("bare") == 1, F.lit(False))
    end = lambda p, q: F.when(turned, F.col(q)).otherwise(F.col(p))
    kept = lambda c: F.when(bare, "").otherwise(c)
    made = {"source": end("a", "b"), "target": end("b", "a"), "source_mult": kept(end("am", "bm")), "target_mult": kept(end("bm", "am")), "source_role": kept(end("ar", "br")), "target_role": kept(end("br", "ar")), "label": kept(F.col("l"))}
    return x.select(*lines.columns, "typ", *[c.alias(n) for n, c in made.items()])


def operators(spark: SparkSession) -> DataFrame:
    return dimension(spark, OPERATORS, "op string, typ string, swap int, bare int")


def blocks(lines):
    """Adds kind and owner of each line.  A document's lines are one window in their order: the last header or end before a line says which block is open."""
    w = Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("t")
    word = F.regexp_extract(t, HEADER, 1)
    opens = t.rlike(HEADER) & (F.regexp_extract(t, HEADER, 4) != "") & (F.regexp_extract(t, HEADER, 5) == "")
    state = F.when(opens, F.struct(F.regexp_extract(t, HEADER, 2).alias("name"), word.alias("word"))).when(t == "}", F.struct(F.lit("").alias("name"), F.lit("").alias("word")))
    x = lines.withColumn("block", F.last(state, ignorenulls=True).over(w))
    inside = F.coalesce(F.col("block.name") != "", F.lit(False))
    member = F.when(t == "}", "end").when(F.col("block.word") == "enum", "value").when(t.contains("("), "method").otherwise("attribute")
    head = F.when(F.regexp_extract(t, HEADER, 3) == "interface", "interface").otherwise(F.regexp_replace(word, r"\s+", " "))
    outer = F.when(t.rlike(HEADER), head).when(t.rlike(r"^<>\s+\w+\s*$"), "unsupported").when(t.rlike(ASSOCIATION), "association class").when(t.rlike(RELATION), "relation").otherwise("unknown")
    return x.select("doc", "i", "t", F.when(inside, member).otherwise(outer).alias("kind"), F.when(inside, F.col("block.name")).otherwise("").alias("owner"))


def _last_open() -> Column:
    """Of the lines before each one of its diagram: the header whose block is open there (name, word, at), an empty name where none is."""
    t = F.col("t")
    part = lambda k: F.regexp_extract(t, HEADER, k)
    opens = t.rlike(HEADER) & (part(4) != "") & (part(5) == "")
    state = F.when(opens, F.struct(part(2).alias("name"), part(1).alias("word"), F.col("i").alias("at"))).when(t == "}", F.struct(F.lit("").alias("name"), F.lit("").alias("word"), F.lit(0).alias("at")))
    return F.last(state, ignorenulls=True).over(Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))


def marked(lines: DataFrame) -> DataFrame:
    """(doc, i, t, kind, owner, at) of raw lines (doc, i, t): what each line is, and whose block it stands in (the header's line beside it).

    Lines are trimmed; blank ones and those of an @ are left out.  Within a block every line but the closing brace is a value, method or attribute.  Outside, a header comes before a diamond, a note, an
    association class in either form, and a relation; what is none of these is ``unknown``.  A diagram is one window, so a diagram's lines meet in one task and are never gathered in one row."""
    t = F.col("t")
    x = lines.select("doc", "i", F.regexp_replace("t", r"^\s+|\s+$", "").alias("t")).where((t != "") & ~t.startswith("@")).withColumn("block", _last_open())
    inside = F.coalesce(F.col("block.name") != "", F.lit(False))
    member = F.when(t == "}", "end").when(F.col("block.word") == "enum", "value").when(t.contains("("), "method").otherwise("attribute")
    outer = F.when(t.rlike(HEADER), "header").when(t.rlike(DIAMOND), "diamond").when(t.rlike(NOTE), "note").when(t.rlike(ASSOCIATION) | t.rlike(PAIR_FIRST), "association").when(t.rlike(RELATION), "relation").otherwise("unknown")
    return x.select("doc", "i", "t", F.when(inside, member).otherwise(outer).alias("kind"), F.when(inside, F.col("block.name")).otherwise("").alias("owner"), F.when(inside, F.col("block.at")).otherwise(0).alias("at"))


def read(lines: DataFrame) -> dict[str, DataFrame]:
    """Diagrams of raw lines (doc, i, t), (doc, i) unique, as four tables:

    ``classes`` (doc, i, name, kind): the last declaration of each name, and the names that only relations use (kind ``implicit``, i null).
    ``members`` (doc, i, owner, kind, name, typ) of those declarations: attributes with their types, methods and values as written.
    ``relations`` (doc, i, typ, source, target, source_mult, target_mult, source_role, target_role, label): by the table of arrows; an association class has its pair as ends and its class as label.
    ``issues`` (doc, i, issue, subject): stereotypes that are left out, constraints of ends, notes on a class or a pair (subject: the note; they make no relation where it stands above), lines that aren't understood,
    implicit classes, and diamonds.  A diagram with a diamond is ``unsupported``: it keeps what was read, but gets no implicit classes.

    Null texts and empty tables give nothing; repeated lines count each.  The marked lines, declarations, relations and implicit classes are written once each, to the shared folder."""
    spark = lines.sparkSession
    x = held(marked(lines))  # read by all four
    part = lambda k: F.regexp_extract("t", HEADER, k)
    head = F.when(part(3) == "interface", "interface").otherwise(F.regexp_replace(part(1), r"\s+", " "))
    heads = x.where("kind = 'header'").select("doc", "i", part(2).alias("name"), head.alias("kind"), part(1).alias("word"), part(3).alias("stereotype"))
    declared = held(heads.groupBy("doc", "name").agg(F.max("i").alias("i"), F.max_by("kind", "i").alias("kind")))

    inner = x.where(F.col("kind").isin("attribute", "method", "value"))
    parsed = [c.alias(n) for c, n in zip(X.parse_attribute(F.col("t")), ("a_name", "a_typ", "a_default", "a_marks"), strict=True)][:2]
    own = F.col("kind") == "attribute"
    members = inner.join(declared.select("doc", F.col("name").alias("owner"), F.col("i").alias("at")), ["doc", "owner", "at"], "left_semi").select("doc", "i", "owner", "kind", "t", *parsed)
    members = members.select("doc", "i", "owner", "kind", F.when(own, F.col("a_name")).otherwise(F.col("t")).alias("name"), F.when(own, F.col("a_typ")).otherwise("").alias("typ"))

    notes = x.where("kind = 'note'").groupBy("doc", F.regexp_extract("t", NOTE, 1).alias("note")).agg(F.min("i").alias("above"))
    forms = {n: F.when(F.col("t").rlike(ASSOCIATION), F.regexp_extract("t", ASSOCIATION, p)).otherwise(F.regexp_extract("t", PAIR_FIRST, q)) for n, p, q in (("label", 1, 3), ("source", 2, 1), ("target", 3, 2))}
    named = F.when(F.col("kind") == "relation", F.array(F.regexp_extract("t", RELATION, 1), F.regexp_extract("t", RELATION, 5))).otherwise(F.array(forms["label"]))
    noted = x.where(F.col("kind").isin("relation", "association")).select("doc", "i", F.posexplode(named).alias("pos", "note")).join(notes, ["doc", "note"]).where("above < i").groupBy("doc", "i").agg(F.min_by("note", "pos").alias("note"))
    columns = ["doc", "i", "typ", "source", "target", "source_mult", "target_mult", "source_role", "target_role", "label"]
    none = [F.lit("").alias(c) for c in columns[5:9]]
    binary = relations(x.where("kind = 'relation'").select("doc", "i", "t"), operators(spark)).select("t", *columns)
    pairs = x.where("kind = 'association'").select("t", "doc", "i", F.lit("association class").alias("typ"), forms["source"].alias("source"), forms["target"].alias("target"), *none, forms["label"].alias("label"))
    ties = held(binary.unionByName(pairs).join(noted, ["doc", "i"], "left"))
    on_pair = F.col("typ") == "association class"
    links = ties.where("note is null").select(*columns)

    diamonds = x.where("kind = 'diamond'")
    names = links.select("doc", F.explode(F.when(F.col("typ") == "association class", F.array("source", "target", "label")).otherwise(F.array("source", "target"))).alias("name")).distinct()
    implicit = held(names.join(declared, ["doc", "name"], "left_anti").join(diamonds.select("doc").distinct(), "doc", "left_anti"))

    issue = lambda df, name, subject: df.select("doc", "i", F.lit(name).alias("issue"), subject.alias("subject"))
    odd = (F.col("stereotype") != "") & (F.col("stereotype") != "interface") & ~((F.col("word") == "enum") & (F.col("stereotype") == "enum"))
    ends = F.explode(F.concat(*[F.regexp_extract_all(F.regexp_extract("t", RELATION, k), F.lit(CONSTRAINT), F.lit(0)) for k in (2, 4)]))
    issues = [
        issue(heads.where(odd), "stereotype", F.col("stereotype")), issue(diamonds, "unsupported", F.regexp_extract("t", DIAMOND, 1)),
        ties.where("note is not null").select("doc", "i", F.when(on_pair, "note on pair").otherwise("note on class").alias("issue"), F.col("note").alias("subject")),
        issue(ties.where(F.col("note").isNull() & ~on_pair).select("doc", "i", ends.alias("end")), "end constraint", F.col("end")), issue(x.where("kind = 'unknown'"), "unknown line", F.col("t")),
        issue(implicit.withColumn("i", F.lit(None).cast("int")), "implicit class", F.col("name")),
    ]
    every = issues[0]
    for more in issues[1:]:
        every = every.unionByName(more)
    classes = declared.select("doc", "i", "name", "kind").unionByName(implicit.select("doc", F.lit(None).cast("int").alias("i"), "name", F.lit("implicit").alias("kind")))
    return {"classes": classes, "members": members, "relations": links, "issues": every}
