"""Ordered scripts of corrections on the lines of a diagram, folded in the JVM: each edit sees what the ones before have left, and the first that can't be made ends the script."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.diagrams import HEADER, RELATION
from . import text as X

# Arrows of the types that an edge may be changed to; those with a container have it at the arrow's mark.
PLAIN_ARROWS = {"association": "--", "unidirectional": "-->", "dependency": "..>"}
CONTAINERS = {"aggregation": ("o--", "--o"), "composition": ("*--", "--*")}
END = "@enduml"


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _end(k: int):
    return lambda line: F.regexp_extract(_trimmed(line), RELATION, k)


def _is_relation(a: Column, b: Column, label: Column):
    """Whether a line is a relation of both classes, in either order, with the label."""

    def test(line: Column) -> Column:
        s, t = _end(1)(line), _end(5)(line)
        return _trimmed(line).rlike(RELATION) & (((s == a) & (t == b)) | ((s == b) & (t == a))) & (X.reading_direction(_end(6)(line)) == label)

    return test


def _written(line: Column, arrow: Column, label: Column, roles: tuple[Column, Column]) -> Column:
    side = lambda k, role: F.concat(F.lit(' "'), F.when(role == "", X.mult_role(_end(k)(line))[0]).otherwise(F.trim(F.concat_ws(" ", X.mult_role(_end(k)(line))[0], role))), F.lit('" '))
    return F.concat(_end(1)(line), side(2, roles[0]), arrow, side(4, roles[1]), _end(5)(line), F.when(label == "", "").otherwise(F.concat(F.lit(" : "), label)))


def _before_end(lines: Column, new: Column) -> Column:
    at = F.array_position(F.transform(lines, lambda x: F.lower(_trimmed(x))), END).cast("int")
    return F.when(at == 0, F.concat(lines, new)).otherwise(F.concat(F.slice(lines, 1, at - 1), new, F.slice(lines, at, F.size(lines))))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is made once, not at each place that names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def run_script(lines: Column, script: Column) -> Column:
    """struct(lines, applied, error) of lines (array of strings) after a script (array of maps with ``type`` and the fields of that edit).

    ``rename_token`` (from, to): a whole word, everywhere.  ``remove_line`` (match), ``replace_line`` (match, replacement): all lines that equal it but for white space around.  ``change_edge_type`` (class_a, class_b,
    label, new_type, container), ``remove_label`` (class_a, class_b, label), ``set_role`` (class_a, class_b, label, endpoint_mult, role): of the one relation with these ends and this label; the end of a role is the one
    with that multiplicity.  ``add_line`` (line) and ``add_block`` (block: a declaration up to its closing brace) go before the end mark.

    A target that is missing or ambiguous, a line or class that is there already, a block that isn't one declaration, and an unknown type are errors; the lines stay as they were before that edit.  A field
    that is missing counts as empty; null lines or a null script give no edits.  A line within a block counts as a relation if it reads like one."""

    def step(acc: Column, op: Column) -> Column:
        now = acc["lines"]
        field = lambda name: F.coalesce(F.try_element_at(op, F.lit(name)), F.lit(""))
        kind, match = field("type"), _trimmed(field("match"))

        def result(ok: Column, new: Column, error: Column) -> Column:
            return F.struct(F.when(ok, new).otherwise(now).alias("lines"), F.when(ok, acc["applied"] + 1).otherwise(acc["applied"]).alias("applied"), F.when(ok, "").otherwise(F.concat(kind, F.lit(": "), error)).alias("error"))

        word = F.concat(F.lit(r"\b\Q"), field("from"), F.lit(r"\E\b"))
        renamed = F.transform(now, lambda x: F.regexp_replace(x, word, F.regexp_replace(field("to"), r"([\\$])", r"\\$1")))
        out = F.when(kind == "rename_token", result((field("from") != "") & F.exists(now, lambda x: F.regexp_like(x, word)), renamed, F.concat(field("from"), F.lit(" not found"))))
        there = F.exists(now, lambda x: _trimmed(x) == match)
        out = out.when(kind == "remove_line", result(there, F.filter(now, lambda x: _trimmed(x) != match), F.concat(match, F.lit(" not found"))))
        out = out.when(kind == "replace_line", result(there, F.transform(now, lambda x: F.when(_trimmed(x) == match, field("replacement")).otherwise(x)), F.concat(match, F.lit(" not found"))))

        def on_relation(hits: Column) -> Column:
            one, hit, label = F.size(hits) == 1, F.get(hits, F.lit(0)), field("label")
            times = F.concat(field("class_a"), F.lit(" "), field("class_b"), F.lit(" found "), F.size(hits).cast("string"), F.lit(" times"))
            own = tuple(X.mult_role(_end(k)(hit))[1] for k in (2, 4))
            put = lambda line: F.transform(now, lambda x: F.when(_trimmed(x) == _trimmed(hit), line).otherwise(x))
            arrow = F.when(F.lit(False), "")
            for name, a in PLAIN_ARROWS.items():
                arrow = arrow.when(field("new_type") == name, a)
            for name, (source, target) in CONTAINERS.items():
                arrow = arrow.when((field("new_type") == name) & (field("container") == _end(1)(hit)), source).when((field("new_type") == name) & (field("container") == _end(5)(hit)), target)
            left, right = (X.mult_role(_end(k)(hit))[0] == field("endpoint_mult") for k in (2, 4))
            roles = (F.when(left, field("role")).otherwise(own[0]), F.when(right, field("role")).otherwise(own[1]))
            changed = result(one & arrow.isNotNull(), put(_written(hit, arrow, label, own)), F.when(~one, times).otherwise(F.concat(F.lit("no arrow for "), field("new_type"))))
            role = result(one & (left != right), put(_written(hit, _end(3)(hit), label, roles)), F.when(~one, times).otherwise(F.concat(field("endpoint_mult"), F.lit(" isn't at one end"))))
            return F.when(kind == "change_edge_type", changed).when(kind == "set_role", role).otherwise(result(one, put(_written(hit, _end(3)(hit), F.lit(""), own)), times))

        hits = F.filter(now, _is_relation(field("class_a"), field("class_b"), field("label")))
        out = out.when(kind.isin("change_edge_type", "remove_label", "set_role"), _let(hits, on_relation))

        line = _trimmed(field("line"))
        out = out.when(kind == "add_line", result(~F.exists(now, lambda x: _trimmed(x) == line), _before_end(now, F.array(line)), F.concat(line, F.lit(" is there already"))))
        block = F.transform(F.split(_trimmed(field("block")), "\r\n|\n|\r", -1), lambda x: F.regexp_replace(x, r"\s+$", ""))
        head, name = F.get(block, F.lit(0)), lambda x: F.regexp_extract(_trimmed(x), HEADER, 2)
        whole = head.rlike(HEADER) & (F.regexp_extract(head, HEADER, 4) != "") & (F.regexp_extract(head, HEADER, 5) == "") & (F.array_position(F.transform(block, _trimmed), "}") == F.size(block))
        declared = F.exists(now, lambda x: name(x) == name(head))
        out = out.when(kind == "add_block", result(whole & ~declared, _before_end(now, F.concat(block, F.array(F.lit("")))), F.when(~whole, F.lit("not one declaration")).otherwise(F.concat(name(head), F.lit(" is there already")))))
        return F.when(acc["error"] != "", acc).otherwise(out.otherwise(result(F.lit(False), now, F.lit("unknown type"))))

    start = F.struct(F.coalesce(lines, F.array().cast("array<string>")).alias("lines"), F.lit(0).alias("applied"), F.lit("").alias("error"))
    return F.aggregate(F.coalesce(script, F.array().cast("array<map<string,string>>")), start, step)
