"""Scalar text functions, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of simple types; domain types that stand for simple ones unless the diagram declares a class of that name.
TYPE_NAMES = {
    "string": "string", "String": "string", "int": "int", "Int": "int", "Integer": "int", "integer": "int", "double": "double", "Double": "double", "float": "float", "Float": "float",
    "boolean": "boolean", "Boolean": "boolean", "bool": "boolean", "Bool": "boolean", "date": "date", "Date": "date", "time": "time", "Time": "time", "datetime": "datetime", "DateTime": "datetime",
    "Datetime": "datetime", "long": "long", "Long": "long", "Real": "double", "Text": "string",
}
DOMAIN_TYPES = {"Guid": "string", "Address": "string", "Phone": "string", "Supplier": "string", "Price": "double"}
VISIBILITY = r"^[\s+\-#~]+"


def trim_spaces(x: Column) -> Column:
    """Without Unicode spaces at both ends; tabs and line ends stay."""
    return F.regexp_replace(x, r"^\p{Zs}+|\p{Zs}+\z", "")


def rounded_text(x: Column, digits: int) -> Column:
    """A double rounded on its binary value, halves away from zero, as text in plain digits: the shortest that reads back as it, the sign of zero kept, an exponent below 1e-4 and from 1e16 on."""
    y = F.abs(x) * 10.0**digits
    whole = F.when(y < 2.0**52, F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1.0).otherwise(0.0)).otherwise(y)
    r = F.when(F.isnan(whole) | (whole == float("inf")), F.abs(x)).otherwise(whole / 10.0**digits)
    tail = lambda s: F.regexp_replace(s, r"(\.\d+?)0+$", "$1")
    plain = F.when((r < 1e16) & ((r >= 1e-4) | (r == 0)), tail(r.cast("string").try_cast("decimal(38,20)").cast("string")))
    raised = F.regexp_replace(F.regexp_replace(F.regexp_replace(r.cast("string"), r"\.0E", "E"), r"E(\d)", "e+$1"), r"E-(\d)$", "e-0$1")
    text = F.when(F.isnan(r), "nan").when(r == float("inf"), "inf").when(plain.isNotNull(), plain).otherwise(F.replace(raised, F.lit("E-"), F.lit("e-")))
    return F.concat(F.when(x.cast("string").startswith("-"), "-").otherwise(""), text)


def norm(x: Column) -> Column:
    """Lower case, digits and letters a-z only."""
    return F.regexp_replace(F.lower(x), "[^0-9a-z]", "")


def norm_mult(x: Column) -> Column:
    """Multiplicity for comparison: n is *, 0..* is *, 1..1 is 1; null is ''."""
    t = F.replace(F.coalesce(x, F.lit("")), F.lit(" "), F.lit(""))
    u = F.when(F.lower(t) == "n", "*").otherwise(F.regexp_replace(t, r"\.\.[nN]$", "..*"))
    return F.when(u == "0..*", "*").when(u == "1..1", "1").otherwise(u)


def norm_mult_etl(x: Column) -> Column:
    """Multiplicity for loading: three dots or more are two, n is *, and nothing else changes."""
    u = F.regexp_replace(x, r"\.{3,}", "..")
    return F.when(u.isin("n", "N"), "*").otherwise(F.regexp_replace(u, r"\.\.[nN]$", "..*"))


def normalize_type(x: Column, declared: Column) -> Column:
    """A type name as the tables spell it; pairs of brackets at its end stay, names in the array ``declared`` and unknown ones too."""
    base, suffix = F.regexp_replace(x, r"(\[\])+$", ""), F.regexp_extract(x, r"((\[\])*)$", 1)
    table = lambda names: F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    domain = F.when(~F.array_contains(declared, base), F.try_element_at(table(DOMAIN_TYPES), base))
    return F.concat(F.coalesce(domain, F.try_element_at(table(TYPE_NAMES), base), base), suffix)


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def _plain(x: Column) -> Column:
    """Without white space around it and one sign of visibility before it."""
    s = F.trim(x)
    return F.when(s.rlike(r"^[-+#~]"), F.trim(F.substring(s, 2, 1 << 30))).otherwise(s)


def parse_attribute(x: Column) -> list[Column]:
    """name, typ, dflt (null without one) and modifiers of ``name : T = d`` or ``T name``, with modifiers in braces or a leading const."""
    s = _plain(x)
    inner = F.array_join(F.regexp_extract_all(s, F.lit(r"\{([^}]*)\}"), F.lit(1)), " ")
    marks = F.filter(F.split(F.lower(inner), r"[,\s]+"), lambda m: m != "")
    s = squeeze(F.regexp_replace(s, r"\{[^}]*\}", " "))
    const = s.startswith("const ")
    s = F.when(const, F.trim(F.substring(s, 7, 1 << 30))).otherwise(s)
    marks = F.when(const, F.array_append(marks, "const")).otherwise(marks)
    given = s.contains("=")
    default = F.when(given, F.trim(F.regexp_extract(s, "^[^=]*=(.*)$", 1)))
    s = F.when(given, F.trim(F.regexp_extract(s, "^([^=]*)=", 1))).otherwise(s)
    colon = s.contains(":")
    name = F.when(colon, F.trim(F.regexp_extract(s, "^([^:]*):", 1))).otherwise(F.regexp_extract(s, r"(\S*)$", 1))
    typ = F.when(colon, F.trim(F.regexp_extract(s, "^[^:]*:(.*)$", 1))).otherwise(F.trim(F.regexp_replace(s, r"\S*$", "")))
    return [name.alias("name"), typ.alias("typ"), default.alias("dflt"), marks.alias("modifiers")]


def method_signature(x: Column, declared: Column) -> Column:
    """``+ name(parameters) : type`` of ``T name(...)`` or ``name(...) : T``; without brackets the text after a plus."""
    s = _plain(x)
    parts = r"^(.*)\(([^(]*)\)([^)]*)$"
    before, params, after = (F.trim(F.regexp_extract(s, parts, 1)), F.regexp_extract(s, parts, 2), F.trim(F.regexp_extract(s, parts, 3)))
    java = (after == "") & before.rlike(r"\S\s+\S")
    name = F.when(java, F.regexp_extract(before, r"(\S+)$", 1)).otherwise(before)
    ret = F.when(after != "", F.trim(F.regexp_replace(after, "^:+", ""))).when(java, F.trim(F.regexp_replace(before, r"\S+$", ""))).otherwise("")
    out = F.concat(F.lit("+ "), name, F.lit("("), params, F.lit(")"))
    return F.when(~s.rlike(parts), F.concat(F.lit("+ "), s)).when(ret != "", F.concat(out, F.lit(" : "), normalize_type(ret, declared))).otherwise(out)


def mult_role(x: Column) -> list[Column]:
    """The first word of an end and what follows it; constraints in braces are left out."""
    s = squeeze(F.regexp_replace(x, r"\{[^}]*\}", " "))
    return [F.regexp_extract(s, r"^(\S*)", 1).alias("mult"), F.regexp_extract(s, r"^\S+ (.*)$", 1).alias("role")]


def reading_direction(x: Column) -> Column:
    """A label without one sign of reading direction at its end or start; doubled signs stay."""
    s = F.trim(x)
    many = F.length(s) > 1
    return (
        F.when(s.rlike(" [<>]$"), F.rtrim(F.regexp_replace(s, " [<>]$", ""))).when(s.rlike("^[<>] "), F.ltrim(F.regexp_replace(s, "^[<>] ", "")))
        .when(many & s.rlike("[^<>-][<>]$"), F.rtrim(F.regexp_replace(s, "[<>]$", ""))).when(many & s.rlike("^[<>][^<>]"), F.ltrim(F.regexp_replace(s, "^[<>]", ""))).otherwise(s)
    )


def attribute_name(x: Column) -> Column:
    """The name before a colon, without signs of visibility."""
    return F.trim(F.regexp_replace(F.split(x, ":")[0], VISIBILITY, ""))


def quoted_multiplicities(x: Column) -> Column:
    """Multiplicities in quotes rewritten in place: n is *, 1..1 is 1."""
    return F.regexp_replace(F.regexp_replace(x, r'"([0-9]*)(\.\.)?[nN]"', '"$1$2*"'), r'"1\.\.1"', '"1"')


def glossary(x: Column, terms: list[tuple[str, str]]) -> Column:
    """Whole-word replacements, the longest term first."""
    return reduce(lambda t, kv: F.regexp_replace(t, rf"\b{kv[0]}\b", kv[1]), sorted(terms, key=lambda kv: (-len(kv[0]), kv[0])), x)
