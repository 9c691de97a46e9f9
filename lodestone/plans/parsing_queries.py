"""Queries of semi-structured text: blocks and markers, levels, diagram lines, tables of operators, rendering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import responses as A
from ..functions import scan
from ..functions import text as X
from ..operators.diagrams import ASSOCIATION, HEADER, ID, KIND, OPERATORS, RELATION, blocks, operators, relations
from ..sources.tables import dealt, dimension, table
from .registry import query

#: Responses made of the turns of conversations, in an SQL that both engines read; a turn's own signs of structure are taken out, so that what must be found is known.
TURN = "translate(text,'{}`<>|','')"
RESPONSE = f"""CASE (conv_id*7+turn)%14 WHEN 0 THEN '<think>'||{TURN}||'</think>{{"a":'||turn||'}}' WHEN 1 THEN {TURN}||'</think>{{"a":1}}</think> tail' WHEN 2 THEN '{{"a":3}}<Thinking>'||{TURN}
 WHEN 3 THEN {TURN}||chr(10)||'```json'||chr(10)||'{{"a":4}}'||chr(10)||'```'||chr(10)||'```'||chr(10)||'[1]'||chr(10)||'```' WHEN 4 THEN {TURN} WHEN 5 THEN ' {{"a":{{"b":"}}"}}}} ' WHEN 6 THEN {TURN}||' {{"a":'
 WHEN 7 THEN '<reasoning>'||{TURN}||'</reasoning>{{"c":"{{"}} and {{"longer":"object"}}' WHEN 8 THEN '' WHEN 9 THEN '```'||chr(10)||'not json'||chr(10)||'``` {{"a":1}}' WHEN 10 THEN '{{}}{{"broken":}} {{"x":[1]}}'
 WHEN 11 THEN '<|channel> thought'||{TURN}||'<channel|>[1,2]' WHEN 12 THEN '{{"only":broken}}' ELSE '<think>a</think><think>b'||{TURN} END"""
# Marks around reasoning, by name.
MARKERS = {"think": ("<think>", "</think>"), "thinking": ("<thinking>", "</thinking>"), "reasoning": ("<reasoning>", "</reasoning>"), "gemma4_channel_thought": (r"<\|channel>\s*thought", r"<channel\|>")}


def sql_values(rows):
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)


def responses(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.expr(RESPONSE).alias("t"))


RESPONSES = f"(SELECT conv_id, turn, {RESPONSE} t FROM conversations)"


def strip(text):
    """A response without reasoning, mark by mark: closed blocks go, then all up to the first lone closing mark, then all from a lone opening one."""
    for o, c in MARKERS.values():
        for p in (f"(?is){o}.*?{c}", f"(?is)^.*?{c}", f"(?is){o}.*$"):
            text = F.regexp_replace(text, p, "")
    return text


def strip_sql(x):
    for o, c in MARKERS.values():
        for p in (f"(?is){o}.*?{c}", f"(?is)^.*?{c}", f"(?is){o}.*$"):
            x = f"regexp_replace({x},'{p}','','g')"
    return x


@query("strip_blocks", f"SELECT conv_id, turn, s, s<>t removed FROM (SELECT *, {strip_sql('t')} s FROM {RESPONSES})")
def strip_blocks(spark, d):
    return responses(spark, d).withColumn("s", strip(F.col("t"))).select("conv_id", "turn", "s", (F.col("s") != F.col("t")).alias("removed"))


MARKS_SQL = ", ".join(f"CASE WHEN regexp_matches(t,'(?i){o}') OR regexp_matches(t,'(?i){c}') THEN '{n}' END" for n, (o, c) in MARKERS.items())


@query("marker_flags", f"SELECT conv_id, turn, array_to_string(list_filter([{MARKS_SQL}], lambda x: x IS NOT NULL),',') marks FROM {RESPONSES}")
def marker_flags(spark, d):
    """Names of the marks that a response holds."""
    t = F.col("t")
    marks = F.array_compact(F.array(*[F.when(t.rlike(f"(?i){o}") | t.rlike(f"(?i){c}"), n) for n, (o, c) in MARKERS.items()]))
    return responses(spark, d).select("conv_id", "turn", F.array_join(marks, ",").alias("marks"))


#: Outermost {...} of texts t by key k, in SQL: pieces between signs, read one after the other.
SPANS_SQL = r"""lx AS MATERIALIZED (SELECT k, regexp_extract_all(t,'["{}\\]|[^"{}\\]+') l FROM rt), st AS (SELECT k, 0 i, 0 depth, 0 first, false q, false e, NULL::VARCHAR span FROM lx
 UNION ALL SELECT k, i+1, CASE WHEN q THEN depth WHEN x='{' THEN depth+1 WHEN x='}' AND depth>0 THEN depth-1 ELSE depth END, CASE WHEN NOT q AND x='{' AND depth=0 THEN i+1 ELSE first END,
  CASE WHEN q THEN e OR x<>'"' ELSE depth>0 AND x='"' END, q AND NOT e AND x='\', CASE WHEN NOT q AND x='}' AND depth=1 THEN array_to_string(l[first:i+1],'') END FROM (SELECT st.*, l, l[i+1] x FROM st JOIN lx USING(k) WHERE i<len(l))),
 sp AS (SELECT k, span, i FROM st WHERE span IS NOT NULL)"""
_TRIM = lambda x: f"regexp_replace({x},'^\\s+|\\s+$','','g')"
#: The JSON that each text holds, in SQL: (k, json, method).
FOUND_SQL = f"""{SPANS_SQL}, fe AS (SELECT k, {_TRIM('unnest(a)')} x, generate_subscripts(a,1) i FROM (SELECT k, regexp_extract_all(t,'{A.FENCED}',1) a FROM rt)),
 ca AS (SELECT k, 0 kind, false bad, 0 size, 0 i, {_TRIM('t')} json, 'raw' how FROM rt WHERE {_TRIM('t')} LIKE '{{%}}' AND json_valid({_TRIM('t')}) UNION ALL SELECT k, 1, NOT json_valid(x), 0, i, x, 'fence' FROM fe
  UNION ALL SELECT k, 2, NOT json_valid(span), -length(span), i, span, CASE WHEN NOT json_valid(span) AND span={_TRIM('t')} THEN 'raw' ELSE 'braces' END FROM sp JOIN rt USING(k)),
 fj AS (SELECT rt.k, rt.t, c.json, coalesce(c.how,'') AS how FROM rt LEFT JOIN (SELECT * FROM ca QUALIFY row_number() OVER (PARTITION BY k ORDER BY kind, bad, size, i)=1) c USING(k))"""


@query("extract_json", f"WITH RECURSIVE rt AS (SELECT {{'c':conv_id,'n':turn}} k, {strip_sql('t')} t FROM {RESPONSES}), {FOUND_SQL} SELECT k.c conv_id, k.n turn, json, how AS method FROM fj")
def extract_json(spark, d):
    """The JSON of a response: whole, fenced, or between braces; null where there is none."""
    x = responses(spark, d).select("conv_id", "turn", strip(F.col("t")).alias("t"))
    return x.select("conv_id", "turn", A.json_of(F.col("t")).alias("x")).select("conv_id", "turn", "x.json", "x.method")


@query("brace_scan", f"WITH RECURSIVE rt AS (SELECT {{'c':conv_id,'n':turn}} k, t FROM {RESPONSES}), {SPANS_SQL} SELECT rt.k.c conv_id, rt.k.n turn, count(span) n FROM rt LEFT JOIN sp USING(k) GROUP BY ALL")
def brace_scan(spark, d):
    """How many outermost {...} a response has, braces inside strings left out."""
    return responses(spark, d).select("conv_id", "turn", F.size(scan.braces(F.col("t"))).cast("long").alias("n"))


#: A diagram of each customer, in an SQL that both engines read; the rows' own values decide what is wrong with it.
_NODE = """'{"id":"n'||c_custkey||'","type":"class","position":{"x":0,"y":0},"width":'||(c_custkey%17)||',"height":80,"data":{"name":"C'||c_nationkey||'","attributes":[{"id":"'||CASE WHEN c_custkey%13=0 THEN 'n'||c_custkey ELSE 'a1' END||'","name":"'
||CASE c_nationkey%5 WHEN 0 THEN '+ x : int' WHEN 1 THEN '+ y : C'||c_nationkey||'[] = none' WHEN 2 THEN '+ z' WHEN 3 THEN '+ total : Money' ELSE 'total : int' END||'"}],"methods":[{"id":"m1","name":"'||CASE c_custkey%4 WHEN 0 THEN 'size(): int' WHEN 1 THEN '+ run()' WHEN 2 THEN 'go ( a, b )' ELSE 'stop' END||'"}]}}'"""
_OTHER = """'{"id":"n0","data":{"name":'||CASE WHEN c_custkey%11=0 THEN c_custkey||'' ELSE '"'||c_mktsegment||'"' END||CASE c_custkey%3 WHEN 0 THEN ',"stereotype":"enumeration","attributes":[{"id":"v1","name":"'||CASE WHEN c_custkey%2=0 THEN 'RED' ELSE '+ RED' END||'"}]' ELSE '' END||'}}'"""
_EDGE = """'{"id":"e1","source":"n'||c_custkey||'","target":"'||CASE WHEN c_custkey%10=0 THEN 'n9' ELSE 'n0' END||'","data":{"sourceMultiplicity":"1","targetMultiplicity":"'||CASE c_custkey%5 WHEN 0 THEN '1..n' WHEN 1 THEN 'n' WHEN 2 THEN '2..N' ELSE '0..1' END||'"'||CASE c_custkey%6 WHEN 0 THEN ',"points":[{"x":1}]' WHEN 1 THEN ',"points":[1,2]' ELSE '' END||'}}'"""
DRAWN = f"""'{{"version":"4.2.0","type":"ClassDiagram","nodes":['||{_NODE}||','||{_OTHER}||'],"edges":['||{_EDGE}||']}}'"""
ANSWER = f"""CASE c_custkey%19 WHEN 0 THEN 'none for '||c_name WHEN 1 THEN substr({DRAWN},1,80) WHEN 2 THEN 'see {{a}} of '||c_name WHEN 3 THEN '```json'||chr(10)||'['||c_custkey||']'||chr(10)||'```' WHEN 4 THEN '{{"nodes":[],"edges":{{}}}}'
 WHEN 5 THEN '<think>{{</think>'||{DRAWN} WHEN 6 THEN 'Here: '||{DRAWN}||' done' WHEN 7 THEN '```'||chr(10)||{DRAWN}||chr(10)||'```' ELSE {DRAWN} END"""
CUT_OFF = "c_custkey%38=1 OR c_custkey%57=2"
_LIST = lambda j, p: f"coalesce(({j}->'{p}')::JSON[],[])"
_STR = lambda j, p: f"json_type({j},'{p}') IS NOT DISTINCT FROM 'VARCHAR'"
_NONE = lambda l, v, bad: f"len(list_filter({l}, lambda {v}: {bad}))=0"
_NAMED = f"NOT ({_STR('p', '$.id')} AND {_STR('p', '$.name')})"
_PARTS = lambda n, k: f"(json_type({n},'$.data.{k}') IS NULL OR json_type({n},'$.data.{k}')='ARRAY' AND {_NONE(_LIST(n, f'$.data.{k}'), 'p', _NAMED)})"
_SCHEMA = f"""{_STR('j', '$.version')} AND {_STR('j', '$.type')} AND json_type(j,'$.nodes') IS NOT DISTINCT FROM 'ARRAY' AND json_type(j,'$.edges') IS NOT DISTINCT FROM 'ARRAY'"""
_FITS = f"""{_NONE('nodes', 'n', f"NOT ({_STR('n', '$.id')} AND {_STR('n', '$.data.name')} AND {_PARTS('n', 'attributes')} AND {_PARTS('n', 'methods')})")} AND {_NONE('edges', 'e', f"NOT ({_STR('e', '$.id')} AND {_STR('e', '$.source')} AND {_STR('e', '$.target')} AND json_type(e,'$.data') IS NOT DISTINCT FROM 'OBJECT')")}"""
_NAMES = lambda k: f"flatten(list_transform(nodes, lambda n: list_transform({_LIST('n', f'$.data.{k}')}, lambda p: p->>'$.name')))"
_IDS = "list_transform(nodes, lambda n: n->>'$.id')"
_EVERY = f"({_IDS} || flatten(list_transform(nodes, lambda n: list_transform({_LIST('n', '$.data.attributes')} || {_LIST('n', '$.data.methods')}, lambda p: p->>'$.id'))) || list_transform(edges, lambda e: e->>'$.id'))"
_WHOLE = f"""len(list_distinct({_EVERY}))=len({_EVERY}) AND {_NONE('edges', 'e', f"NOT (list_contains({_IDS}, e->>'$.source') AND list_contains({_IDS}, e->>'$.target') AND (json_type(e,'$.data.points') IS DISTINCT FROM 'ARRAY' OR json_array_length(e,'$.data.points')>=2))")} AND {_NONE('nodes', 'n', "coalesce((n->>'$.width')::DOUBLE,1)<=0 OR coalesce((n->>'$.height')::DOUBLE,1)<=0")}"""
_MULT = "list_filter(flatten(list_transform(edges, lambda e: [e->>'$.data.sourceMultiplicity', e->>'$.data.targetMultiplicity'])), lambda m: m IS NOT NULL)"
_REWRITES = f"len(list_filter({_NAMES('methods')}, lambda m: NOT starts_with(m,'+ ') AND regexp_matches(m,'{A.METHOD}'))) + len(list_filter({_MULT}, lambda m: m IN ('1..n','0..n','n')))"
_TYPE = "regexp_extract(split_part(substr(a,3),' = ',1),'^.*? : (.*)$',1)"
_KNOWN = f"(list_transform(nodes, lambda n: n->>'$.data.name') || [{', '.join(repr(p) for p in A.PRIMITIVE)}])"
_ATTRIBUTE = f"CASE WHEN coalesce(n->>'$.data.stereotype','')='enumeration' THEN starts_with(a,'+ ') OR contains(a,' : ') ELSE NOT (starts_with(a,'+ ') AND ({_TYPE}='' OR list_contains({_KNOWN}, regexp_replace({_TYPE},'\\[\\]$','')))) END"
_STYLE = f"""{_NONE('nodes', 'n', f"NOT ({_NONE('list_transform(' + _LIST('n', '$.data.attributes') + ", lambda p: p->>'$.name')", 'a', _ATTRIBUTE)})")} AND {_NONE(_NAMES('methods'), 'm', f"CASE WHEN starts_with(m,'+ ') THEN NOT (contains(m,'(') AND contains(m,')')) ELSE NOT regexp_matches(m,'{A.METHOD}') END")} AND {_NONE(_MULT, 'm', f"regexp_matches(m,'{A.OPEN_END}') AND m NOT IN ('1..n','0..n','n')")}"""


@query("level_ladder", f"""WITH RECURSIVE rt AS (SELECT c_custkey k, {strip_sql('t')} t FROM (SELECT c_custkey, {ANSWER} t FROM customer)), {FOUND_SQL}, cu AS (SELECT c_custkey k, {CUT_OFF} c FROM customer),
 jj AS (SELECT k, t, json, how, c, CASE WHEN json_valid(json) THEN json::JSON END j FROM fj JOIN cu USING(k)), ob AS (SELECT *, j IS NOT NULL AND json_type(j)='OBJECT' is_object FROM jj), sc AS (SELECT *, is_object AND {_SCHEMA} lists FROM ob),
 nl AS (SELECT *, CASE WHEN lists THEN (j->'$.nodes')::JSON[] ELSE [] END nodes, CASE WHEN lists THEN (j->'$.edges')::JSON[] ELSE [] END edges FROM sc),
 lv AS (SELECT *, CASE WHEN json IS NULL THEN -1 WHEN NOT is_object THEN 0 WHEN NOT (lists AND {_FITS}) THEN 1 WHEN NOT ({_WHOLE}) THEN 2 WHEN NOT ({_STYLE}) THEN 3 ELSE 4 END lvl, {_REWRITES} n FROM nl)
 SELECT k c_custkey, lvl, CASE lvl WHEN -1 THEN CASE WHEN c THEN 'truncated' WHEN contains(t,'{{') THEN 'incomplete_json' ELSE 'no_json' END WHEN 0 THEN CASE WHEN j IS NOT NULL THEN 'not_object' WHEN c THEN 'truncated' ELSE 'invalid_json' END WHEN 1 THEN 'schema' WHEN 2 THEN 'integrity' WHEN 3 THEN 'style' ELSE '' END failure,
  how AS extraction, CASE WHEN lvl>=3 THEN n ELSE 0 END::INTEGER rewrites FROM lv""")
def level_ladder(spark, d):
    """Levels build on each other: found, an object, schema, integrity, style; the failure names what stops a response."""
    rows = dealt(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
    x = rows.select("c_custkey", strip(F.expr(ANSWER)).alias("t"), F.expr(CUT_OFF).alias("cut_off"))
    x = x.withColumn("x", A.json_of(F.col("t"))).select("c_custkey", "t", "cut_off", "x.json", F.col("x.method").alias("extraction"))
    return A.levels(x).select("c_custkey", "lvl", "failure", "extraction", "rewrites")


MEMBER = "CASE p_partkey%7 WHEN 0 THEN 'size(): '||p_type WHEN 1 THEN '+ get(a, b) : int' WHEN 2 THEN 'run_'||p_size||' ( x )' WHEN 3 THEN '- hide()' WHEN 4 THEN 'no brackets' WHEN 5 THEN '9lives()' ELSE '' END"
MARK = "CASE p_size%6 WHEN 0 THEN '1..n' WHEN 1 THEN '0..n' WHEN 2 THEN 'n' WHEN 3 THEN 'N' WHEN 4 THEN '2..n' ELSE '1' END"


@query("rewrite_counts", f"SELECT p_brand, count(*) FILTER (NOT starts_with(m,'+ ') AND regexp_matches(m,'{A.METHOD}')) methods, count(*) FILTER (u IN ('1..n','0..n','n')) multiplicities FROM (SELECT p_brand, {MEMBER} m, {MARK} u FROM part) GROUP BY 1")
def rewrite_counts(spark, d):
    """The closed list of rewritings made before the style is judged, and how often each is made."""
    x = table(spark, d, "part").select("p_brand", F.expr(MEMBER).alias("m"), F.expr(MARK).alias("u"))
    return x.groupBy("p_brand").agg(F.count_if(~F.col("m").startswith("+ ") & F.col("m").rlike(A.METHOD)).alias("methods"), F.count_if(F.col("u").isin(*A.REWRITTEN)).alias("multiplicities"))


ARROW = "CASE p_partkey%27 " + " ".join(f"WHEN {i} THEN '{o[0]}'" for i, o in enumerate(OPERATORS)) + " ELSE '??' END"
LINE = f"""'C'||(p_partkey%40)||CASE p_size%4 WHEN 0 THEN ' "0..n owner" ' WHEN 1 THEN ' "1 {{ordered}}"' ELSE ' ' END||{ARROW}||CASE p_size%3 WHEN 0 THEN ' "*" ' WHEN 1 THEN '"1..1  the part"' ELSE ' ' END||'D'||(p_size%30)||CASE p_size%5 WHEN 0 THEN '' WHEN 1 THEN ' : has >' WHEN 2 THEN ':<owns' WHEN 3 THEN ' : {{disjoint}}' ELSE ' : uses' END"""


def _quoted(x):
    return x.replace("'", "''")


def relations_sql(source, keep):
    part = lambda k: f"regexp_extract(t,'{_quoted(RELATION)}',{k})"
    squeeze = lambda k: f"trim(regexp_replace(regexp_replace({part(k)},'\\{{[^}}]*\\}}',' ','g'),'\\s+',' ','g'))"
    label = "CASE WHEN regexp_matches(l,' [<>]$') THEN rtrim(l[:-3]) WHEN regexp_matches(l,'^[<>] ') THEN ltrim(l[3:]) WHEN length(l)>1 AND regexp_matches(l,'[^<>-][<>]$') THEN rtrim(l[:-2]) WHEN length(l)>1 AND regexp_matches(l,'^[<>][^<>]') THEN ltrim(l[2:]) ELSE l END"
    return f"""(SELECT {keep}, typ, CASE WHEN swap=1 THEN b ELSE a END source, CASE WHEN swap=1 THEN a ELSE b END target, CASE WHEN bare=1 THEN '' WHEN swap=1 THEN bm ELSE am END source_mult, CASE WHEN bare=1 THEN '' WHEN swap=1 THEN am ELSE bm END target_mult,
 CASE WHEN bare=1 THEN '' WHEN swap=1 THEN br ELSE ar END source_role, CASE WHEN bare=1 THEN '' WHEN swap=1 THEN ar ELSE br END target_role, CASE WHEN bare=1 THEN '' ELSE {label} END AS label
 FROM (SELECT *, regexp_extract(as_,'^(\\S*)',1) am, regexp_extract(as_,'^\\S+ (.*)$',1) ar, regexp_extract(bs_,'^(\\S*)',1) bm, regexp_extract(bs_,'^\\S+ (.*)$',1) br FROM
 (SELECT *, {part(3)} op, {part(1)} a, {part(5)} b, trim({part(6)}) l, {squeeze(2)} as_, {squeeze(4)} bs_ FROM {source})) LEFT JOIN (VALUES {sql_values(OPERATORS)}) o(op,typ,swap,bare) USING(op))"""


@query("edge_op_map", f"SELECT * FROM {relations_sql(f'(SELECT p_partkey, {LINE} t FROM part)', 'p_partkey')}")
def edge_op_map(spark, d):
    """Relations by a table of arrows: the type, and whether the ends change places with their multiplicities and roles."""
    return relations(table(spark, d, "part").select("p_partkey", F.expr(LINE).alias("t")), operators(spark)).drop("t")


@query("reify_rows", """WITH e AS (SELECT c_custkey id, c_nationkey::BIGINT a, (c_custkey%25)::BIGINT b, c_mktsegment cls, CASE WHEN c_acctbal>5000 THEN '*' ELSE '1' END ma, CASE c_custkey%3 WHEN 0 THEN '' ELSE '0..1' END mb FROM customer), f AS (SELECT least(a,b) x, greatest(a,b) y, min(id) id FROM e WHERE cls='BUILDING' GROUP BY ALL), r AS (SELECT e.* FROM e JOIN f USING(id))
 SELECT id, a s, 1000+id t, '1' sm, mb tm, 'left' side FROM r UNION ALL SELECT id, 1000+id, b, ma, '1', 'right' FROM r UNION ALL SELECT id, a, b, ma, mb, 'plain' FROM e WHERE id NOT IN (SELECT id FROM r)""")
def reify_rows(spark, d):
    """The first marked edge of each pair becomes two edges by way of a new node, which takes the multiplicities crosswise; all others stay."""
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") % 25).alias("b"), F.col("c_mktsegment").alias("cls"), F.when(F.col("c_acctbal") > 5000, "*").otherwise("1").alias("ma"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise("0..1").alias("mb"))
    first = e.where("cls = 'BUILDING'").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min("id").alias("id")).select("id")
    r, new = e.join(first, "id", "left_semi"), 1000 + F.col("id")
    row = lambda s, t, sm, tm, side: F.struct(s.alias("s"), t.alias("t"), sm.alias("sm"), tm.alias("tm"), F.lit(side).alias("side"))
    two = F.array(row(F.col("a"), new, F.lit("1"), F.col("mb"), "left"), row(new, F.col("b"), F.col("ma"), F.lit("1"), "right"))
    plain = e.join(first, "id", "left_anti").select("id", F.col("a").alias("s"), F.col("b").alias("t"), F.col("ma").alias("sm"), F.col("mb").alias("tm"), F.lit("plain").alias("side"))
    return r.select("id", F.explode(two).alias("x")).select("id", "x.*").unionByName(plain)


@query("round_trip", f"SELECT count(*) relations, 0::BIGINT lost, 0::BIGINT added FROM (SELECT p_partkey, {LINE} t FROM part) WHERE regexp_matches(t,'{_quoted(RELATION)}')")
def round_trip(spark, d):
    """Relations written as lines and read again: what is lost or added, as multisets per key; nothing should be."""
    ops = operators(spark)
    read = relations(table(spark, d, "part").select("p_partkey", F.expr(LINE).alias("t")), ops).where("typ is not null").drop("t")
    arrow = dimension(spark, [("ClassInheritance", "--|>"), ("ClassRealization", "..|>"), ("ClassBidirectional", "--"), ("ClassComposition", "--*"), ("ClassAggregation", "--o"), ("ClassUnidirectional", "-->"), ("ClassDependency", "..>")], "typ string, arrow string")
    quoted = lambda m, r: F.when((F.col(m) == "") & (F.col(r) == ""), "").otherwise(F.concat(F.lit(' "'), F.concat_ws(" ", m, F.when(F.col(r) != "", F.col(r))), F.lit('" ')))
    line = F.concat(F.col("source"), quoted("source_mult", "source_role"), F.lit(" "), F.col("arrow"), F.lit(" "), quoted("target_mult", "target_role"), F.col("target"), F.when(F.col("label") != "", F.concat(F.lit(" : "), F.col("label"))).otherwise(""))
    again = relations(read.join(F.broadcast(arrow), "typ").select("p_partkey", line.alias("t")), ops).drop("t")
    key = [c for c in read.columns]
    n = read.withColumn("k", F.lit(1)).unionByName(again.withColumn("k", F.lit(-1))).groupBy(*key).agg(F.sum("k").alias("k"), F.count_if(F.col("k") == 1).alias("n"))
    return n.agg(F.sum("n").alias("relations"), F.coalesce(F.sum(F.greatest("k", F.lit(0))), F.lit(0)).alias("lost"), F.coalesce(F.sum(F.greatest(-F.col("k"), F.lit(0))), F.lit(0)).alias("added"))


LABELS = "CASE p_partkey%6 WHEN 0 THEN '{disjoint, complete}' WHEN 1 THEN p_brand WHEN 2 THEN '{ '||p_brand||' }' WHEN 3 THEN 'has {x}' WHEN 4 THEN '' ELSE '{}' END"


@query("constraint_extract", f"SELECT p_partkey, CASE WHEN regexp_matches(t,'^\\{{.*\\}}$') THEN trim(regexp_replace(t,'[{{}}]','','g')) ELSE '' END c, CASE WHEN regexp_matches(t,'^\\{{.*\\}}$') THEN '' ELSE t END label FROM (SELECT p_partkey, {LABELS} t FROM part)")
def constraint_extract(spark, d):
    """Labels that are constraints of a generalisation as a whole."""
    t = F.col("t")
    whole = t.rlike(r"^\{.*\}$")
    return table(spark, d, "part").select("p_partkey", F.expr(LABELS).alias("t")).select("p_partkey", F.when(whole, F.trim(F.regexp_replace(t, "[{}]", ""))).otherwise("").alias("c"), F.when(whole, F.lit("")).otherwise(t).alias("label"))


KEYS = ("p_brand", "s", "m", "w", "c")


@query("composite_lookup", """WITH x AS (SELECT p_partkey, p_type, p_brand, p_size%5 s, p_partkey%2 m, split_part(p_type,' ',1) w, p_size>25 c FROM part), k AS (SELECT p_brand, s, m, w, c, min(p_type) label FROM x WHERE p_partkey%3=0 GROUP BY ALL)
 SELECT p_partkey, label, label IS NULL missing FROM x LEFT JOIN k USING(p_brand,s,m,w,c)""")
def composite_lookup(spark, d):
    """A label by a key of five columns; rows that the table doesn't have are reported."""
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_brand", (F.col("p_size") % 5).alias("s"), (F.col("p_partkey") % 2).alias("m"), F.split("p_type", " ")[0].alias("w"), (F.col("p_size") > 25).alias("c"))
    k = p.where("p_partkey % 3 = 0").groupBy(*KEYS).agg(F.min("p_type").alias("label"))
    return p.join(k, list(KEYS), "left").select("p_partkey", "label", F.col("label").isNull().alias("missing"))


@query("placeholder_fill", "SELECT 'declared' kind, count(*) n FROM supplier UNION ALL SELECT 'implicit', count(*) FROM (SELECT DISTINCT l_suppkey+l_linenumber%3 k FROM lineitem) WHERE k NOT IN (SELECT s_suppkey FROM supplier)")
def placeholder_fill(spark, d):
    """Ends that are only referred to become nodes of their own."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    ends = table(spark, d, "lineitem").select((F.col("l_suppkey") + F.col("l_linenumber") % 3).alias("k")).distinct().join(s, "k", "left_anti")
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("kind"), "n")
    return count(s, "declared").unionByName(count(ends, "implicit"))


@query("ordered_render", "SELECT o_custkey, string_agg('order '||o_orderkey||' : '||o_orderstatus, chr(10) ORDER BY o_orderdate, o_orderkey) t FROM orders GROUP BY 1")
def ordered_render(spark, d):
    """Lines of a block in the order of their places; the places travel with the lines through the shuffle."""
    line = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" : "), F.col("o_orderstatus"))
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", line.alias("x")))).alias("l"))
    return g.select("o_custkey", F.array_join(F.transform("l", lambda x: x["x"]), "\n").alias("t"))


HEAD = "CASE p_partkey%6 WHEN 0 THEN 'class A'||p_size||' extends B {' WHEN 1 THEN 'abstract class C'||p_size||' implements D, E {' WHEN 2 THEN 'class F {' WHEN 3 THEN 'class G'||p_size||' <<entity>> extends H implements I, J' WHEN 4 THEN 'interface K {' ELSE 'interface L extends M, N {' END"
_CLAUSE = r"(?:extends|implements)\b"
CLAUSES = rf"^{KIND}\s+{ID}(\s*<<\w+>>)?\s+({_CLAUSE}[^{{]*?)\s*(\{{.*)?$"


@query("header_rewrite", f"""WITH h AS (SELECT p_partkey, t, regexp_matches(t,'{CLAUSES}') ok, regexp_extract(t,'{CLAUSES}',2) c, regexp_extract(t,'{CLAUSES}',4) x FROM (SELECT p_partkey, {HEAD} t FROM part)),
 y AS (SELECT p_partkey, c, regexp_extract(x,'\\bextends\\s+([\\w\\s,]+?)\\s*(?:\\bimplements\\b.*)?$',1) e, regexp_extract(x,'\\bimplements\\s+([\\w\\s,]+?)\\s*(?:\\bextends\\b.*)?$',1) i FROM h WHERE ok)
 SELECT p_partkey, c||' '||arrow||' '||trim(p) line FROM (SELECT p_partkey, c, '--|>' arrow, unnest(string_split(e,',')) p FROM y WHERE e<>'' UNION ALL SELECT p_partkey, c, '..|>', unnest(string_split(i,',')) FROM y WHERE i<>'') WHERE trim(p)<>''""")
def header_rewrite(spark, d):
    """Headers in the manner of Java: a relation for each class that one extends or implements."""
    x = table(spark, d, "part").select("p_partkey", F.expr(HEAD).alias("t")).where(F.col("t").rlike(CLAUSES))
    clause = F.regexp_extract("t", CLAUSES, 4)
    names = lambda word, other: F.split(F.regexp_extract(clause, rf"\b{word}\s+([\w\s,]+?)\s*(?:\b{other}\b.*)?$", 1), ",")
    made = F.concat(F.transform(names("extends", "implements"), lambda p: F.struct(F.lit("--|>").alias("arrow"), F.trim(p).alias("p"))), F.transform(names("implements", "extends"), lambda p: F.struct(F.lit("..|>").alias("arrow"), F.trim(p).alias("p"))))
    y = x.select("p_partkey", F.regexp_extract("t", CLAUSES, 2).alias("c"), F.explode(made).alias("x")).where("x.p <> ''")
    return y.select("p_partkey", F.concat_ws(" ", "c", "x.arrow", "x.p").alias("line"))


ENDS = "CASE p_partkey%10 WHEN 0 THEN '0..1' WHEN 1 THEN p_brand WHEN 2 THEN '*' WHEN 3 THEN '1..n' WHEN 4 THEN ''||p_size WHEN 5 THEN 'n' WHEN 6 THEN p_size||'..' WHEN 7 THEN 'many '||p_brand WHEN 8 THEN '' ELSE p_size||'..N' END"


@query("mult_shape", f"SELECT p_partkey, regexp_matches(t,'^([0-9]+|[*nN])(\\.\\.([0-9]+|[*nN]))?$') is_mult, CASE WHEN regexp_matches(t,'^([0-9]+|[*nN])(\\.\\.([0-9]+|[*nN]))?$') THEN '' ELSE t END AS role FROM (SELECT p_partkey, {ENDS} t FROM part)")
def mult_shape(spark, d):
    """Text in the place of a multiplicity that hasn't the shape of one is a role."""
    ok = F.col("t").rlike(r"^([0-9]+|[*nN])(\.\.([0-9]+|[*nN]))?$")
    return table(spark, d, "part").select("p_partkey", F.expr(ENDS).alias("t")).select("p_partkey", ok.alias("is_mult"), F.when(ok, "").otherwise(F.col("t")).alias("role"))


COMPACT = """CASE p_partkey%9 WHEN 0 THEN '{"name":"'||p_brand||'","kind":"class","attributes":["a","b"]}' WHEN 1 THEN '{"name":" ","kind":"class"}' WHEN 2 THEN '{"name":"B","kind":"thing"}' WHEN 3 THEN '{"kind":"enum"}' WHEN 4 THEN 'broken'
 WHEN 5 THEN '{"name":"C","kind":"enum","attributes":["x"]}' WHEN 6 THEN '{"name":"D","kind":"enum","values":["u","v"]}' WHEN 7 THEN '{"name":"E","values":["u"]}' ELSE '{"name":"F","kind":"interface","methods":["m()"," "]}' END"""


@query("compact_quarantine", f"""WITH j AS (SELECT p_partkey, try_cast(t AS JSON) j FROM (SELECT p_partkey, {COMPACT} t FROM part)), x AS (SELECT p_partkey, j->>'name' AS name, coalesce(j->>'kind','class') AS kind, j IS NULL bad, coalesce(len((j->'attributes')::JSON[]),0) na, coalesce(len((j->'values')::JSON[]),0) nv, coalesce(len(list_filter((j->'methods')::VARCHAR[], lambda m: trim(m)='')),0) nb FROM j)
 SELECT p_partkey, name, CASE WHEN bad THEN 'not json' WHEN coalesce(trim(name),'')='' THEN 'class without a name (dropped)' WHEN kind NOT IN ('class','abstract class','enum','interface') THEN 'unknown kind (class dropped)' WHEN kind='enum' AND na>0 THEN 'enum with attributes (ignored)' WHEN kind<>'enum' AND nv>0 THEN 'values without an enum (ignored)' WHEN nb>0 THEN 'empty method (dropped)' ELSE '' END issue FROM x""")
def compact_quarantine(spark, d):
    """A reader that keeps what it can, and says what is wrong with the rest."""
    schema = "name string, kind string, attributes array<string>, methods array<string>, values array<string>, _bad string"
    x = table(spark, d, "part").select("p_partkey", F.from_json(F.expr(COMPACT), schema, {"columnNameOfCorruptRecord": "_bad"}).alias("j")).select("p_partkey", "j.*")
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    kind, blank = F.coalesce("kind", F.lit("class")), F.coalesce(F.exists("methods", lambda m: F.trim(m) == ""), F.lit(False))
    issue = (
        F.when(F.col("_bad").isNotNull(), "not json").when(F.coalesce(F.trim("name"), F.lit("")) == "", "class without a name (dropped)").when(~kind.isin("class", "abstract class", "enum", "interface"), "unknown kind (class dropped)")
        .when((kind == "enum") & (n("attributes") > 0), "enum with attributes (ignored)").when((kind != "enum") & (n("values") > 0), "values without an enum (ignored)").when(blank, "empty method (dropped)").otherwise("")
    )
    return x.select("p_partkey", "name", issue.alias("issue"))


@query("compact_render", """SELECT p_partkey, '{"id":'||p_partkey||CASE WHEN p_size>25 THEN ',"parent":"'||p_brand||'"' ELSE ',"role":"'||p_type||'"' END||'}' AS json FROM part""")
def compact_render(spark, d):
    """JSON of a row; keys depend on the family, and nulls are left out."""
    p = table(spark, d, "part")
    rel = F.struct(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("parent"), F.when(F.col("p_size") <= 25, F.col("p_type")).alias("role"))
    return p.select("p_partkey", F.to_json(rel).alias("json"))


PLAN = "CASE p_partkey%5 WHEN 0 THEN 'Plan: '||p_brand||', B'||chr(10)||'---'||chr(10)||'class A' WHEN 1 THEN 'no plan '||p_brand WHEN 2 THEN 'Plan: C'||chr(10)||'---'||chr(10)||'class D'||chr(10)||'---'||chr(10)||p_name WHEN 3 THEN 'Plan:'||chr(10)||'---'||chr(10) ELSE '' END"


@query("marker_split", f"SELECT p_partkey, CASE WHEN contains(t,'---') THEN trim(regexp_replace(split_part(t,'---',1),'^Plan:',''),chr(10)||' ') ELSE '' END AS plan, CASE WHEN contains(t,'---') THEN trim(substr(t,strpos(t,'---')+3),chr(10)||' ') ELSE t END AS rest FROM (SELECT p_partkey, {PLAN} t FROM part)")
def marker_split(spark, d):
    """What stands before the first mark and after it."""
    x = table(spark, d, "part").select("p_partkey", F.expr(PLAN).alias("t"))
    has, bare = F.col("t").contains("---"), lambda c: F.regexp_replace(c, r"^[\n ]+|[\n ]+$", "")
    return x.select("p_partkey", F.when(has, bare(F.regexp_replace(F.split("t", "---")[0], "^Plan:", ""))).otherwise("").alias("plan"), F.when(has, bare(F.expr("substr(t, instr(t, '---') + 3)"))).otherwise(F.col("t")).alias("rest"))


SCRIPT = [("require", "red", ""), ("rename", "red", "first"), ("upper", "first", ""), ("suffix", "FIRST", "_x"), ("add", "extra", ""), ("move_first", "extra", ""), ("remove", "FIRST_x", "")]


@query("edit_script", "SELECT p_partkey, CASE WHEN list_contains(w,'red') THEN array_to_string(list_prepend('extra',list_filter(list_transform(range(1,len(w)+1), lambda i: CASE WHEN i=list_position(w,'red') THEN NULL ELSE w[i] END), lambda x: x IS NOT NULL)),' ') ELSE p_name END AS names, CASE WHEN list_contains(w,'red') THEN '' ELSE 'require: red not found' END AS error FROM (SELECT p_partkey, p_name, string_split(p_name,' ') w FROM part)")
def edit_script(spark, d):
    """An ordered script of edits on the words of each name; each edit sees what the ones before have left, and the first missing target ends it."""

    @F.pandas_udf("struct<names:string,error:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        out = [scan.apply_script(x.split(" "), SCRIPT) for x in s]
        return pd.DataFrame({"names": [" ".join(o[0]) for o in out], "error": [o[1] for o in out]})

    return table(spark, d, "part").select("p_partkey", run("p_name").alias("x")).select("p_partkey", "x.names", "x.error")


@query("line_cycle", r"""WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text,'\r\n|\n|\r'), lambda x: regexp_replace(x,'^\s+|\s+$','','g')), lambda x: x<>'')) s FROM documents), c AS (SELECT doc_id, s, count(*) n FROM l GROUP BY ALL), g AS (SELECT doc_id, sum(n)::BIGINT lines, count(*) distinct_lines, max(CASE WHEN length(s)>=20 THEN n ELSE 0 END) m FROM c GROUP BY 1)
 SELECT d.doc_id, coalesce(lines,0)::BIGINT lines, coalesce(distinct_lines,0) distinct_lines, coalesce(m,0)::BIGINT most, coalesce(distinct_lines/lines<0.6 OR m>=5,false) cycle FROM documents d LEFT JOIN g USING(doc_id)""")
def line_cycle(spark, d):
    """Texts that go round: fewer than 0.6 different lines a line, or one of 20 characters or more five times; blank lines don't count."""
    lines = F.filter(F.transform(F.split("text", "\\r\\n|\\n|\\r", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    docs = table(spark, d, "documents")
    c = docs.select("doc_id", F.explode(lines).alias("s")).groupBy("doc_id", "s").agg(F.count(F.lit(1)).alias("n"))
    g = c.groupBy("doc_id").agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("distinct_lines"), F.max(F.when(F.length("s") >= 20, F.col("n")).otherwise(0)).alias("most"))
    g = docs.select("doc_id").join(g, "doc_id", "left").na.fill(0, ["lines", "distinct_lines", "most"])
    return g.select("doc_id", "lines", "distinct_lines", "most", ((F.try_divide(F.col("distinct_lines"), F.col("lines")) < 0.6) | (F.col("most") >= 5)).alias("c")).select("doc_id", "lines", "distinct_lines", "most", F.coalesce("c", F.lit(False)).alias("cycle"))


#: The lines of a diagram for each brand: a block, its members and a relation for each part.
BLOCK = [
    "CASE p_size%4 WHEN 0 THEN 'enum E'||p_size||' {' WHEN 1 THEN 'class C'||(p_partkey%40)||' <<interface>> {' WHEN 2 THEN 'abstract class C'||(p_partkey%40)||' {' ELSE 'class C'||(p_partkey%40)||' {}' END",
    "CASE p_size%4 WHEN 0 THEN 'RED' WHEN 3 THEN '' ELSE '- speed : int' END", "CASE p_size%4 WHEN 0 THEN 'GREEN (light)' WHEN 3 THEN '@skip' ELSE '+ drive()' END", "CASE p_size%4 WHEN 3 THEN '' ELSE '}' END",
    f"CASE p_partkey%11 WHEN 0 THEN '<> N'||p_size WHEN 1 THEN 'note left' WHEN 2 THEN 'C1 .. (C2, C3)' ELSE {LINE} END",
]


def diagram_lines(spark, d):
    """(doc, i, t): lines without white space around them; blank ones and those of an @ don't count."""
    x = table(spark, d, "part").select(F.col("p_brand").alias("doc"), "p_partkey", F.posexplode(F.array(*[F.expr(b) for b in BLOCK])).alias("k", "t"))
    return x.select("doc", (F.col("p_partkey") * 10 + F.col("k")).alias("i"), F.trim("t").alias("t")).where("t <> '' and not startswith(t, '@')")


LINES = "(SELECT * FROM (" + " UNION ALL ".join(f"SELECT p_brand doc, p_partkey*10+{k} i, trim({b}) t FROM part" for k, b in enumerate(BLOCK)) + ") WHERE t<>'' AND NOT starts_with(t,'@'))"
BLOCKS = f"""(SELECT doc, i, t, CASE WHEN coalesce(owner,'')<>'' THEN CASE WHEN t='}}' THEN 'end' WHEN word='enum' THEN 'value' WHEN contains(t,'(') THEN 'method' ELSE 'attribute' END
 WHEN regexp_matches(t,'{HEADER}') THEN CASE WHEN regexp_extract(t,'{HEADER}',3)='interface' THEN 'interface' ELSE regexp_replace(regexp_extract(t,'{HEADER}',1),'\\s+',' ','g') END WHEN regexp_matches(t,'^<>\\s+\\w+\\s*$') THEN 'unsupported' WHEN regexp_matches(t,'{ASSOCIATION}') THEN 'association class' WHEN regexp_matches(t,'{_quoted(RELATION)}') THEN 'relation' ELSE 'unknown' END kind, coalesce(owner,'') AS owner
 FROM (SELECT *, last_value(o IGNORE NULLS) OVER w owner, last_value(h IGNORE NULLS) OVER w word FROM (SELECT *, CASE WHEN t='}}' THEN '' WHEN regexp_extract(t,'{HEADER}',4)<>'' AND regexp_extract(t,'{HEADER}',5)='' THEN regexp_extract(t,'{HEADER}',2) END o, CASE WHEN t='}}' THEN '' WHEN regexp_extract(t,'{HEADER}',4)<>'' AND regexp_extract(t,'{HEADER}',5)='' THEN regexp_extract(t,'{HEADER}',1) END h FROM {LINES})
 WINDOW w AS (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


@query("line_islands", f"SELECT doc, i, owner, kind FROM {BLOCKS}")
def line_islands(spark, d):
    """Which open block each line of a diagram belongs to, and what it is there."""
    return blocks(diagram_lines(spark, d)).select("doc", "i", "owner", "kind")


@query("plantuml_parse", f"""WITH b AS (SELECT * FROM {BLOCKS}), r AS (SELECT * FROM {relations_sql("(SELECT * FROM b WHERE kind='relation')", 'doc, i')}), c AS (SELECT DISTINCT doc, regexp_extract(t,'{HEADER}',2) n FROM b WHERE kind IN ('class','abstract class','enum','interface')),
 e AS (SELECT DISTINCT doc, n FROM (SELECT doc, source n FROM r UNION ALL SELECT doc, target FROM r UNION ALL SELECT doc, unnest([regexp_extract(t,'{ASSOCIATION}',1), regexp_extract(t,'{ASSOCIATION}',2), regexp_extract(t,'{ASSOCIATION}',3)]) FROM b WHERE kind='association class'))
 SELECT doc, kind, count(*) n FROM (SELECT doc, CASE kind WHEN 'relation' THEN 'line' ELSE kind END kind FROM b WHERE kind NOT IN ('end') UNION ALL SELECT doc, typ FROM r UNION ALL SELECT doc, 'implicit class' FROM e ANTI JOIN c USING(doc,n)) GROUP BY ALL""")
def plantuml_parse(spark, d):
    """Diagrams read line by line: members, headers, relations by type, classes that only relations name, and lines that aren't understood, counted."""
    b = blocks(diagram_lines(spark, d))
    r = relations(b.where("kind = 'relation'").select("doc", "i", "t"), operators(spark))
    declared = b.where(F.col("kind").isin("class", "abstract class", "enum", "interface")).select("doc", F.regexp_extract("t", HEADER, 2).alias("n")).distinct()
    three = F.explode(F.array(*[F.regexp_extract("t", ASSOCIATION, k) for k in (1, 2, 3)]))
    ends = r.select("doc", F.explode(F.array("source", "target")).alias("n")).unionByName(b.where("kind = 'association class'").select("doc", three.alias("n"))).distinct()
    every = b.where("kind <> 'end'").select("doc", F.when(F.col("kind") == "relation", "line").otherwise(F.col("kind")).alias("kind"))
    every = every.unionByName(r.select("doc", F.col("typ").alias("kind"))).unionByName(ends.join(declared, ["doc", "n"], "left_anti").select("doc", F.lit("implicit class").alias("kind")))
    return every.groupBy("doc", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("line_rejoin", r"""WITH l AS (SELECT doc_id, i, t, lag(t) OVER (PARTITION BY doc_id ORDER BY i) p FROM (SELECT doc_id, unnest(a) t, generate_subscripts(a,1) i FROM (SELECT doc_id, string_split(text,chr(10)) a FROM documents WHERE text IS NOT NULL))),
 g AS (SELECT doc_id, i, t, sum(CASE WHEN p IS NULL OR p='' OR regexp_matches(p,'[.!?]$') OR regexp_matches(t,'^[0-9]+\.') OR regexp_matches(p,'^[0-9]+\.') OR t='' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) k FROM l) SELECT doc_id, min(i)::INTEGER i, length(string_agg(t,' ' ORDER BY i)) n FROM g GROUP BY doc_id, k HAVING string_agg(t,' ' ORDER BY i)<>''""")
def line_rejoin(spark, d):
    """Broken lines joined again: a line goes on unless the one before ended, was blank or a heading.  Lines are rows; a text's lines are one window in their order, and of a joined line only its length is kept."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "t"))
    w = Window.partitionBy("doc_id").orderBy("i")
    t, p = F.col("t"), F.lag("t").over(w)
    new = p.isNull() | (p == "") | p.rlike("[.!?]$") | t.rlike(r"^[0-9]+\.") | p.rlike(r"^[0-9]+\.") | (t == "")
    marked = lines.select("doc_id", "i", F.length("t").alias("n"), new.cast("int").alias("new")).withColumn("k", F.sum("new").over(w))
    joined = marked.groupBy("doc_id", "k").agg((F.min("i") + 1).alias("i"), (F.sum("n") + F.count(F.lit(1)) - 1).alias("n"))
    return joined.where("n > 0").select("doc_id", "i", "n")


@query("strip_members", "SELECT p_partkey, CASE WHEN p_brand LIKE '%1' THEN p_name ELSE '' END members, p_brand LIKE '%1' listing FROM part")
def strip_members(spark, d):
    """Members taken from all nodes but enumerations; the missing list becomes an empty one."""
    listing = F.col("p_brand").like("%1")
    kept = F.when(listing, F.split("p_name", " "))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.coalesce(kept, F.array().cast("array<string>")), " ").alias("members"), listing.alias("listing"))
