"""Queries of compact class diagrams: the tolerant reader, and differences of two versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import compact as C
from ..sources.tables import dealt, table
from .registry import query

#: A record of each part, in an SQL that both engines read.
SECOND = """CASE p_partkey%9 WHEN 0 THEN '{"name":" "}' WHEN 1 THEN '{"name":"B","kind":"thing","x":1}' WHEN 2 THEN '{"kind":"enum"}' WHEN 3 THEN '{"name":"B","kind":"enum","attributes":["q"],"values":["u","v"]}' WHEN 4 THEN '{"name":"B","values":["u"]}'
 WHEN 5 THEN '{"name":"A'||p_size||'"},{"name":"B","kind":"interface"}' WHEN 6 THEN '{"name":"B","methods":"m()"}' WHEN 7 THEN '{"name":"B","colour":1,"kind":"","methods":["m()"]}' ELSE '{"name":"B","kind":null},7' END"""
LINK = """CASE p_partkey%11 WHEN 0 THEN '{"type":"association","source":"A'||p_size||'","target":"B","label":"has","sourceMultiplicity":null,"targetRole":"'||p_brand||'"}' WHEN 1 THEN '{"type":"composition","whole":"A'||p_size||'","part":"B","partMultiplicity":"*"}'
 WHEN 2 THEN '{"type":"composition","source":"A'||p_size||'","target":"B"}' WHEN 3 THEN '{"type":"inheritance","child":"B","parent":"A'||p_size||'","label":"","source":null}' WHEN 4 THEN '{"type":"inheritance","child":"B"}' WHEN 5 THEN '{"type":"link","source":"A","target":"B"}'
 WHEN 6 THEN '{"type":"dependency","source":"A'||p_size||'","target":"Z","note":1}' WHEN 7 THEN '"text"' WHEN 8 THEN '{"type":"realization","child":"B","parent":"A'||p_size||'","label":"x","why":2}' WHEN 9 THEN '{"type":"aggregation","whole":"B","part":"A'||p_size||'","wholeRole":5}'
 ELSE '{"type":"unidirectional","source":"A'||p_size||'","target":""}' END"""
RECORD = f"""CASE WHEN p_partkey%17=0 THEN 'broken {{' WHEN p_partkey%19=0 THEN '[1]' WHEN p_partkey%23=0 THEN '{{"relations":[]}}' ELSE '{{"classes":[{{"name":"A'||p_size||'","attributes":["x : int"'||CASE p_partkey%5 WHEN 0 THEN ',7' WHEN 1 THEN '," "' ELSE '' END||']}},'||{SECOND}||']'
 ||CASE WHEN p_partkey%13=0 THEN ',"note":"n"' ELSE '' END||CASE WHEN p_partkey%29=0 THEN ',"relations":{{"a":1}}' WHEN p_partkey%7=0 THEN '' ELSE ',"relations":['||{LINK}||']' END||'}}' END"""

_T = lambda j, p: f"coalesce(json_type({j},'{p}'),'')"
_EMPTY = lambda j, p: f"({_T(j, p)} IN ('','NULL') OR {j}->>'{p}'='')"
_ARR = lambda j, k: f"CASE WHEN {_T(j, '$.' + k)}='ARRAY' THEN ({j}->'$.{k}')::JSON[] ELSE [] END"
_GOOD = "json_type(e)='VARCHAR' AND trim(e->>'$')<>''"
_FAMILY = "CASE rel " + " ".join(f"WHEN '{k}' THEN '{f}'" for k, (_, f) in C.TYPES.items()) + " END"
_EDGE = "CASE rel " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, (t, _) in C.TYPES.items()) + " END"
_OWN = "CASE family " + " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in C.FAMILIES.items()) + " END"
_BY = lambda i: "CASE family " + " ".join(f"WHEN '{k}' THEN CASE WHEN {_T('r', '$.' + v[i])}='VARCHAR' THEN r->>'$.{v[i]}' END" for k, v in C.FAMILIES.items() if i < len(v)) + " END"
_ODD = " || ".join("CASE family " + " ".join(f"WHEN '{k}' THEN CASE WHEN {_T('r', '$.' + v[i])} NOT IN ('','NULL','VARCHAR') THEN ['value not text'] ELSE [] END" for k, v in C.FAMILIES.items() if i < len(v)) + " ELSE [] END" for i in range(2, 7))
_FILLED = "CASE k " + " ".join(f"WHEN '{n}' THEN NOT {_EMPTY('r', '$.' + n)}" for n in C.KNOWN) + " ELSE true END"
_INNER = " || ".join(
    [f"CASE WHEN {_T('c', '$.' + k)}<>'ARRAY' AND NOT {_EMPTY('c', '$.' + k)} THEN ['{k} not a list'] ELSE [] END || list_transform(list_filter({_ARR('c', k)}, lambda e: NOT ({_GOOD})), lambda e: 'element of {k}')" for k in ("attributes", "methods", "values")]
    + [f"CASE WHEN kind='enum' AND len(list_filter({_ARR('c', k)}, lambda e: {_GOOD}))>0 THEN ['enum with {k}'] ELSE [] END" for k in ("attributes", "methods")]
    + [f"CASE WHEN kind<>'enum' AND len(list_filter({_ARR('c', 'values')}, lambda e: {_GOOD}))>0 THEN ['values without an enum'] ELSE [] END"]
)
_LISTED = lambda k: f"array_to_string(list_transform(list_filter({_ARR('c', k)}, lambda e: {_GOOD}), lambda e: e->>'$'),';')"


@query("compact_read", f"""WITH t AS (SELECT p_partkey id, {RECORD} t FROM part), v AS (SELECT id, CASE WHEN json_valid(t) THEN t::JSON END v FROM t), w AS (SELECT *, CASE WHEN v IS NULL THEN 'not json' WHEN json_type(v)<>'OBJECT' THEN 'not an object' WHEN {_T('v', '$.classes')}<>'ARRAY' THEN 'no class list' END top FROM v),
 wi AS (SELECT id, unnest(CASE WHEN top IN ('not json','not an object') THEN [top] ELSE list_transform(list_filter(json_keys(v), lambda k: k NOT IN ('classes','relations')), lambda k: 'top-level key') || CASE WHEN top IS NOT NULL THEN [top] WHEN {_T('v', '$.relations')}<>'ARRAY' AND NOT {_EMPTY('v', '$.relations')} THEN ['relations not a list'] ELSE [] END END) issue FROM w),
 c0 AS (SELECT id, unnest(a) c, generate_subscripts(a,1)-1 pos FROM (SELECT id, {_ARR('v', 'classes')} a FROM w WHERE top IS NULL)), c1 AS (SELECT *, json_type(c)='OBJECT' AND {_T('c', '$.name')}='VARCHAR' AND trim(c->>'$.name')<>'' named, c->>'$.name' AS name, CASE WHEN {_EMPTY('c', '$.kind')} THEN 'class' WHEN {_T('c', '$.kind')}='VARCHAR' THEN c->>'$.kind' ELSE '?' END kind FROM c0),
 c2 AS (SELECT *, named AND kind IN ('class','abstract class','enum','interface') valid FROM c1), c3 AS (SELECT *, valid AND sum(valid::INT) OVER (PARTITION BY id, name ORDER BY pos)=1 kept, CASE WHEN json_type(c)='OBJECT' THEN list_transform(list_filter(json_keys(c), lambda k: k NOT IN ('name','kind','attributes','methods','values')), lambda k: 'class key') ELSE [] END keys FROM c2),
 ci AS (SELECT id, pos, unnest(CASE WHEN NOT named THEN ['class without a name'] WHEN NOT valid THEN keys || ['class kind'] WHEN NOT kept THEN keys || ['class repeated'] ELSE keys || {_INNER} END) issue FROM c3), nm AS (SELECT id, list(name) names FROM c3 WHERE kept GROUP BY 1),
 r0 AS (SELECT id, unnest(a) r, generate_subscripts(a,1)-1 pos FROM (SELECT id, {_ARR('v', 'relations')} a FROM w WHERE top IS NULL)), r1 AS (SELECT *, CASE WHEN json_type(r)='OBJECT' AND {_T('r', '$.type')}='VARCHAR' THEN r->>'$.type' END rel FROM r0), r2 AS (SELECT *, {_FAMILY} family FROM r1),
 r3 AS (SELECT r2.*, names, nullif({_BY(0)},'') source, nullif({_BY(1)},'') target, CASE WHEN family IS NULL THEN [] ELSE list_filter(json_keys(r), lambda k: k<>'type' AND NOT list_contains({_OWN}, k) AND {_FILLED}) END others FROM r2 LEFT JOIN nm USING(id)),
 r4 AS (SELECT *, family IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL ends, coalesce(list_contains(names,source) AND list_contains(names,target),false) known FROM r3),
 ri AS (SELECT id, pos, unnest(CASE WHEN family IS NULL THEN ['relation type'] WHEN NOT ends THEN [CASE WHEN len(list_intersect(others,{C.KNOWN}))>0 THEN 'ends of another family' ELSE 'end missing' END] WHEN NOT known THEN list_transform(others, lambda k: 'relation key') || ['undeclared class'] ELSE list_transform(others, lambda k: 'relation key') || {_ODD} END) issue FROM r4)
 SELECT id p_partkey, 'class' what, pos::INTEGER pos, name || ' ' || kind a, CASE WHEN kind='enum' THEN {_LISTED('values')} ELSE {_LISTED('attributes')} END b, CASE WHEN kind='enum' THEN '' ELSE {_LISTED('methods')} END c FROM c3 WHERE kept
 UNION ALL SELECT id, 'relation', pos, {_EDGE}, source||'>'||target, concat_ws(';', {', '.join(f"coalesce({_BY(i)},'')" for i in range(2, 7))}) FROM r4 WHERE ends AND known
 UNION ALL SELECT id, 'issue', 0, issue, 'record', '' FROM wi UNION ALL SELECT id, 'issue', pos, issue, 'class', '' FROM ci UNION ALL SELECT id, 'issue', pos, issue, 'relation', '' FROM ri""")
def compact_read(spark, d):
    """Classes and relations that a tolerant reader keeps of each record, and all issues of what it doesn't."""
    x = C.judged_records(dealt(table(spark, d, "part").select("p_partkey", "p_size", "p_brand")).select(F.col("p_partkey").alias("id"), F.expr(RECORD).alias("t")))
    row = lambda what, pos, a, b, c: F.struct(F.lit(what).alias("what"), pos.alias("pos"), a.alias("a"), b.alias("b"), c.alias("c"))
    listed = lambda c: F.array_join(c, ";")
    kept = lambda k, f: F.transform(F.filter(k, lambda x: x["kept"]), f)
    classes = kept("classes", lambda x: row("class", x["pos"], F.concat_ws(" ", x["name"], x["kind"]), listed(x["members"]), listed(x["methods"])))
    relations = kept("relations", lambda x: row("relation", x["pos"], x["typ"], F.concat_ws(">", x["source"], x["target"]), F.concat_ws(";", *[x[k] for k in C.FIELDS[2:]])))
    issues = F.transform(C.issue_rows(), lambda x: row("issue", x["pos"], x["issue"], x["part"], F.lit("")))
    rows = F.flatten(F.array_compact(F.array(classes, relations, issues)))
    return x.select(F.col("id").alias("p_partkey"), F.explode(rows).alias("x")).select("p_partkey", "x.*")


BEFORE = """'{"id":'||p_partkey||',"name":"'||p_brand||'","tags":["'||p_name||'",'||p_size||'],"deep":{"a":{"b":['||p_size%3||',{"c":"'||p_type||'"}]}},"gone":'||CASE WHEN p_partkey%3=0 THEN 'null' ELSE '1' END||'}'"""
AFTER = """'{"id":'||p_partkey||',"name":"'||CASE WHEN p_partkey%4=0 THEN 'other' ELSE p_brand END||'","tags":["'||p_name||'"'||CASE WHEN p_partkey%5=0 THEN '' ELSE ','||p_size END||'],"deep":{"a":{"b":['||p_size%2||',{"c":"'||p_type||'"}]}}'||CASE p_partkey%6 WHEN 0 THEN ',"gone":null' WHEN 1 THEN ',"gone":"1"' WHEN 2 THEN '' ELSE ',"gone":1,"new":{"x":[]}' END||'}'"""


@query("json_diff", """WITH p AS (SELECT *, p_partkey%6 m FROM part), d AS (SELECT p_partkey, unnest([
  {'p':'$.name','c':CASE WHEN p_partkey%4=0 THEN 'changed' END}, {'p':'$.tags','c':CASE WHEN p_partkey%5=0 THEN 'changed' END}, {'p':'$.deep.a.b[0]','c':CASE WHEN p_size%3<>p_size%2 THEN 'changed' END},
  {'p':'$.gone','c':CASE WHEN m=2 THEN 'removed' WHEN m=0 AND p_partkey%3<>0 THEN 'changed' WHEN m=1 THEN 'changed' WHEN m>2 AND p_partkey%3=0 THEN 'changed' END}, {'p':'$.new','c':CASE WHEN m>2 THEN 'added' END}]) x FROM p)
 SELECT p_partkey, x.p path, x.c change FROM d WHERE x.c IS NOT NULL""")
def json_diff(spark, d):
    """Where two versions of each part's record differ."""
    rows = dealt(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    version = lambda sql: rows.select(F.col("p_partkey").alias("id"), F.parse_json(F.expr(sql)).alias("v"))
    return C.json_diff(version(BEFORE), version(AFTER)).withColumnRenamed("id", "p_partkey")
