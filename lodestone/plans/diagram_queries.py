"""Queries of folders of diagrams: written, read back as a source, and turned into classes, members, relations and issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.edits import CONTAINERS, PLAIN_ARROWS, run_script
from ..operators import diagrams as D
from ..operators.retrieval import shared_folder
from ..sources import diagrams
from ..sources.tables import table
from .parsing_queries import BLOCK, LINE, _quoted, relations_sql
from .registry import query
from .text_queries import PLAIN

#: The lines that a part adds to its diagram: a block with members, and a line that names others.
TEXT = [
    "CASE p_size%7 WHEN 0 THEN 'enum E'||p_size||' <<enum>> {' WHEN 1 THEN 'class C'||(p_partkey%40)||' <<interface>> {' WHEN 2 THEN '  abstract  class C'||(p_partkey%40)||' {' WHEN 3 THEN 'class C'||(p_size%9)||' <<entity>> {' WHEN 4 THEN 'interface D'||(p_size%30)||' {' WHEN 5 THEN 'class C'||p_size ELSE 'class C'||(p_partkey%40)||' {}' END",
    "CASE p_size%7 WHEN 0 THEN 'RED' WHEN 5 THEN '' WHEN 6 THEN '@skip' WHEN 3 THEN 'int size {frozen}' ELSE '- speed : int = 3' END", "CASE p_size%7 WHEN 0 THEN 'GREEN (light)' WHEN 5 THEN ' ' WHEN 6 THEN '' ELSE '  + drive()' END", "CASE WHEN p_size%7>4 THEN '' ELSE '}' END",
    f"""CASE p_partkey%13 WHEN 0 THEN CASE WHEN p_partkey%5=0 THEN '<> N'||p_size ELSE 'Note "kept" as N'||(p_size%3) END WHEN 1 THEN 'note left' WHEN 2 THEN 'C1 .. (C2, C3)' WHEN 3 THEN '( C4,C5 ) . A'||p_size WHEN 4 THEN 'N'||(p_size%5)||' .. (C1, C2)' WHEN 5 THEN 'N'||(p_size%5)||' .. C'||p_size
 WHEN 6 THEN 'C7 -- N'||(p_size%4) WHEN 7 THEN 'note "n" as N'||(p_size%4) WHEN 8 THEN 'C8 "{{ordered}} 1 {{unique}}" *-- "0..1 part" C9 : has >' ELSE {LINE} END""",
]
assert len(TEXT) == len(BLOCK)
#: Twenty parts make a diagram, ten diagrams go to the next folder; one of twelve folders holds shared material.
WHERE = ("CASE (p_partkey//200)%12 WHEN 5 THEN '_shared' ELSE 'm'||((p_partkey//200)%12) END", "'d'||(p_partkey//20)||CASE WHEN p_partkey//20%31=0 THEN '.md' ELSE '.puml' END")


def diagram_texts(spark, d):
    """(folder, name, text) of the diagrams; a text has the lines of twenty parts."""
    spark_of = lambda s: s.replace("//", " div ")
    p = table(spark, d, "part").select(F.expr(spark_of(WHERE[0])).alias("folder"), F.expr(spark_of(WHERE[1])).alias("name"), "p_partkey", F.array_join(F.array(*[F.expr(b) for b in TEXT]), "\n").alias("t"))
    lines = p.groupBy("folder", "name").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "t"))).alias("l"))  # twenty
    return lines.select("folder", "name", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))


_H = lambda k: f"regexp_extract(t,'{D.HEADER}',{k})"
_OPENS = f"{_H(4)}<>'' AND {_H(5)}=''"
_HIT = lambda p: f"regexp_matches(t,'{_quoted(p)}')"
_FORM = lambda p, q: f"CASE WHEN {_HIT(D.ASSOCIATION)} THEN regexp_extract(t,'{D.ASSOCIATION}',{p}) ELSE regexp_extract(t,'{D.PAIR_FIRST}',{q}) END"
_END = lambda k: f"regexp_extract(t,'{_quoted(D.RELATION)}',{k})"
_TWO = "concat_ws('|', source_mult, target_mult, source_role, target_role)"
FOLDER_SQL = f"""WITH x0 AS (SELECT {WHERE[0]} folder, {WHERE[1]} AS name, p_partkey//20 doc, (row_number() OVER (PARTITION BY p_partkey//20 ORDER BY p_partkey)-1)*{len(TEXT)} base, [{','.join(TEXT)}] ts FROM part),
 x1 AS (SELECT doc, base+generate_subscripts(ts,1) i, trim(unnest(ts)) t FROM x0 WHERE folder NOT LIKE '\\_%' ESCAPE '\\' AND name LIKE '%.puml'), x2 AS (SELECT * FROM x1 WHERE t<>'' AND t NOT LIKE '@%'),
 x3 AS (SELECT *, last_value(CASE WHEN {_OPENS} THEN {_H(2)} WHEN t='}}' THEN '' END IGNORE NULLS) OVER w owner, last_value(CASE WHEN {_OPENS} THEN {_H(1)} WHEN t='}}' THEN '' END IGNORE NULLS) OVER w word, last_value(CASE WHEN {_OPENS} THEN i WHEN t='}}' THEN 0 END IGNORE NULLS) OVER w AS at_ FROM x2 WINDOW w AS (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 x AS (SELECT doc, i, t, coalesce(owner,'') AS owner, at_, CASE WHEN coalesce(owner,'')<>'' THEN CASE WHEN t='}}' THEN 'end' WHEN word='enum' THEN 'value' WHEN contains(t,'(') THEN 'method' ELSE 'attribute' END WHEN {_HIT(D.HEADER)} THEN 'header' WHEN {_HIT(D.DIAMOND)} THEN 'diamond' WHEN {_HIT(D.NOTE)} THEN 'note' WHEN {_HIT(D.ASSOCIATION)} OR {_HIT(D.PAIR_FIRST)} THEN 'association' WHEN {_HIT(D.RELATION)} THEN 'relation' ELSE 'unknown' END kind FROM x3),
 h AS (SELECT doc, i, {_H(2)} n, {_H(1)} word, {_H(3)} st, CASE WHEN {_H(3)}='interface' THEN 'interface' ELSE regexp_replace({_H(1)},'\\s+',' ','g') END kind FROM x WHERE kind='header'), dc AS (SELECT doc, n, max(i) i, max_by(kind,i) kind FROM h GROUP BY ALL),
 nt AS (SELECT doc, regexp_extract(t,'{_quoted(D.NOTE)}',1) note, min(i) above FROM x WHERE kind='note' GROUP BY ALL), pr AS (SELECT p.*, coalesce(above<i,false) noted FROM (SELECT doc, i, {_FORM(1, 3)} lab, {_FORM(2, 1)} a, {_FORM(3, 2)} b FROM x WHERE kind='association') p LEFT JOIN nt ON nt.doc=p.doc AND note=lab),
 bn AS (SELECT r.*, coalesce(u.above<r.i,false) ns, coalesce(v.above<r.i,false) nv FROM (SELECT doc, i, t, {_END(1)} l, {_END(5)} rr FROM x WHERE kind='relation') r LEFT JOIN nt u ON u.doc=r.doc AND u.note=l LEFT JOIN nt v ON v.doc=r.doc AND v.note=rr),
 rel AS (SELECT * FROM {relations_sql("(SELECT doc, i, t FROM bn WHERE NOT ns AND NOT nv)", 'doc, i')}), nm AS (SELECT DISTINCT doc, n FROM (SELECT doc, source n FROM rel UNION ALL SELECT doc, target FROM rel UNION ALL SELECT doc, unnest([lab,a,b]) FROM pr WHERE NOT noted)),
 im AS (SELECT doc, n FROM nm ANTI JOIN dc USING(doc,n) WHERE doc NOT IN (SELECT doc FROM x WHERE kind='diamond')),
 m0 AS (SELECT x.*, {PLAIN.replace('(s)', '(t)')} p FROM x JOIN dc ON dc.doc=x.doc AND dc.n=x.owner AND dc.i=x.at_ WHERE x.kind IN ('attribute','method','value')),
 m1 AS (SELECT *, trim(regexp_replace(regexp_replace(p,'\\{{[^}}]*\\}}',' ','g'),'\\s+',' ','g')) q FROM m0), m2 AS (SELECT *, trim(split_part(CASE WHEN starts_with(q,'const ') THEN trim(substr(q,7)) ELSE q END,'=',1)) s FROM m1),
 o AS (SELECT doc, 'class' what, i, kind a, n b, '' c, '' e FROM dc UNION ALL SELECT doc, 'class', NULL, 'implicit', n, '', '' FROM im
  UNION ALL SELECT doc, kind, i, owner, CASE WHEN kind<>'attribute' THEN t WHEN contains(s,':') THEN trim(split_part(s,':',1)) ELSE regexp_extract(s,'(\\S*)$',1) END, CASE WHEN kind<>'attribute' THEN '' WHEN contains(s,':') THEN trim(substr(s,strpos(s,':')+1)) ELSE trim(regexp_replace(s,'\\S*$','')) END, '' FROM m2
  UNION ALL SELECT doc, typ, i, source, target, label, {_TWO} FROM rel UNION ALL SELECT doc, 'association class', i, a, b, lab, '|||' FROM pr WHERE NOT noted
  UNION ALL SELECT doc, 'issue', i, 'stereotype', st, '', '' FROM h WHERE st NOT IN ('','interface') AND NOT (word='enum' AND st='enum') UNION ALL SELECT doc, 'issue', i, 'unsupported', regexp_extract(t,'{D.DIAMOND}',1), '', '' FROM x WHERE kind='diamond'
  UNION ALL SELECT doc, 'issue', i, 'note on pair', lab, '', '' FROM pr WHERE noted UNION ALL SELECT doc, 'issue', i, 'note on class', CASE WHEN ns THEN l ELSE rr END, '', '' FROM bn WHERE ns OR nv UNION ALL SELECT doc, 'issue', i, 'unknown line', t, '', '' FROM x WHERE kind='unknown'
  UNION ALL SELECT doc, 'issue', i, 'end constraint', unnest(regexp_extract_all({_END(2)},'{D.CONSTRAINT}') || regexp_extract_all({_END(4)},'{D.CONSTRAINT}')), '', '' FROM bn WHERE NOT ns AND NOT nv UNION ALL SELECT doc, 'issue', NULL, 'implicit class', n, '', '' FROM im)
 SELECT 'm'||((doc//10)%12) folder, 'd'||doc||'.puml' AS name, what, i::INTEGER i, a, b, c, e FROM o"""


@query("diagram_folder", FOLDER_SQL)
def diagram_folder(spark, d):
    """Folders of diagrams written and read back as a source: a row for each class, member, relation and issue of each diagram."""
    root = shared_folder(spark, "diagrams")
    diagrams.register(spark)
    diagram_texts(spark, d).write.format("diagrams").mode("append").save(root)
    lines = spark.read.format("diagrams").load(root)
    got = D.read(lines.select(F.struct("folder", "name").alias("doc"), "i", "t"))
    nothing = F.lit("")

    def row(df, what, a, b, c=nothing, e=nothing):
        return df.select("doc.folder", "doc.name", what.alias("what"), "i", F.col(a).alias("a"), F.col(b).alias("b"), c.alias("c"), e.alias("e"))

    two = F.concat_ws("|", "source_mult", "target_mult", "source_role", "target_role")
    out = row(got["classes"], F.lit("class"), "kind", "name").unionByName(row(got["members"], F.col("kind"), "owner", "name", F.col("typ")))
    return out.unionByName(row(got["relations"], F.col("typ"), "source", "target", F.col("label"), two)).unionByName(row(got["issues"], F.lit("issue"), "issue", "subject"))


#: Five parts make a diagram here, every second one with an end mark; each even part adds an edit to its script.
EDITED = [*TEXT[:4], LINE]
OPS = {
    "type": "CASE (p_partkey//2)%9 WHEN 0 THEN 'rename_token' WHEN 1 THEN 'remove_line' WHEN 2 THEN 'replace_line' WHEN 4 THEN 'remove_label' WHEN 5 THEN 'set_role' WHEN 6 THEN 'add_line' WHEN 7 THEN 'add_block' WHEN 8 THEN CASE WHEN p_size%9=0 THEN 'turn' ELSE 'change_edge_type' END ELSE 'change_edge_type' END",
    "from_": "'D'||(p_size%30)", "to_": "'Part'||p_size", "match": LINE, "replacement": "'X'||p_size||' -- Y'", "class_a": "'D'||(p_size%30)", "class_b": "'C'||(p_partkey%40)",
    "lab": "CASE p_size%5 WHEN 0 THEN '' WHEN 1 THEN 'has' WHEN 2 THEN 'owns' WHEN 3 THEN '{disjoint}' ELSE 'uses' END", "new_type": "CASE p_size%7 WHEN 0 THEN 'odd' WHEN 1 THEN 'association' WHEN 2 THEN 'aggregation' WHEN 3 THEN 'composition' WHEN 4 THEN 'unidirectional' ELSE 'dependency' END",
    "container": "CASE p_size%4 WHEN 0 THEN 'Z' WHEN 1 THEN 'C'||(p_partkey%40) ELSE 'D'||(p_size%30) END", "endpoint_mult": "CASE p_size%3 WHEN 0 THEN '*' ELSE '1..1' END", "role_": "'r'||p_size", "line_": "CASE WHEN p_size%10=0 THEN '}' ELSE 'A'||p_size||' -- B' END",
    "block_": "'enum E'||(p_size%50)||' {'||chr(10)||'ONE'||chr(10)||CASE WHEN p_size%11=0 THEN '' ELSE '}' END",
}
_NAMES = {"from_": "from", "to_": "to", "lab": "label", "role_": "role", "line_": "line", "block_": "block"}
_PART = lambda k, x: f"regexp_extract({x},'{_quoted(D.RELATION)}',{k})"
_SQUEEZED = lambda k, x: f"trim(regexp_replace(regexp_replace({_PART(k, x)},'\\{{[^}}]*\\}}',' ','g'),'\\s+',' ','g'))"
_MULT = lambda k, x: f"regexp_extract({_SQUEEZED(k, x)},'^(\\S*)',1)"
_ROLE = lambda k, x: f"regexp_extract({_SQUEEZED(k, x)},'^\\S+ (.*)$',1)"
_READ = lambda t: f"(CASE WHEN regexp_matches({t},' [<>]$') THEN rtrim(({t})[:-3]) WHEN regexp_matches({t},'^[<>] ') THEN ltrim(({t})[3:]) WHEN length({t})>1 AND regexp_matches({t},'[^<>-][<>]$') THEN rtrim(({t})[:-2]) WHEN length({t})>1 AND regexp_matches({t},'^[<>][^<>]') THEN ltrim(({t})[2:]) ELSE {t} END)"
_MADE = lambda arrow, label, left, right: f"""{_PART(1, 'hit')}||' "'||trim({_MULT(2, 'hit')}||' '||{left})||'" '||{arrow}||' "'||trim({_MULT(4, 'hit')}||' '||{right})||'" '||{_PART(5, 'hit')}||CASE WHEN {label}='' THEN '' ELSE ' : '||{label} END"""
_ARROW = "CASE " + " ".join(f"WHEN new_type='{n}' THEN '{a}'" for n, a in PLAIN_ARROWS.items()) + " " + " ".join(f"WHEN new_type='{n}' AND container={_PART(1, 'hit')} THEN '{a}' WHEN new_type='{n}' AND container={_PART(5, 'hit')} THEN '{b}'" for n, (a, b) in CONTAINERS.items()) + " END"
_PUT = lambda line: f"list_transform(ls, lambda x: CASE WHEN trim(x)=trim(hit) THEN {line} ELSE x END)"
_INSERT = lambda new: f"CASE WHEN list_contains(ls,'@enduml') THEN ls[:list_position(ls,'@enduml')-1]||{new}||ls[list_position(ls,'@enduml'):] ELSE ls||{new} END"
_ON = "CASE WHEN len(hits)<>1 THEN type||': '||class_a||' '||class_b||' found '||len(hits)||' times' "
EDIT_SQL = f"""WITH RECURSIVE dg AS (SELECT p_partkey//5 doc, flatten(list([{','.join(EDITED)}] ORDER BY p_partkey)) || CASE WHEN p_partkey//5%2=0 THEN ['@enduml'] ELSE []::VARCHAR[] END ls FROM part GROUP BY 1),
 op AS (SELECT p_partkey//5 doc, row_number() OVER (PARTITION BY p_partkey//5 ORDER BY p_partkey) pos, {', '.join(f'{x} AS {n}' for n, x in OPS.items())} FROM part WHERE p_partkey%2=0),
 st AS (SELECT doc, 0::BIGINT pos, ls, 0::BIGINT applied, '' err FROM dg UNION ALL SELECT doc, pos, CASE WHEN e='' THEN nl ELSE ls END, applied+CASE WHEN e='' THEN 1 ELSE 0 END, e FROM (SELECT *, CASE type
   WHEN 'rename_token' THEN list_transform(ls, lambda x: regexp_replace(x,'\\b'||from_||'\\b',to_,'g')) WHEN 'remove_line' THEN list_filter(ls, lambda x: trim(x)<>trim(match)) WHEN 'replace_line' THEN list_transform(ls, lambda x: CASE WHEN trim(x)=trim(match) THEN replacement ELSE x END)
   WHEN 'change_edge_type' THEN {_PUT(_MADE(_ARROW, 'lab', _ROLE(2, 'hit'), _ROLE(4, 'hit')))} WHEN 'remove_label' THEN {_PUT(_MADE(_PART(3, 'hit'), "''", _ROLE(2, 'hit'), _ROLE(4, 'hit')))}
   WHEN 'set_role' THEN {_PUT(_MADE(_PART(3, 'hit'), 'lab', f"CASE WHEN {_MULT(2, 'hit')}=endpoint_mult THEN role_ ELSE {_ROLE(2, 'hit')} END", f"CASE WHEN {_MULT(4, 'hit')}=endpoint_mult THEN role_ ELSE {_ROLE(4, 'hit')} END"))}
   WHEN 'add_line' THEN {_INSERT('[line_]')} WHEN 'add_block' THEN {_INSERT("(string_split(trim(block_,' '||chr(10)),chr(10))||[''])")} END nl,
  CASE type WHEN 'rename_token' THEN CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x,'\\b'||from_||'\\b')))>0 THEN '' ELSE type||': '||from_||' not found' END WHEN 'remove_line' THEN CASE WHEN th THEN '' ELSE type||': '||trim(match)||' not found' END WHEN 'replace_line' THEN CASE WHEN th THEN '' ELSE type||': '||trim(match)||' not found' END
   WHEN 'change_edge_type' THEN {_ON} WHEN ({_ARROW}) IS NULL THEN type||': no arrow for '||new_type ELSE '' END WHEN 'remove_label' THEN {_ON} ELSE '' END WHEN 'set_role' THEN {_ON} WHEN ({_MULT(2, 'hit')}=endpoint_mult)=({_MULT(4, 'hit')}=endpoint_mult) THEN type||': '||endpoint_mult||' isn''t at one end' ELSE '' END
   WHEN 'add_line' THEN CASE WHEN list_contains(list_transform(ls, lambda x: trim(x)), line_) THEN type||': '||line_||' is there already' ELSE '' END
   WHEN 'add_block' THEN CASE WHEN block_ NOT LIKE '%}}' THEN type||': not one declaration' WHEN list_contains(list_transform(ls, lambda x: regexp_extract(trim(x),'{D.HEADER}',2)), split_part(block_,' ',2)) THEN type||': '||split_part(block_,' ',2)||' is there already' ELSE '' END ELSE type||': unknown type' END e
  FROM (SELECT *, hits[1] hit, list_contains(list_transform(ls, lambda x: trim(x)), trim(match)) th FROM (SELECT s.doc, o.* EXCLUDE (doc), s.ls, s.applied, list_filter(s.ls, lambda x: regexp_matches(trim(x),'{_quoted(D.RELATION)}') AND (({_PART(1, 'trim(x)')}=class_a AND {_PART(5, 'trim(x)')}=class_b) OR ({_PART(1, 'trim(x)')}=class_b AND {_PART(5, 'trim(x)')}=class_a)) AND {_READ(f"trim({_PART(6, 'trim(x)')})")}=lab) hits
   FROM st s JOIN op o ON o.doc=s.doc AND o.pos=s.pos+1 WHERE s.err='')))
 ) SELECT doc, applied::INTEGER applied, err AS error, sha256(array_to_string(ls,chr(10))) digest FROM st WHERE true QUALIFY row_number() OVER (PARTITION BY doc ORDER BY pos DESC)=1"""


@query("edit_lines", EDIT_SQL)
def edit_lines(spark, d):
    """Each diagram after its own script of corrections: how many edits were made, what ended the script, and a digest of the lines."""
    of = lambda s: F.expr(s.replace("//5%2", " div 5 % 2").replace("//", " div "))
    p = table(spark, d, "part")
    lines = p.select(of("p_partkey//5").alias("doc"), "p_partkey", F.array(*[of(x) for x in EDITED]).alias("l")).groupBy("doc").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "l"))), lambda x: x["l"])).alias("l"))  # five
    lines = lines.select("doc", F.when(F.col("doc") % 2 == 0, F.array_append("l", "@enduml")).otherwise(F.col("l")).alias("l"))
    fields = F.create_map(*[x for n, e in OPS.items() for x in (F.lit(_NAMES.get(n, n)), of(e))])
    ops = p.where("p_partkey % 2 = 0").select(of("p_partkey//5").alias("doc"), F.struct("p_partkey", F.map_entries(fields).alias("op")).alias("o"))
    script = ops.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list("o")), lambda x: F.map_from_entries(x["op"])).alias("ops"))  # three at most
    x = lines.join(script, "doc", "left").select("doc", run_script(F.col("l"), F.col("ops")).alias("x"))
    return x.select("doc", "x.applied", "x.error", F.sha2(F.array_join("x.lines", "\n"), 256).alias("digest"))
