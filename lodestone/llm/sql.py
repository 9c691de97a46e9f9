"""DuckDB SQL of the queries that SQL can express on whole tables."""

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = "||".join(f"substr('{_ALPHABET}', 1+((('0x'||substr(h,{10 * (k // 8) + 1},10))::BIGINT>>{35 - 5 * (k % 8)})&31)::INTEGER, 1)" for k in range(32))

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
_CRC32 = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR,''), lambda ch: ascii(ch)::BIGINT)), lambda s, ch: list_reduce(list_prepend(xor(s,ch), [0::BIGINT,0,0,0,0,0,0,0]), lambda u, k: CASE WHEN u&1=1 THEN xor(u>>1,3988292384::BIGINT) ELSE u>>1 END))"


def _assign(n: int, book: str) -> str:
    return f"""a{n} AS MATERIALIZED (SELECT vec_id, label, p, x, (m%64)::INTEGER j, (m//64)::BIGINT d FROM (SELECT p.vec_id, any_value(label) label, p.p, any_value(p.x) x, min((list_sum(list_transform(list_zip(p.x,c.x), lambda z: (z[1]-z[2])*(z[1]-z[2])))*64+c.j)::BIGINT) m FROM p JOIN {book} c ON p.p=c.p GROUP BY p.vec_id, p.p))"""


def _update(n: int, book: str) -> str:
    return f"""c{n} AS MATERIALIZED (SELECT c.p, c.j, coalesce(u.x, c.x) x FROM {book} c LEFT JOIN (SELECT p, j, list(f ORDER BY i) x FROM (SELECT p, j, i, floor(sum(v)::DOUBLE/count(*))::BIGINT f FROM (SELECT p, j, unnest(x) v, generate_subscripts(x,1) i FROM a{n}) GROUP BY ALL) GROUP BY ALL) u USING(p,j))"""


SQL: dict[str, str] = {
    "op6_warc": f"""WITH p AS (SELECT page_id, coalesce(html,'') html, sha1(coalesce(html,'')) h FROM pages), t AS (SELECT h, max(page_id) top FROM p GROUP BY 1)
 SELECT page_id, strlen(html)::BIGINT payload_bytes, {_BASE32} payload_digest, CASE WHEN page_id<top THEN 'revisit' ELSE 'response' END record_type, CASE WHEN page_id<top THEN top END refers_to FROM p JOIN t USING(h)""",
    "op7_backoff": f"""WITH w AS (SELECT doc_id, i, w FROM (SELECT doc_id, unnest(a) w, generate_subscripts(a,1) i FROM (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') a FROM documents))),
 b AS (SELECT doc_id, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY i),'<s>') u, w FROM w), n AS (SELECT count(*) n FROM w),
 c2 AS (SELECT u, w, count(*) c FROM b GROUP BY ALL), cu AS (SELECT u, count(*) c FROM b GROUP BY 1), cw AS (SELECT w, count(*) c FROM b GROUP BY 1),
 o2 AS (SELECT doc_id, u, w, count(*) c FROM b GROUP BY ALL), ou AS (SELECT doc_id, u, count(*) c FROM b GROUP BY ALL), ow AS (SELECT doc_id, w, count(*) c FROM b GROUP BY ALL), od AS (SELECT doc_id, count(*) c FROM b GROUP BY 1),
 s AS (SELECT doc_id, o2.c k, CASE WHEN c2.c>o2.c THEN ln((c2.c-o2.c)/(cu.c-ou.c)) ELSE ln(0.4::DOUBLE*greatest(cw.c-ow.c,1)/greatest(n-od.c,1)) END v
  FROM o2 JOIN c2 USING(u,w) JOIN cu USING(u) JOIN cw USING(w) JOIN ou USING(doc_id,u) JOIN ow USING(doc_id,w) JOIN od USING(doc_id), n),
 d AS (SELECT doc_id, sum(k)::BIGINT n_words, sum(k*v) x FROM s GROUP BY 1)
 SELECT doc_id, coalesce(n_words,0)::BIGINT n_words, coalesce(round(x,4),0.0) log_score, round(x/n_words,6) log_score_per_word FROM documents LEFT JOIN d USING(doc_id)""",
    "op8_embeddings": """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) e FROM embeddings),
 u AS (SELECT vec_id, label, list_transform(e, lambda x: x/sqrt(list_sum(list_transform(e, lambda y: y*y)))) e FROM v WHERE label IS NOT NULL AND list_sum(list_transform(e, lambda y: y*y))>0),
 l AS (SELECT a.vec_id a, b.vec_id b FROM u a JOIN u b ON a.label=b.label AND a.vec_id<>b.vec_id AND list_dot_product(a.e,b.e)>=0.93),
 r AS (SELECT vec_id a, vec_id b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a=r.b), c AS (SELECT a vec_id, min(b) component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) n FROM l GROUP BY 1)
 SELECT c.vec_id, coalesce(n,0)::BIGINT n_links, component_id, c.vec_id=component_id kept FROM c LEFT JOIN n ON n.a=c.vec_id""",
    "op5_jaccard": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') a FROM documents),
 g AS (SELECT DISTINCT doc_id, array_to_string(a[i:i+least(3,len(a))-1],chr(1)) s FROM (SELECT doc_id, a, unnest(range(1, 2+len(a)-least(3,len(a)))) i FROM d WHERE len(a)>0)), n AS (SELECT doc_id, count(*) n FROM g GROUP BY 1),
 p AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM g x JOIN g y ON x.s=y.s AND x.doc_id<>y.doc_id GROUP BY ALL), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id=a JOIN n y ON y.doc_id=b WHERE 100*c>=90*(x.n+y.n-c)),
 r AS (SELECT doc_id a, doc_id b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a=r.b)
 SELECT d.doc_id, coalesce(n.n,0)::BIGINT n_shingles, m.component_id FROM d LEFT JOIN n ON n.doc_id=d.doc_id JOIN (SELECT a, min(b) component_id FROM r GROUP BY 1) m ON m.a=d.doc_id""",
    "op3_decontaminate": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') a FROM documents), b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') a FROM benchmark),
 bw AS (SELECT DISTINCT item_id, least(10,len(a)) k, array_to_string(a[i:i+least(10,len(a))-1],' ') s FROM (SELECT item_id, a, unnest(range(1, 2+len(a)-least(10,len(a)))) i FROM b WHERE len(a)>0)), ks AS (SELECT DISTINCT k FROM bw),
 dw AS (SELECT doc_id, i, k, array_to_string(a[i:i+k-1],' ') s FROM (SELECT doc_id, a, k, unnest(range(1, 2+len(a)-k)) i FROM d, ks WHERE len(a)>=k)), h AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING(k,s)),
 w AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest(range(i,i+k)) p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY 1), it AS (SELECT doc_id, count(*) n, string_agg(x, ',' ORDER BY x) l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR x FROM h) GROUP BY 1)
 SELECT d.doc_id, len(a)::BIGINT n_words, coalesce(w.n,0)::BIGINT n_hit, coalesce(it.n,0)::BIGINT n_items, sha256(coalesce(l,'')) items_sha256, coalesce(w.n,0)>0 contaminated FROM d LEFT JOIN w ON w.doc_id=d.doc_id LEFT JOIN it ON it.doc_id=d.doc_id""",
    "op12_tree": f"""WITH o AS (SELECT conv_id, list({{'r':coalesce(role,''),'t':coalesce(text,'')}} ORDER BY turn NULLS FIRST, coalesce(role,''), coalesce(text,'')) a FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
 h AS (SELECT conv_id, a, (xor({_CRC32},4294967295)%4)::BIGINT h FROM o), b AS (SELECT h.conv_id, coalesce(o.a[1:h.h],[]) || h.a[h.h+1:] a FROM h LEFT JOIN o ON o.conv_id=h.conv_id-h.conv_id%20),
 p AS (SELECT conv_id, d, sha256(to_json(a[1:d])::VARCHAR) k, CASE WHEN d>0 THEN sha256(to_json(a[1:d-1])::VARCHAR) END u, d=len(a) fin, CASE WHEN d>0 THEN len(regexp_extract_all(a[d].t,'[^\\x20\\x09-\\x0D]+')) ELSE 0 END w FROM (SELECT conv_id, a, unnest(range(0,len(a)+1)) d FROM b)),
 n AS (SELECT d, k, any_value(u) u, min(conv_id) conv_id, count(*) c, any_value(w) w, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (fin),'')) sha FROM p GROUP BY ALL),
 ch AS (SELECT d-1 d, u k, count(*) c FROM n WHERE d>0 GROUP BY ALL), m AS (SELECT n.*, coalesce(ch.c,0) nc FROM n LEFT JOIN ch USING(d,k)),
 an AS (SELECT DISTINCT x.d, x.k, y.d yd, y.k yk FROM p x JOIN p y ON x.conv_id=y.conv_id AND y.d>=x.d), t AS (SELECT an.d, an.k, count(*) FILTER (m.nc=0) nl, sum((m.c-1)*m.w)::BIGINT saved FROM an JOIN m ON m.d=an.yd AND m.k=an.yk GROUP BY ALL)
 SELECT m.conv_id, m.d depth, q.conv_id parent_conv_id, m.c n_convs, m.nc n_children, t.nl n_leaves, t.saved saved_tokens, m.sha ends_sha256 FROM m JOIN t USING(d,k) LEFT JOIN m q ON q.d=m.d-1 AND q.k=m.u""",
    "op13_codes": f"""WITH r AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256*x::DOUBLE)::BIGINT) v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))=0),
 p AS MATERIALIZED (SELECT vec_id, label, p, v[p*(len(v)//16)+1:(p+1)*(len(v)//16)] x FROM r, range(16) t(p)), c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id)-1 j, x FROM p QUALIFY j<64),
 {_assign(1, "c0")}, {_update(1, "c0")}, {_assign(2, "c1")}, {_update(2, "c1")}, {_assign(3, "c2")},
 e AS (SELECT vec_id, any_value(label) label, string_agg(printf('%02x', j), '' ORDER BY p) code, sum(d)::BIGINT error FROM a3 GROUP BY 1), h AS (SELECT sha256(string_agg(v, ',' ORDER BY p, j, i)) codebooks_sha256 FROM (SELECT p, j, unnest(x)::VARCHAR v, generate_subscripts(x,1) i FROM c2))
 SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT label_error, codebooks_sha256 FROM e, h""",
}
