"""Oracle SQL of the operators that SQL can express. BPE ids, token files and the language classifier have none."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(nodes: str, links: str) -> str:
    """``comp(id, component)``: the smallest id reachable over ``links(a, b)`` (both directions)."""
    return f"""reach(id, root) AS (SELECT a, b FROM {links} UNION SELECT r.id, l.b FROM reach r JOIN {links} l ON r.root = l.a),
comp AS (SELECT n.id, least(n.id, coalesce(min(root), n.id)) AS component FROM {nodes} n LEFT JOIN reach ON n.id = reach.id GROUP BY n.id)"""


_VECTORS = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
good AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0)"""

_OP1 = f"""WITH RECURSIVE {_VECTORS},
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.e, q.e) >= 0.9),
nodes AS (SELECT DISTINCT vec_id AS id FROM embeddings), {_components('nodes', 'links')}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component AS component_id, id = component AS kept FROM comp"""

_OP3 = rf"""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM s),
k AS (SELECT doc_id, i, line, {_LOWER.format(x=r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM l),
common AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM k LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY 1"""

_OP4 = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '{_WORD}') AS ws FROM documents),
sh AS (SELECT id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS s FROM w),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT p.id AS a, q.id AS b, count(*) AS shared FROM sh p JOIN sh q ON p.s = q.s AND p.id < q.id GROUP BY 1, 2),
l0 AS (SELECT a, b FROM pairs JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
links AS (SELECT a, b FROM l0 UNION ALL SELECT b, a FROM l0), {_components('w', 'links')}
SELECT comp.id AS doc_id, coalesce(n, 0) AS n_shingles, component AS component_id, comp.id = component AS kept FROM comp LEFT JOIN n ON comp.id = n.id"""

_OP5 = f"""WITH {_VECTORS},
d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10"""

_OP8 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, unnest(list_transform(range(1, len(ws) - 33), lambda i: array_to_string(ws[i:i + 34], ' '))) AS t FROM w WHERE len(ws) >= 35),
rep AS (SELECT t FROM win GROUP BY 1 HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win WHERE t IN (SELECT t FROM rep)),
ps AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
k AS (SELECT ps.doc_id, count(cov.p) AS removed, string_agg(word, ' ' ORDER BY ps.p) FILTER (cov.p IS NULL) AS kept
  FROM ps LEFT JOIN cov ON cov.doc_id = ps.doc_id AND cov.p = ps.p GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

_OP9 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM h GROUP BY 1)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM h JOIN f USING (h)"""

_OP10 = f"""WITH RECURSIVE z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n,
  [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM z GROUP BY 1),
t AS (SELECT *, 3 * source_size AS cap, sum(w) OVER () AS ws, sum(source_size) OVER () AS total,
  coalesce(sum(w) OVER o, 0) AS w0, coalesce(sum(3 * source_size) OVER o, 0) AS c0 FROM s
  WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * (ws - w0) < w * (total - c0) AS clamped FROM t),
g AS (SELECT source, source_size, n, CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE CAST(w * (total - (SELECT coalesce(sum(cap), 0) FROM c WHERE clamped)) AS DOUBLE)
  / CAST((SELECT sum(w) FROM c WHERE NOT clamped) AS DOUBLE) END AS target FROM c),
r AS (SELECT source, source_size, target, n, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM g),
d AS (SELECT z.doc_id, z.size, r.source, r.source_size, r.target, floor(ratio) AS whole, ratio - floor(ratio) AS f, md5('17:' || CAST(z.doc_id AS VARCHAR)) AS key, n
  FROM z JOIN r ON z.source IS NOT DISTINCT FROM r.source),
e AS (SELECT *, CAST('0x' || substr(key, 1, 8) AS BIGINT) % CAST(ceil(n / 256.0) AS BIGINT) AS b, CAST(CAST('0x' || substr(key, 9, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u FROM d),
q AS (SELECT *, row_number() OVER (PARTITION BY source, b ORDER BY size DESC, key, doc_id) AS k FROM e),
fold(source, b, k, doc_id, size, source_size, target, whole, extra, owed) AS (
  SELECT source, b, k, doc_id, size, source_size, target, whole, CASE WHEN f * size > u * size THEN 1 ELSE 0 END,
    f * size - CASE WHEN f * size > u * size THEN 1 ELSE 0 END * size FROM q WHERE k = 1
  UNION ALL SELECT q.source, q.b, q.k, q.doc_id, q.size, q.source_size, q.target, q.whole, CASE WHEN owed + f * q.size > u * q.size THEN 1 ELSE 0 END,
    owed + f * q.size - CASE WHEN owed + f * q.size > u * q.size THEN 1 ELSE 0 END * q.size
  FROM fold JOIN q ON q.source IS NOT DISTINCT FROM fold.source AND q.b = fold.b AND q.k = fold.k + 1)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST((whole + extra) * size AS BIGINT) AS taken FROM fold"""

_OP11 = rf"""WITH b AS (SELECT item_id, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '{_PLAIN}') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 10 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 8), lambda i: array_to_string(ws[i:i + 9], ' ')) END) AS w FROM b),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '{_PLAIN}') AS ws FROM documents),
pos AS (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM iw)),
hit AS (SELECT r, i, k, w FROM (SELECT r, i, k, array_to_string(ws[i:i + k - 1], ' ') AS w FROM pos) WHERE w IN (SELECT w FROM iw)),
n AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
h AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM (SELECT DISTINCT r, w FROM hit) JOIN iw USING (w) WHERE item_id IS NOT NULL GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n IS NOT NULL AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN h USING (r)"""

_OP12 = rf"""WITH RECURSIVE t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c FROM t),
bits AS (SELECT c, 0 AS i, 4294967295::BIGINT AS x FROM ids UNION ALL
  SELECT c, i + 1, CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END FROM (SELECT c, i,
    CASE WHEN i % 8 = 0 THEN xor(x, ascii(substr(CAST(c AS VARCHAR), i // 8 + 1, 1))::BIGINT) ELSE x END AS y FROM bits WHERE i < 8 * len(CAST(c AS VARCHAR)))),
hd AS (SELECT c, xor(arg_max(x, i), 4294967295) % 4 AS h FROM bits GROUP BY 1),
r AS (SELECT hd.c, 0 AS own, t.i, role, text FROM hd JOIN t ON t.c = hd.c - hd.c % 20 AND t.i <= h UNION ALL
  SELECT c, 1, i, role, text FROM hd JOIN t USING (c) WHERE i > h),
q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d, role, text FROM r),
p AS (SELECT c, d, text, list(sha256(len(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY d) AS k FROM q
  UNION ALL SELECT c, 0, '', CAST([] AS VARCHAR[]) FROM ids),
m AS (SELECT c, max(d) AS n FROM p GROUP BY 1),
v AS (SELECT d, k, min(p.c) AS id, count(*) AS n, any_value(len(regexp_extract_all(text, '{_WORD}'))) AS words,
  sha256(coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (m.n = d), '')) AS ends FROM p JOIN m ON m.c = p.c GROUP BY 1, 2),
e AS (SELECT v.*, (SELECT count(*) FROM v x WHERE x.d = v.d + 1 AND x.k[1:x.d - 1] = v.k) AS kids FROM v),
u AS (SELECT d, k[1:j] AS k, j, n, words, kids FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM e)),
s AS (SELECT k, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * words) AS saved FROM u GROUP BY 1)
SELECT e.id AS conv_id, e.d AS depth, up.id AS parent_conv_id, e.n AS n_convs, e.kids AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, e.ends AS ends_sha256 FROM e JOIN s ON s.k = e.k LEFT JOIN v up ON up.d = e.d - 1 AND up.k = e.k[1:e.d - 1]"""

_OP13 = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS g FROM documents),
u AS (SELECT *, list_filter(regexp_extract_all(text, '[^
]*
|[^
]+'), lambda x: x <> '') AS us,
  list_transform(range(0, 4), lambda i: CAST('0x' || substr(g, CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT)) AS h FROM t),
c AS (SELECT *, len(us) AS n, least(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS lo, greatest(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS hi,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT *, array_to_string(us[1:lo], '') AS p, array_to_string(us[lo + 1:hi], '') AS m, array_to_string(us[hi + 1:n], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM x"""

SQL = {
    "op1_subspace_join": _OP1,
    "op3_line_dedup": _OP3,
    "op4_minhash": _OP4,
    "op5_vp_tree": _OP5,
    "op8_phrase_automata": _OP8,
    "op9_warc": _OP9,
    "op10_mixing": _OP10,
    "op11_decontamination": _OP11,
    "op12_prefix_trie": _OP12,
    "op13_fill_in_middle": _OP13,
}
