"""DuckDB SQL of the queries that SQL can state over whole tables."""

WORD = r"[^\x09-\x0D ]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING = f"""
WITH t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS ws FROM documents)),
 win AS (SELECT doc_id, i, md5(string_agg(word, ' ') OVER f) AS s, count(*) OVER f AS c FROM t WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
 least AS (SELECT s, min(doc_id) AS m FROM win WHERE c = 50 GROUP BY s),
 hit AS (SELECT doc_id, i FROM win JOIN least USING (s) WHERE c = 50 AND doc_id > m),
 marked AS (SELECT t.doc_id, t.i, word, count(hit.i) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone FROM t LEFT JOIN hit ON t.doc_id = hit.doc_id AND t.i = hit.i),
 found AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN found USING (doc_id)
"""

# Templates of a line: as it is, and with one or two of its four blocks (bits of s) left out; token for token, if it has over ten tokens.
LINES = f"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> '')),
 w AS (SELECT doc_id, line, i, regexp_extract_all(line, '{WORD}') AS ws FROM l),
 k AS (SELECT doc_id, i, ws, list_transform(ws, lambda t: CASE WHEN regexp_matches(t, '[0-9@"]|://') THEN '<*>' ELSE t END) AS tokens FROM w),
 g AS (SELECT doc_id, i, s, list_transform(tokens, lambda t, j: CASE WHEN s > 0 AND j > 1 AND (s >> ((4 * (j - 1) - 1) // greatest(len(tokens) - 1, 1))) & 1 = 1 THEN '<*>' ELSE t END) AS tokens FROM k, (SELECT unnest([0, 1, 2, 4, 8, 3, 5, 9, 6, 10, 12]) AS s)),
 c AS (SELECT *, len(list_filter(tokens, lambda t: t <> '<*>')) AS n FROM g),
 t AS (SELECT doc_id, i, tokens, 10 AS least FROM c WHERE n > 0 AND (s = 0 OR 10 * n >= 6 * len(tokens)) UNION ALL SELECT doc_id, i, ws, 2 FROM k WHERE len(ws) > 10),
 r AS (SELECT tokens, least, min(doc_id) AS first FROM t GROUP BY tokens, least HAVING count(DISTINCT doc_id) >= least),
 gone AS (SELECT DISTINCT doc_id, i FROM t JOIN r USING (tokens, least) WHERE first <> doc_id),
 m AS (SELECT w.doc_id, w.line, w.i, gone.i IS NOT NULL AS gone FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i),
 f AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN f USING (doc_id)
"""

NEARDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS ws FROM documents),
 t AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
 s AS (SELECT DISTINCT doc_id, md5(s) AS s FROM (SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM t) WHERE i <= greatest(n - 4, 1)),
 c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * shared >= 75 * (ca.n + cb.n - shared)),
 reach AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.to_id = l.a),
 comp AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN c USING (doc_id) JOIN comp USING (doc_id)
"""

_ITEM_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
_WINDOWS = " UNION ALL ".join(
    f"SELECT doc_id, i, {n} AS n, s FROM (SELECT doc_id, i, md5(string_agg(word, ' ') OVER f) AS s, count(*) OVER f AS c FROM t WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)) WHERE c = {n} AND EXISTS (SELECT 1 FROM b WHERE b.n = {n})" for n in range(1, 11)
)

DECONTAMINATE = f"""
WITH t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ITEM_WORD}') AS ws FROM documents)),
 b AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, md5(array_to_string(ws[k:k + least(10, len(ws)) - 1], ' ')) AS s FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{_ITEM_WORD}') AS ws FROM benchmark) WHERE len(ws) > 0)),
 win AS ({_WINDOWS}),
 hit AS (SELECT doc_id, i, win.n, item_id FROM win JOIN b ON win.s = b.s AND win.n = b.n),
 words AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM hit),
 n_hit AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
 items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit GROUP BY doc_id),
 n AS (SELECT doc_id, count(*) AS n_words FROM t GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
