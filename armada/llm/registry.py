"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from armada.llm.fingerprint import op6_fingerprint
from armada.llm.infill import op11_infill
from armada.llm.jaccard import op4_jaccard_join
from armada.llm.langid import op10_language
from armada.llm.mixing import op3_mix_sources
from armada.llm.neighbours import op8_neighbours
from armada.llm.packing import op9_packing, pack_conversations
from armada.llm.pii import op1_pii
from armada.llm.quality import op12_quality
from armada.llm.substrings import op7_substrings
from armada.llm.tokens import op2_token_file
from armada.llm.toxicity import op5_toxicity
from armada.llm.variants import op13_spelling

QUERIES = {f.__name__: f for f in (op1_pii, op2_token_file, op3_mix_sources, op4_jaccard_join, op5_toxicity, op6_fingerprint, op7_substrings, op8_neighbours, op9_packing, op10_language, op11_infill, op12_quality, op13_spelling, pack_conversations)}

ORACLES = {
    # every pair of different texts that shares a five-word shingle is compared; classes are what links and copies reach
    "op4_jaccard_join": r"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
keyed AS (SELECT doc_id, array_to_string(w, ' ') AS key, w FROM words),
texts AS (SELECT key, any_value(w) AS w, min(doc_id) AS doc, CAST(count(*) AS BIGINT) AS n_copies, row_number() OVER (ORDER BY key) AS node FROM keyed GROUP BY key),
spots AS (SELECT node, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0),
shingles AS (SELECT DISTINCT node, array_to_string(w[i:i + 4], ' ') AS s FROM spots),
sizes AS (SELECT node, count(*) AS n FROM shingles GROUP BY node),
shared AS (SELECT a.node AS a, b.node AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.node < b.node GROUP BY 1, 2),
pairs AS (SELECT a, b FROM shared JOIN sizes x ON x.node = a JOIN sizes y ON y.node = b WHERE shared.n * 18000 >= 8000 * (x.n + y.n)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT node, node AS other FROM texts UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
classes AS (SELECT r.node, min(t.doc) AS class_id FROM reach r JOIN texts t ON t.node = r.other GROUP BY r.node),
counted AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)
SELECT k.doc_id, c.class_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links, t.n_copies
FROM keyed k JOIN texts t ON t.key = k.key JOIN classes c ON c.node = t.node LEFT JOIN counted l ON l.node = t.node""",
    "op7_substrings": r"""
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 12, 0) + 1)) AS i FROM words),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM spots),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hits),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS s, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    # the cuts are made of the list of lines
    "op11_infill": r"""
WITH lines AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), []) AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y, text = '' OR regexp_matches(text, '<[PSM]>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 AS plain, CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 AS spm FROM lines),
cut AS (SELECT doc_id, text, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(text) AS restored_sha256 FROM cut""",
    # pairs are joined over words with one place open and over deletions; the checksum is computed byte by byte
    "op13_spelling": r"""
WITH RECURSIVE bits AS (SELECT range AS i, range AS v, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
each AS (SELECT doc_id, w, CAST(count(*) AS BIGINT) AS n FROM runs WHERE length(w) > 5 GROUP BY 1, 2),
octets AS (SELECT *, hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', w))) AS x FROM each),
checked AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda j: CAST('0x' || x[2 * j + 1:2 * j + 2] AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS h FROM octets, crc),
damaged AS (SELECT CASE WHEN h % 199 = 0 THEN concat(w[1:h % length(w)], w[h % length(w) + 2:]) ELSE w END AS w, n FROM checked),
v AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(w) > 5 GROUP BY 1 HAVING sum(n) >= 5),
spots AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v),
holes AS (SELECT w, n, i, w[1:i - 1] AS a, w[i + 1:] AS b FROM spots),
gaps AS (SELECT DISTINCT w, n, concat(a, b) AS d FROM holes),
pairs AS (SELECT x.w, y.w AS o, y.n FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.w <> y.w UNION ALL SELECT g.w, v.w, v.n FROM gaps g JOIN v ON g.d = v.w UNION ALL SELECT v.w, g.w, g.n FROM gaps g JOIN v ON g.d = v.w),
best AS (SELECT w, CAST(count(*) AS BIGINT) AS n_near, min((-n, hex(encode(o)), o)) AS b FROM pairs GROUP BY 1),
forms AS (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 5 * v.n THEN b[3] END AS form, CASE WHEN -b[1] >= 5 * v.n THEN CAST(-b[1] AS BIGINT) END AS form_n FROM v LEFT JOIN best ON v.w = best.w),
chain AS (SELECT w, w AS r FROM forms UNION ALL SELECT c.w, f.form FROM chain c JOIN forms f ON c.r = f.w WHERE f.form IS NOT NULL),
ends AS (SELECT c.w, c.r FROM chain c JOIN forms f ON f.w = c.r WHERE f.form IS NULL)
SELECT f.w AS word, f.form, e.r AS root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.w = f.w""",
}
