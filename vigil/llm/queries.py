"""Queries of this subpackage, by name."""

from __future__ import annotations

from vigil.llm import ann, maintext, media, packing, phrases, pieces, pii, quality, secrets, simhash, substrings, tokens, trie

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_quality": quality.op2_quality,
    "op3_media": media.op3_media,
    "op4_substrings": substrings.op4_substrings,
    "op5_simhash": simhash.op5_simhash,
    "op6_pii": pii.op6_pii,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_neighbours": ann.op8_neighbours,
    "op9_pack": packing.op9_pack,
    "op10_secrets": secrets.op10_secrets,
    "op11_main_text": maintext.op11_main_text,
    "op12_phrases": phrases.op12_phrases,
    "op13_trie": trie.op13_trie,
}

#: SQL for those that SQL can express on whole tables.
ORACLES: dict[str, str] = {
    "op4_substrings": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
 g AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER nxt AS g, count(*) OVER nxt AS c FROM t WINDOW nxt AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
 r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g WHERE c = 20),
 m AS (SELECT t.doc_id, t.i, t.word, max(CASE WHEN r.k > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND r.i = t.i),
 s AS (SELECT doc_id, count(*) FILTER (gone = 1) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)""",
    "op12_phrases": r"""WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
 p AS (SELECT doc, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS place FROM (SELECT doc, lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS ps FROM d)),
 t AS (SELECT doc, place, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc, place, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
 n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
 x AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM t WINDOW o AS (PARTITION BY doc, place ORDER BY i)),
 f AS (SELECT lang, [w1] AS ws, count(*) AS f FROM x GROUP BY lang, w1 HAVING count(*) >= 30 UNION ALL SELECT lang, [w1, w2], count(*) FROM x WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 30
   UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM x WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 30 UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM x WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 30),
 k AS (SELECT lang, ws, f AS a, unnest(range(1, len(ws))) AS k FROM f WHERE len(ws) > 1),
 s AS (SELECT k.*, l.f AS l, r.f AS r, (CAST(2000000 AS HUGEINT) * a) // (l.f + r.f) AS score FROM k JOIN f l ON l.lang = k.lang AND l.ws = k.ws[1:k.k] JOIN f r ON r.lang = k.lang AND r.ws = k.ws[k.k + 1:len(k.ws)]),
 b AS (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) AS o FROM s),
 h AS (SELECT lang, ws, max(f) AS f FROM (SELECT lang, f, unnest(CASE WHEN len(ws) = 3 THEN [ws[1:2], ws[2:3]] ELSE [ws[1:2], ws[2:3], ws[3:4], ws[1:3], ws[2:4]] END) AS ws FROM f WHERE len(ws) > 2) GROUP BY lang, ws),
 c AS (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN h ON h.lang = b.lang AND h.ws = b.ws WHERE o = 1 AND NOT 100 * coalesce(h.f, 0) >= 80 * a),
 z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT z.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000""",
    "op13_trie": r"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, max(i) AS own, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
   lambda x, y: list_reduce([xor(x, y), 1, 2, 3, 4, 5, 6, 7, 8], lambda v, b: xor(v >> 1, (v & 1) * 3988292384)))) % 9 AS h FROM t GROUP BY conv_id),
 m AS (SELECT c.*, least(h, coalesce(b.own, 0)) AS shared FROM c LEFT JOIN (SELECT conv_id AS base, own FROM c) b USING (base)),
 r AS (SELECT m.conv_id, t.i AS d, role, text FROM m JOIN t ON t.conv_id = m.base AND t.i <= m.shared UNION ALL SELECT m.conv_id, t.i - h + shared, role, text FROM m JOIN t ON t.conv_id = m.conv_id AND t.i > m.h),
 k AS (SELECT conv_id, d, octet_length(encode(text)) AS bytes, string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d) AS key FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM m),
 l AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM k),
 g AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM l GROUP BY d, key),
 u AS (SELECT g.*, p.d AS top_d, p.key AS top_key FROM g JOIN k p ON p.conv_id = g.conv_id AND p.d <= g.d),
 e AS (SELECT top_d + 1 AS d, conv_id AS parent, key, top_key FROM u WHERE top_d = d - 1),
 n AS (SELECT top_key AS key, count(*) AS n_children FROM e GROUP BY top_key),
 s AS (SELECT top_d AS d, top_key AS key, count(*) FILTER (n.key IS NULL) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM u LEFT JOIN n ON n.key = u.key GROUP BY top_d, top_key)
SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, g.n_convs, coalesce(n.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(g.ids) AS ends_sha256
 FROM g JOIN s USING (key) LEFT JOIN n USING (key) LEFT JOIN e USING (key) LEFT JOIN g p ON p.key = e.top_key""",
}
