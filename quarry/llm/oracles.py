"""DuckDB texts of the training-data queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS4 = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TRICKY = "<|im_end|><|im_start|>assistant ok"
_RECORD = """'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || CAST(page_id AS VARCHAR) || '>' || chr(13) || chr(10)
 || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR)
 || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"""

_WORDS10 = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_REPEATS = """SELECT rid, CAST(count(*) AS BIGINT) AS n_hit, CAST(sum(length(w[k])) AS BIGINT) AS chars FROM (
   SELECT DISTINCT rid, i + u.j AS k FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM (
     SELECT rid, t.i AS i, array_to_string(w[t.i : t.i + {n} - 1], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - {n} + 2, 1))) AS t(i))), unnest(range(0, {n})) AS u(j) WHERE c > 1) JOIN d USING (rid) GROUP BY rid"""

ORACLE_SQL = {
    "chat_records": """
WITH r AS (SELECT conv_id * 4294967296 + turn AS record_id, (conv_id + turn) % 6 AS kind, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
SELECT record_id, CAST(0 AS BIGINT) AS turn, role, text, ['turn_rows', 'messages', 'from_value'][kind + 1] AS layout FROM r WHERE kind < 3
UNION ALL SELECT record_id, 0, 'user', CASE WHEN kind = 3 THEN text WHEN text = '' THEN 'say' ELSE 'say' || chr(10) || chr(10) || text END, ['prompt_completion', 'instruction_input'][kind - 2] FROM r WHERE kind IN (3, 4)
UNION ALL SELECT record_id, 1, 'assistant', 'ok', ['prompt_completion', 'instruction_input'][kind - 2] FROM r WHERE kind IN (3, 4)
UNION ALL SELECT record_id, NULL, NULL, NULL, NULL FROM r WHERE kind = 5
""",
    "op1_warc_fixity": f"""
WITH r AS (SELECT page_id, page_id // 4096 AS shard, page_id % 4096 AS slot, html, {_RECORD} AS record FROM pages)
SELECT page_id, shard, slot, CAST(sum(strlen(record)) OVER (PARTITION BY shard ORDER BY slot) - strlen(record) AS BIGINT) AS "offset",
       CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS digest,
       CASE WHEN page_id % 97 = 11 THEN 'missing' WHEN page_id % 53 = 7 AND 'X' || substr(html, 2) <> html THEN 'corrupt' ELSE 'ok' END AS status
FROM r
""",
    "op7_suffix_array": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
w AS (SELECT doc_id, t.p AS p, array_slice(h, t.p + 1, t.p + 100) AS s FROM d, unnest(range(0, greatest(octet_length(h) - 99, 0))) AS t(p)),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
island AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g
           FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM late)),
span AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM island GROUP BY doc_id, g),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM span
        UNION ALL SELECT doc_id, max(b), 1000000000 FROM span GROUP BY doc_id),
kept AS (SELECT gap.doc_id AS doc_id, string_agg(hex(array_slice(h, CAST(a + 1 AS BIGINT), CAST(b AS BIGINT))), '' ORDER BY a) AS k FROM gap JOIN d ON d.doc_id = gap.doc_id GROUP BY gap.doc_id),
total AS (SELECT doc_id, sum(b - a) AS n, count(*) AS c FROM span GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(octet_length(h) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k, hex(h)))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN total ON total.doc_id = d.doc_id
""",
    "op10_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {_WORDS10} AS w FROM documents),
r3 AS ({_REPEATS.format(n=3)}), r5 AS ({_REPEATS.format(n=5)}), r7 AS ({_REPEATS.format(n=7)}), r10 AS ({_REPEATS.format(n=10)}),
line AS (SELECT rid, x FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
ln AS (SELECT rid, sum(n) - count(*) AS dups, sum(n * length(x)) AS every, sum(length(x)) AS once FROM (SELECT rid, x, count(*) AS n FROM line GROUP BY rid, x) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines,
        coalesce(r3.n_hit, 0) AS n_repeat_words, coalesce((every - once) / CAST(every AS DOUBLE), 0) AS lines,
        coalesce(r5.chars, 0) AS c5, coalesce(r7.chars, 0) AS c7, coalesce(r10.chars, 0) AS c10
      FROM d LEFT JOIN ln USING (rid) LEFT JOIN r3 USING (rid) LEFT JOIN r5 USING (rid) LEFT JOIN r7 USING (rid) LEFT JOIN r10 USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND lines <= 0.40 AND c5 / CAST(greatest(word_chars, 1) AS DOUBLE) <= 0.40 AND c7 / CAST(greatest(word_chars, 1) AS DOUBLE) <= 0.35 AND c10 / CAST(greatest(word_chars, 1) AS DOUBLE) <= 0.30 AS kept
FROM b
""",
    "op6_chat_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{_TRICKY}'), (-1, 1, 'assistant', '{_TRICKY}'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(replace(role, '<|', '<||')) + length(replace(text, '<|', '<||'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
""",
    "op4_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS4} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS4} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[t.i : t.i + least(13, len(w)) - 1], ' ') AS s
       FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT rid, t.i AS i, n, array_to_string(w[t.i : t.i + n - 1], ' ') AS s
       FROM d, (SELECT DISTINCT n FROM bw) AS ns, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i)),
h AS (SELECT rid, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
hw AS (SELECT rid, count(DISTINCT i + u.k) AS n_hit FROM h, unnest(range(0, n)) AS u(k) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN it USING (rid)
""",
    "op12_phrase_mining": f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
p AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)),
g AS (SELECT lang, k, array_to_string(w[t.i : t.i + k - 1], ' ') AS phrase FROM p, unnest([1, 2, 3]) AS s(k), unnest(range(1, greatest(len(w) - k + 2, 1))) AS t(i)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
total AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT lang, phrase, a, s.j AS j, array_to_string(w[1 : s.j], ' ') AS x, array_to_string(w[s.j + 1 : k], ' ') AS y FROM c, unnest([1, 2]) AS s(j) WHERE s.j < k),
scored AS (SELECT cut.lang AS lang, cut.phrase AS phrase, a, j, x.f AS l, y.f AS r, CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS score
           FROM cut JOIN f AS x ON x.lang = cut.lang AND x.phrase = cut.x JOIN f AS y ON y.lang = cut.lang AND y.phrase = cut.y),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (SELECT DISTINCT s.lang AS lang, s.phrase AS phrase FROM c AS s JOIN c AS b ON b.lang = s.lang AND s.k = 2 AND b.k = 3
         AND (s.phrase = b.w[1] || ' ' || b.w[2] OR s.phrase = b.w[2] || ' ' || b.w[3]) AND 100 * b.a >= 50 * s.a),
place AS (SELECT low.lang AS lang, low.phrase AS phrase, a, l, r, score, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, encode(low.phrase)) AS rank
          FROM low LEFT JOIN held ON held.lang = low.lang AND held.phrase = low.phrase WHERE held.phrase IS NULL)
SELECT place.lang AS lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM place JOIN total ON total.lang = place.lang WHERE rank <= 2000
""",
}
