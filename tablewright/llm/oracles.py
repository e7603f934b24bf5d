"""DuckDB SQL of the operators that SQL can express, over the same tables."""

from __future__ import annotations

from tablewright.llm.quality_rules import BUCKETS, MULTIPLIER, SMOOTHING, THRESHOLD

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_BREAK = r"'[ \t\n\r\x0B\x0C]+'"

QUALITY_RULES = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), {_BREAK}), lambda x: x <> '') AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)),
    lambda x: regexp_matches(x, '[^ \t\n\r\x0B\x0C]')) AS l FROM docs),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM docs WHERE len(w) > 7)),
twice AS (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM (SELECT *, count(*) OVER
    (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
again AS (SELECT doc_id, count(DISTINCT place) AS n FROM twice GROUP BY doc_id),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM docs JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id)),
hexed AS (SELECT doc_id, hex(encode(' ' || array_to_string(w, ' ') || ' ')) AS h FROM docs),
grams AS (SELECT doc_id, ((CAST('0x' || substr(h, 2 * i + 1, 8) AS BIGINT) * {MULTIPLIER})
    & 4294967295) * {BUCKETS} >> 32 AS bucket
    FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 3)) AS i FROM hexed)),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
counts AS (SELECT bucket, count(*) AS raw, count(good.doc_id) AS target
    FROM grams LEFT JOIN good USING (doc_id) GROUP BY bucket),
sums AS (SELECT CAST(sum(target) AS DOUBLE) / CAST(sum(raw) AS DOUBLE) AS share FROM counts),
ratios AS (SELECT bucket, ln(target + CAST({SMOOTHING} AS DOUBLE))
    - ln(raw * share + CAST({SMOOTHING} AS DOUBLE)) AS r FROM counts, sums),
scores AS (SELECT doc_id, round(avg(r), 6) + 0.0 AS s FROM grams JOIN ratios USING (bucket)
    GROUP BY doc_id),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    CAST(coalesce(s, 0) AS DOUBLE) AS log_ratio,
    NOT base_failed AND coalesce(s, 0) >= {THRESHOLD} AS kept
FROM judged LEFT JOIN scores USING (doc_id)
"""

REPEATED_PASSAGES = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
    FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM docs WHERE len(h) >= 100)),
firsts AS (SELECT s, min(doc_id) AS f FROM windows GROUP BY s),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE f < doc_id),
starts AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 50 THEN 0 ELSE 1 END AS new
    FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM starts),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY ALL),
gaps AS (SELECT doc_id, lag(b, 1, 0) OVER w AS a, a AS b
    FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
    UNION ALL SELECT doc_id, max(b), max(len(h)) // 2 FROM spans JOIN docs USING (doc_id)
    GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS rest
    FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id),
totals AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes,
    CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM docs LEFT JOIN totals USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

JUMP_SHARDING = """
WITH RECURSIVE jumps AS (
    SELECT doc_id, (CAST(doc_id AS HUGEINT) + 18446744073709551616) % 18446744073709551616 AS k,
        CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM documents
    UNION ALL
    SELECT doc_id, k2, j, CAST(floor(CAST(j + 1 AS DOUBLE)
        * (CAST(2147483648 AS DOUBLE) / CAST((k2 // 8589934592) + 1 AS DOUBLE))) AS BIGINT)
    FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM jumps
        WHERE j < 24)),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(
    list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(unnest(range(0, 256)) AS BIGINT) AS i))),
bytes AS (SELECT doc_id, h, list_prepend(CAST(4294967295 AS BIGINT), list_transform(
    range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))) AS l
    FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)),
crcs AS (SELECT doc_id, CAST(len(h) // 2 + 8 AS BIGINT) AS size, xor(list_reduce(l,
    lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295) AS text_crc32
    FROM bytes, crc_table)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law,
    CAST(b AS INTEGER) AS shard,
    CAST(row_number() OVER (PARTITION BY b ORDER BY doc_id) - 1 AS BIGINT) AS slot,
    CAST(CASE WHEN j = 24 THEN 24 ELSE b END AS INTEGER) AS grown_shard
FROM jumps JOIN crcs USING (doc_id) WHERE j >= 24
"""

EMBEDDING_LINKS = """
WITH RECURSIVE rows AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM rows WHERE label IS NOT NULL
    AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS v, b.vec_id AS o FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reached AS (SELECT v, o FROM links UNION SELECT r.v, l.o FROM reached r JOIN links l ON r.o = l.v),
lowest AS (SELECT v, min(o) AS low FROM reached GROUP BY v),
degrees AS (SELECT v, count(*) AS n FROM links GROUP BY v)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links,
    least(vec_id, coalesce(low, vec_id)) AS component_id,
    vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM rows LEFT JOIN lowest ON lowest.v = vec_id LEFT JOIN degrees ON degrees.v = vec_id
"""

LINE_DEDUP = f"""
WITH lines AS (SELECT doc_id, i, line, translate(trim(line, {_BLANKS}),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
common AS (SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10
    GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT doc_id, i, line, coalesce(owner < doc_id, false) AS gone
    FROM lines LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

SPELLING_VARIANTS = rf"""
WITH RECURSIVE runs AS MATERIALIZED (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id,
        unnest(regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}),
            '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(
    list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(unnest(range(0, 256)) AS BIGINT) AS i))),
bytes AS (SELECT run, k, list_prepend(CAST(4294967295 AS BIGINT), list_transform(
    range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))) AS l
    FROM (SELECT run, k, hex(encode(doc_id || ':' || run)) AS h FROM runs)),
crcs AS (SELECT run, k, xor(list_reduce(l,
    lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295) AS h
    FROM bytes, crc_table),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 97 = 0
    THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM crcs) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cuts AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
    FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b
        ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT c.word, c.n, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest
    UNION SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM near GROUP BY word),
tops AS (SELECT word, n_near, best_n, min(other) AS best FROM near JOIN best USING (word)
    WHERE other_n = best_n GROUP BY ALL),
forms AS MATERIALIZED (SELECT word, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
    CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
    FROM words LEFT JOIN tops USING (word)),
ways AS (SELECT word, word AS root, form AS next FROM forms
    UNION ALL SELECT y.word, f.word, f.form FROM ways y JOIN forms f ON y.next = f.word)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN ways USING (word) WHERE next IS NULL
"""
