"""DuckDB SQL for the queries that SQL expresses beside those in the operators' own modules."""

WORDS = r"[^\x20\x09-\x0D]+"

SUBSTRING_DEDUP = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM places),
firsts AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (k) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS root FROM w UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.a),
comp AS (SELECT a AS doc_id, min(root) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows of ten words as strings, met by equality.
CONTAMINATION = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS MATERIALIZED (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k + 1 : k + least(10, len(w))], ' ') AS key
    FROM items, unnest(range(0, greatest(1, len(w) - 9))) AS p(k) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, k, n, array_to_string(w[k + 1 : k + n], ' ') AS key FROM docs, sizes, unnest(range(0, len(w) - n + 1)) AS p(k) WHERE len(w) >= n),
met AS MATERIALIZED (SELECT r, k, places.n, item_id FROM places JOIN windows ON places.n = windows.n AND places.key = windows.key),
hit AS (SELECT r, count(DISTINCT k + j) AS n_hit FROM (SELECT DISTINCT r, k, n FROM met), unnest(range(0, n)) AS q(j) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM met WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
"""

_TERMS = r"regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: Every document scored for every item through its terms.
RANKED = f"""
WITH terms AS (SELECT r, doc_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM (SELECT row_number() OVER () AS r, doc_id, unnest({_TERMS}) AS t FROM documents)),
counts AS MATERIALIZED (SELECT r, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY r),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, corpus GROUP BY term, n_docs),
asked AS (SELECT DISTINCT q, item_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS}) AS t FROM benchmark)),
scores AS (
    SELECT q, item_id, counts.r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths ON counts.r = lengths.r CROSS JOIN corpus GROUP BY q, item_id, counts.r, doc_id
),
placed AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM placed WHERE place <= 10
"""

#: The crc32 goes byte by byte through a table that eight steps of the polynomial make; near words meet through the words less one code point. Chains of forms are followed by recursion.
SPELLING = """
WITH RECURSIVE crc_table AS MATERIALIZED (
    SELECT list(list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY x) AS t FROM range(256) AS r(x)
),
runs AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS w FROM documents)),
counted AS (SELECT doc_id, w, count(*) AS n FROM runs GROUP BY doc_id, w),
coded AS (SELECT *, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END FOR c IN string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, '')]) AS bytes FROM counted),
hashed AS (SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(b AS BIGINT) FOR b IN bytes]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM coded, crc_table),
damaged AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS MATERIALIZED (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM words, unnest(range(0, length(word))) AS p(k)),
near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM words a JOIN less b ON a.word = b.rest
    UNION SELECT b.word, b.n, a.word, a.n FROM words a JOIN less b ON a.word = b.rest
),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS MATERIALIZED (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)
),
chains AS (SELECT word, word AS root FROM forms UNION ALL SELECT chains.word, forms.form FROM chains JOIN forms ON chains.root = forms.word WHERE forms.form IS NOT NULL),
roots AS (SELECT chains.word, chains.root FROM chains JOIN forms ON chains.root = forms.word WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
