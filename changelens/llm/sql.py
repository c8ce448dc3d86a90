"""Expected results in DuckDB SQL, where SQL can express the operator."""

_WORDS = r"""regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"""

#: Words of documents inside any occurrence of ten successive item words, or of a whole shorter item.
BENCHMARK_DECONTAMINATION = f"""
WITH item AS (SELECT item_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM benchmark),
item_window AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS size, w[i:i + least(10, len(w)) - 1] AS win
    FROM item, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS t(i)
),
doc AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
doc_window AS (
    SELECT d.doc_id, t.i, s.size, d.w[t.i:t.i + s.size - 1] AS win
    FROM doc d, (SELECT DISTINCT size FROM item_window) s, unnest(range(1, greatest(len(d.w) - s.size + 1, 0) + 1)) AS t(i)
),
occurrence AS (SELECT d.doc_id, d.i, d.size, m.item_id FROM doc_window d JOIN item_window m ON d.size = m.size AND d.win = m.win),
hit AS (SELECT DISTINCT o.doc_id, t.p FROM (SELECT DISTINCT doc_id, i, size FROM occurrence) o, unnest(range(o.i, o.i + o.size)) AS t(p)),
hits AS (SELECT doc_id, count(*) AS n_hit FROM hit GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occurrence) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.listed, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hits h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

#: Components of documents by exact Jaccard similarity of their five-word shingles.
NGRAM_JACCARD_JOIN = r"""
WITH RECURSIVE doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
shingle AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM doc, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS t(i)
),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
),
link AS MATERIALIZED (
    SELECT x, y FROM common JOIN size sx ON sx.doc_id = x JOIN size sy ON sy.doc_id = y
    WHERE 100 * c >= 75 * (sx.n + sy.n - c)
),
edge AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reached AS (
    SELECT doc_id AS x, doc_id AS y FROM doc
    UNION
    SELECT r.x, b.y FROM reached r JOIN edge b ON r.y = b.x
),
least AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, l.component_id
FROM doc d JOIN least l ON l.x = d.doc_id LEFT JOIN size s ON s.doc_id = d.doc_id
"""

#: The same with three-word shingles and a similarity of 0.85; the least document of each component is kept.
NEAR_DEDUP = r"""
WITH RECURSIVE doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
shingle AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
    FROM doc, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS t(i)
),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
),
link AS MATERIALIZED (
    SELECT x, y FROM common JOIN size sx ON sx.doc_id = x JOIN size sy ON sy.doc_id = y
    WHERE 100 * c >= 85 * (sx.n + sy.n - c)
),
edge AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reached AS (
    SELECT doc_id AS x, doc_id AS y FROM doc
    UNION
    SELECT r.x, b.y FROM reached r JOIN edge b ON r.y = b.x
),
least AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM doc d JOIN least l ON l.x = d.doc_id LEFT JOIN size s ON s.doc_id = d.doc_id
"""

_TERMS = r"""regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{digits}a-z\x{{80}}-\x{{10FFFF}}]+')"""

#: Divergence of each source of a language from the others, over its kept terms, and its terms above the language.
SOURCE_DIVERGENCE = f"""
WITH doc AS (
    SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS.format(text="coalesce(text, '')", digits="")} AS w FROM documents
),
grp AS MATERIALIZED (SELECT DISTINCT lang, source FROM doc),
cell AS MATERIALIZED (
    SELECT lang, source, term, count(*) AS n, count(DISTINCT doc_id) AS docs
    FROM (SELECT doc_id, lang, source, unnest(w) AS term FROM doc) GROUP BY ALL
),
kept AS MATERIALIZED (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM cell GROUP BY ALL HAVING sum(docs) >= 3),
vocabulary AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS total FROM kept GROUP BY ALL),
total AS (SELECT lang, source, sum(c.n) AS total FROM cell c JOIN kept k USING (lang, term) GROUP BY ALL),
p AS MATERIALIZED (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
           1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (CAST(coalesce(t.total, 0) AS HUGEINT) + v.v) AS p
    FROM grp g JOIN kept k USING (lang) JOIN vocabulary v USING (lang)
    LEFT JOIN total t ON t.lang = g.lang AND t.source = g.source
    LEFT JOIN cell c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
q AS MATERIALIZED (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (k.n + 1) // (v.total + v.v) AS q FROM kept k JOIN vocabulary v USING (lang)),
pair_value AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
item AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair_value x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM item)
WHERE part = 'pair' OR rank <= 200
"""

#: The ten documents with the highest scores for each benchmark item.
RANKED_SEARCH = f"""
WITH doc AS (SELECT doc_id, {_TERMS.format(text="coalesce(text, '')", digits="0-9")} AS w FROM documents),
stats AS MATERIALIZED (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM doc),
posting AS MATERIALIZED (
    SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM doc) GROUP BY doc_id, term
),
query AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS.format(text="coalesce(text, '')", digits="0-9")}) AS term FROM benchmark)),
weight AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM posting GROUP BY term), stats s
),
score AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * p.n * s.n) // s.l)))) AS BIGINT) AS score
    FROM query JOIN weight USING (term) JOIN posting p USING (term), stats s GROUP BY ALL
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0) WHERE rank <= 10
"""
