"""SQL for DuckDB that gives the same rows as the queries of the training-data operators."""

from __future__ import annotations

from postloom.llm.quality import COMMON_WORDS

SQL: dict[str, str] = {}

_ONCE = "(SELECT DISTINCT build_id, term, doc_id, tf FROM postings WHERE build_id IS NOT NULL AND term IS NOT NULL AND doc_id IS NOT NULL)"
_N = "(SELECT build_id, count(DISTINCT doc_id) AS n FROM indexed_docs GROUP BY build_id)"

_FREQ = f"""
WITH f AS (
  SELECT build_id, 'term' AS field, term AS entry, sum(tf) AS occurrences, count(*) AS records FROM {_ONCE} GROUP BY ALL
  UNION ALL
  SELECT build_id, 'length', CAST(length AS VARCHAR), count(*), count(*)
  FROM (SELECT DISTINCT build_id, doc_id, length FROM indexed_docs WHERE length IS NOT NULL) GROUP BY ALL),
m AS (
  SELECT f.*, CASE WHEN field = 'term' THEN occurrences < 4 OR records < 2 ELSE records = 1 END AS rare,
         CASE WHEN field = 'term' THEN records * 10 > coalesce(n, 0) ELSE records * 20 > coalesce(n, 0) END AS common
  FROM f LEFT JOIN {_N} d ON f.build_id = d.build_id)
"""
SQL["p2_found"] = _FREQ + """
SELECT build_id, field, entry, 'rare' AS mark FROM m WHERE rare
UNION ALL SELECT build_id, field, entry, 'common' FROM m WHERE common"""
SQL["p2_frequencies"] = _FREQ + """
SELECT build_id, field, entry, CAST(occurrences AS BIGINT) AS occurrences, CAST(records AS BIGINT) AS records, rare, common FROM m"""

_RANKED = """
WITH r AS (SELECT query_id, doc_id, score FROM shard_results UNION ALL SELECT query_id, doc_id, score FROM search_results),
b AS (SELECT query_id, doc_id, max(score) AS score FROM r WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b)
"""
SQL["p4_found"] = _RANKED + "SELECT query_id, doc_id FROM k WHERE rank <= 10"
SQL["p4_ranked"] = _RANKED + "SELECT query_id, doc_id, score, rank FROM k WHERE rank <= 10"

SQL["p6_found"] = f"""
WITH o AS {_ONCE},
s AS (SELECT build_id, term, count(*) AS df FROM o GROUP BY ALL),
w AS (SELECT o.build_id, o.doc_id, o.term, o.tf * ln(1 + (coalesce(n, 0) - df + 0.5) / (df + 0.5)) AS w
      FROM o JOIN s ON o.build_id = s.build_id AND o.term = s.term LEFT JOIN {_N} d ON o.build_id = d.build_id)
SELECT build_id, doc_id, term FROM w QUALIFY row_number() OVER (PARTITION BY build_id, doc_id ORDER BY w DESC, term) = 1"""

_STEP = """, e{k} AS (SELECT *, tf * 0.1 * p / (0.1 * p + 0.9 * bg) AS e FROM m{j}),
m{k} AS (SELECT build_id, doc_id, term, tf, bg, e / sum(e) OVER (PARTITION BY build_id, doc_id) AS p FROM e{k})"""
SQL["p6_steps"] = f"""
WITH o AS (SELECT build_id, term, doc_id, CAST(coalesce(tf, 0) AS DOUBLE) AS tf FROM {_ONCE}),
b AS (SELECT build_id, term, sum(tf) / sum(sum(tf)) OVER (PARTITION BY build_id) AS bg FROM o GROUP BY build_id, term),
m0 AS (SELECT o.build_id, o.doc_id, o.term, tf, bg, tf / sum(tf) OVER (PARTITION BY o.build_id, o.doc_id) AS p
       FROM o JOIN b ON o.build_id = b.build_id AND o.term = b.term)""" + "".join(_STEP.format(j=k - 1, k=k) for k in (1, 2, 3)) + """
SELECT build_id, doc_id, term, round(p, 7) AS p FROM m3"""
SQL["p7_decoded"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"

# every run of 12 words of an item, or the whole of a shorter one, against the runs of that length of a document
_LISTS = "list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda w: lower(w))"
SQL["p8_found"] = f"""
WITH i AS (SELECT item_id, {_LISTS} AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item_id, w, least(12, len(w)) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS run
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM s)),
d AS (SELECT doc_id, {_LISTS} AS w FROM documents WHERE text IS NOT NULL),
dw AS (SELECT doc_id, n, array_to_string(w[k : k + n - 1], ' ') AS run
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM s)))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.run = iw.run"""

# equal words on one diagonal; a run is a stretch of them without a gap
SQL["p8_runs"] = f"""
WITH i AS (SELECT item_id, {_LISTS} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS ip FROM i),
d AS (SELECT doc_id, {_LISTS} AS w FROM documents WHERE text IS NOT NULL),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS dp FROM d),
hit AS (SELECT doc_id, item_id, n, dp - ip AS diagonal, ip FROM dw JOIN iw ON dw.word = iw.word),
run AS (SELECT doc_id, item_id, n, diagonal, ip - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY ip) AS island FROM hit),
size AS (SELECT doc_id, item_id, n, count(*) AS size FROM run GROUP BY doc_id, item_id, n, diagonal, island)
SELECT doc_id, item_id, n AS item_words, max(size) AS equal_run FROM size GROUP BY doc_id, item_id, n HAVING max(size) >= least(12, n)"""

_COMMON = ", ".join(f"'{w}'" for w in sorted(COMMON_WORDS))
SQL["p9_statistics"] = f"""
WITH b AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) AS l,
    regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+', '', 'g') AS s FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(array_to_string(w, '')) AS letters, len(s) AS shown, len(l) AS lines,
    len(list_filter(l, lambda x: regexp_matches(x, '[.!?…。！？؟।]["''”’»)」』]*[ \\t\\n\\x0b\\f\\r]*$'))) AS ended,
    len(list_filter(w, lambda x: lower(x) IN ({_COMMON}))) AS common FROM b)
SELECT doc_id, CAST(n AS BIGINT) AS words, CASE WHEN n > 0 THEN letters / n END AS mean_word_length,
       CASE WHEN shown > 0 THEN (shown - letters) / shown END AS symbol_ratio,
       CASE WHEN lines > 0 THEN ended / lines END AS ended_lines, CASE WHEN n > 0 THEN common / n END AS common_words FROM c"""
