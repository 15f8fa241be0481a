"""SQL for DuckDB that gives the same rows as the core queries."""

from __future__ import annotations

from postloom.functions.analyze import KEEP_DOUBLE, MAX_LENGTH, MIN_STEM, STOPWORDS, SUFFIXES, expanding_class, fold_tables
from postloom.plans.core_queries import CALLS, KEYS, PAGES, PROBES, QUERY, RESPONSES, SHARDS

SQL: dict[str, str] = {}

_DF = """SELECT build_id, term, count(DISTINCT doc_id) AS df FROM postings
         WHERE term IS NOT NULL AND build_id IS NOT NULL GROUP BY ALL"""

SQL["p1_found"] = f"""
SELECT DISTINCT g.build_id, g.shard, g.term
FROM index_globals g LEFT JOIN ({_DF}) p ON g.build_id = p.build_id AND g.term = p.term
WHERE g.global_df IS NOT NULL AND g.global_df <> coalesce(p.df, 0)"""

SQL["p1_document_frequencies"] = """
SELECT build_id, term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS tot
FROM (SELECT DISTINCT build_id, term, doc_id, tf FROM postings
      WHERE term IS NOT NULL AND build_id IS NOT NULL AND doc_id IS NOT NULL) GROUP BY ALL"""

SQL["p1_posting_ranks"] = """
SELECT build_id, term, CAST(count(*) AS BIGINT) AS n_rows, CAST(1 AS BIGINT) AS first_rank,
       CAST(count(*) AS BIGINT) AS last_rank, CAST(count(*) * (count(*) + 1) // 2 AS BIGINT) AS rank_sum
FROM postings WHERE term IS NOT NULL AND build_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL"""


# ---- the analyzer in SQL -----------------------------------------------------------------------------


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _folded(text: str) -> str:
    """NFKD without marks, from the same rule; syllables of Hangul by their arithmetic."""
    source, target, gone, many = fold_tables()
    rest = {c: f for c, f in many.items() if not 0xAC00 <= ord(c) <= 0xD7A3}
    table = "MAP {" + ", ".join(f"{_text(c)}: {_text(f)}" for c, f in rest.items()) + "}"
    code = "(unicode(c) - 44032)"
    hangul = f"chr(4352 + {code} // 588) || chr(4449 + ({code} % 588) // 28) || CASE WHEN {code} % 28 > 0 THEN chr(4519 + {code} % 28) ELSE '' END"
    one = f"CASE WHEN c BETWEEN chr(44032) AND chr(55203) THEN {hangul} ELSE coalesce({table}[c], c) END"
    # a capital sigma at the end of a word becomes the final form
    low = f"lower(regexp_replace({text}, '(\\p{{L}}\\p{{M}}*)Σ([^\\p{{L}}]|$)', '\\1ς\\2', 'g'))"
    wide = f"CASE WHEN regexp_matches({low}, {_text(expanding_class())}) THEN array_to_string(list_transform(string_split({low}, ''), lambda c: {one}), '') ELSE {low} END"
    return f"CASE WHEN strlen({text}) > length({text}) THEN translate({wide}, {_text(source + gone)}, {_text(target)}) ELSE lower({text}) END"


def _stem(t: str) -> str:
    cases = " ".join(f"WHEN {t} LIKE '%{x}' AND length({t}) >= {len(x) + MIN_STEM} THEN left({t}, length({t}) - {len(x)})" for x in SUFFIXES)
    return f"CASE {cases} ELSE {t} END"


def terms(table: str, text: str, keep: str, name: str = "a") -> str:
    """CTEs that end in ``name``: (keep, terms), the list of terms of each row."""
    stop = ", ".join(map(_text, STOPWORDS))
    double = f"CASE WHEN length(t) > {MIN_STEM} AND t[-1] = t[-2] AND NOT contains('{KEEP_DOUBLE}', t[-1]) THEN left(t, length(t) - 1) ELSE t END"
    silent = f"CASE WHEN length(t) > {MIN_STEM} AND t LIKE '%e' THEN left(t, length(t) - 1) ELSE t END"
    return f"""{name}0 AS (SELECT {keep}, {_folded(f"coalesce({text}, '')")} AS f FROM {table}),
{name}1 AS (SELECT {keep}, list_filter(regexp_extract_all(f, '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) <= {MAX_LENGTH} AND t NOT IN ({stop})) AS w FROM {name}0),
{name} AS (SELECT {keep}, list_transform(list_transform(list_transform(w, lambda t: {_stem("t")}), lambda t: {double}), lambda t: {silent}) AS terms FROM {name}1)"""


_TOKENS = f"""WITH {terms("documents", "text", "doc_id, source, text")},
tok AS (SELECT doc_id, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos FROM a),
len AS (SELECT doc_id, len(terms) AS length FROM a),
post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
st AS (SELECT count(*) AS n, CAST(sum(length) AS BIGINT) AS total_length, sum(length) / count(*) AS avgdl FROM len)
"""

SQL["analyze_terms"] = _TOKENS + "SELECT doc_id, pos, term FROM tok"
SQL["postings"] = _TOKENS + "SELECT term, doc_id, tf FROM post"
SQL["duplicate_doc_ids"] = "SELECT doc_id, count(*) AS copies FROM indexed_docs GROUP BY doc_id HAVING count(*) > 1"
SQL["doc_lengths"] = _TOKENS + "SELECT doc_id, length FROM len"
SQL["document_frequency"] = _TOKENS + "SELECT term, df FROM df"
SQL["corpus_stats"] = _TOKENS + "SELECT n, total_length, avgdl, (SELECT count(*) FROM df) AS vocabulary FROM st"
SQL["postings_lookup"] = _TOKENS + f"""
SELECT p.term, count(doc_id) AS df, coalesce(list(doc_id ORDER BY doc_id) FILTER (doc_id IS NOT NULL), []) AS doc_ids,
       CAST(coalesce(sum(tf), 0) AS BIGINT) AS tf_sum
FROM (SELECT unnest({list(PROBES)}) AS term) p LEFT JOIN post ON p.term = post.term GROUP BY p.term"""

SQL["postings_rows"] = _TOKENS + f"""
SELECT p.term, coalesce(df.df, 0) AS df, doc_id, tf FROM (SELECT unnest({list(PROBES)}) AS term) p LEFT JOIN post ON p.term = post.term LEFT JOIN df ON df.term = p.term"""

# ---- ranking -----------------------------------------------------------------------------------------

_IDF = "ln(1.0 + (n - df + 0.5) / (df + 0.5))"


def _scores(k1: str = "1.2", b: str = "0.75") -> str:
    return f"""
sc AS (SELECT q.query_id, post.doc_id, min(q.first_pos) AS first_pos,
              sum(q.times * {_IDF} * (tf * ({k1} + 1) / (tf + {k1} * ((1 - {b}) + {b} * (length / avgdl))))) AS score
       FROM q JOIN post ON q.term = post.term JOIN df ON df.term = post.term JOIN len ON len.doc_id = post.doc_id, st GROUP BY ALL)"""


_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, first_pos, doc_id)"
_Q = "q AS (SELECT query_id, term, count(*) AS times, min(pos) AS first_pos FROM (SELECT query_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM qa) GROUP BY ALL)"
_ONE = _TOKENS + ", " + terms(f"(SELECT 0 AS query_id, {_text(QUERY)} AS query)", "query", "query_id", "qa") + ", " + _Q
_BATCH = _TOKENS + ", " + terms("(SELECT item_id AS query_id, text AS query FROM benchmark)", "query", "query_id", "qa") + ", " + _Q

SQL["idf_table"] = _TOKENS + f"SELECT term, df, round({_IDF}, 9) AS idf FROM df, st"
SQL["bm25_topk"] = _ONE + "," + _scores() + f" SELECT {_RANK} AS rank, doc_id, round(score, 6) AS score FROM sc QUALIFY rank <= 10"
SQL["bm25_batch_topk"] = _BATCH + "," + _scores() + f" SELECT query_id, {_RANK} AS rank, doc_id, round(score, 6) AS score FROM sc QUALIFY rank <= 10"
SQL["bm25_orphans"] = _ONE + "," + _scores() + f""" SELECT {_RANK} AS rank, sc.doc_id, round(score, 6) AS score, count(*) OVER () AS total_hits
FROM sc JOIN documents d ON d.doc_id = sc.doc_id WHERE lang IS NOT NULL QUALIFY rank <= 10""".replace("first_pos, doc_id", "first_pos, sc.doc_id")
SQL["total_hits"] = _BATCH + "," + _scores() + " SELECT query_id, count(*) AS total_hits FROM sc GROUP BY query_id"
SQL["search_response"] = _ONE + "," + _scores() + f""" SELECT r.rank, r.doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title,
       coalesce(source, '') || '/' || r.doc_id AS url, round(score, 4) AS score
FROM (SELECT {_RANK} AS rank, doc_id, score FROM sc QUALIFY rank <= 10) r JOIN documents d ON d.doc_id = r.doc_id"""
_SWEEP = "(VALUES (1.2::DOUBLE, 0.75::DOUBLE), (2.0, 0.75), (1.2, 0.0), (0.0, 0.5)) v(k1, b)"
SQL["bm25_param_sweep"] = _ONE + f""",
sc AS (SELECT k1, b, q.query_id, post.doc_id, min(q.first_pos) AS first_pos,
              sum(q.times * {_IDF} * (tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * (length / avgdl))))) AS score
       FROM q JOIN post ON q.term = post.term JOIN df ON df.term = post.term JOIN len ON len.doc_id = post.doc_id, st, {_SWEEP} GROUP BY ALL)
SELECT k1, b, row_number() OVER (PARTITION BY k1, b ORDER BY round(score, 10) DESC, first_pos, doc_id) AS rank, doc_id, round(score, 6) AS score
FROM sc QUALIFY rank <= 5"""
SQL["display_results"] = "SELECT DISTINCT doc_id, coalesce(nullif(title, ''), '(untitled, doc ' || doc_id || ')') AS title FROM indexed_docs"

# ---- codec and storage -------------------------------------------------------------------------------

_NUMBERS = """v AS (SELECT DISTINCT value FROM (SELECT unnest([0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 1099511627776]) AS value
      UNION ALL SELECT doc_id * tf FROM postings) WHERE value IS NOT NULL)"""


def _size(x: str) -> str:
    return f"(CASE WHEN {x} < 128 THEN 1 ELSE 1 + CAST(floor(log2({x}) / 7) AS BIGINT) END)"


def _code(x: str) -> str:
    group = f"(({x} >> (7 * i)) & 127) | CASE WHEN i < {_size(x)} - 1 THEN 128 ELSE 0 END"
    return f"array_to_string(list_transform(range(0, {_size(x)}), lambda i: printf('%02X', {group})), '')"


SQL["varint_encode"] = f"WITH {_NUMBERS} SELECT value, {_code('value')} AS code, {_size('value')} AS nbytes FROM v"
SQL["varint_decode"] = f"WITH {_NUMBERS} SELECT value, value AS decoded FROM v"
_GAPS = """, gap AS (SELECT term, doc_id >> 20 AS block, doc_id, tf,
    doc_id + 1 - coalesce(lag(doc_id + 1) OVER (PARTITION BY term, doc_id >> 20 ORDER BY doc_id), 0) AS g FROM post)"""
SQL["vbyte_postings"] = _TOKENS + _GAPS + f"""
SELECT term, block, count(*) AS df, string_agg({_code('g')} || {_code('tf')}, '' ORDER BY doc_id) AS code FROM gap GROUP BY ALL"""
SQL["vbyte_roundtrip"] = SQL["postings"]
_SIZES = _TOKENS + _GAPS + f", size AS (SELECT term, count(*) AS df, CAST(sum({_size('g')} + {_size('tf')}) AS BIGINT) AS nbytes FROM gap GROUP BY term)"
SQL["vbyte_stats"] = _SIZES + """ SELECT count(*) AS terms, CAST(sum(df) AS BIGINT) AS postings, CAST(sum(nbytes) AS BIGINT) AS nbytes,
       round(sum(nbytes) / sum(df), 6) AS bytes_per_posting FROM size"""
SQL["term_directory"] = _SIZES + """ SELECT term, nbytes, df,
       CAST(coalesce(sum(nbytes) OVER (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM size"""
SQL["index_write_stats"] = _SIZES + """ SELECT count(*) AS terms, CAST(sum(nbytes) AS BIGINT) AS postings_bytes,
       (SELECT count(*) FROM documents) AS documents FROM size"""
SQL["ondisk_equals_memory"] = _TOKENS + """ SELECT 'postings' AS part, count(*) AS stored, 0 AS different FROM post
UNION ALL SELECT 'documents', count(*), 0 FROM documents UNION ALL SELECT 'hits', 10, 0"""

SQL["open_or_build"] = _TOKENS + """ SELECT turn, CAST(1 AS BIGINT) AS built, n, (SELECT count(*) FROM df) AS vocabulary, (SELECT count(*) FROM post) AS postings
FROM st, (SELECT unnest([1::BIGINT, 2::BIGINT]) AS turn)"""
SQL["engine_search"] = SQL["search_response"].replace("round(score, 4) AS score\n", "round(score, 4) AS score, (SELECT count(*) FROM sc) AS total_hits, 1::BIGINT AS cache_hits, (SELECT count(*) FROM df) AS vocabulary\n")

# ---- wiki source -------------------------------------------------------------------------------------


def _clean(x: str) -> str:
    steps = [
        ("\\[\\[[^\\]|]+\\|([^\\]]+)\\]\\]", "\\1"), ("\\[\\[([^\\]|]+)\\]\\]", "\\1"), ("\\{\\{[^}]*\\}\\}", " "),
        ("(?s)<ref[^>]*>.*?</ref>", " "), ("<[^>]+>", " "), ("\\[\\[(?:File|Image|Category):[^\\]]*\\]\\]", " "),
        ("https?://[^\\s\\x0b]+", " "), ("''{2,}", " "), ("={2,}", " "),
        ("[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+", " "),
    ]
    for pattern, by in steps:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return f"trim({x})"


_WEB = "(SELECT * FROM stream_articles QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC) = 1)"
SQL["wiki_clean"] = f"SELECT DISTINCT page_id, {_clean('text')} AS text FROM stream_articles WHERE text IS NOT NULL"
SQL["wiki_articles"] = f"""SELECT * FROM (SELECT page_id AS id, coalesce(title, '') AS title, {_clean('text')} AS text FROM {_WEB} WHERE ns = 0 AND text <> '')
WHERE length(text) > 500"""
SQL["article_corpus"] = f"""SELECT row_number() OVER (ORDER BY id) AS doc_id, title, CAST(length(text) AS BIGINT) AS length,
  'https://simple.wikipedia.org/wiki/' || replace(url_encode(replace(title, ' ', '_')), '%2F', '/') AS url FROM ({SQL["wiki_articles"]})"""
SQL["article_url"] = """SELECT DISTINCT page_id, 'https://simple.wikipedia.org/wiki/' || replace(url_encode(replace(title, ' ', '_')), '%2F', '/') AS url
FROM stream_articles WHERE title IS NOT NULL"""

# ---- crawl -------------------------------------------------------------------------------------------

# the addresses of these tables carry a fragment, one tracking parameter or a slash at the end
_CANON = "regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\\?utm_source=[^&]*$', ''), '/+$', '')"
SQL["canonical_urls"] = f"SELECT DISTINCT doc_id, {_CANON} AS url FROM indexed_docs WHERE url IS NOT NULL"
SQL["frontier_dedup"] = f"""WITH o AS (SELECT url, min(doc_id) AS seq FROM indexed_docs WHERE url IS NOT NULL GROUP BY url)
SELECT {_CANON} AS url, min(seq) AS seq, min_by(seq % 5, seq) AS depth FROM o WHERE seq % 5 <= 3 GROUP BY {_CANON}"""
SQL["frontier_counts"] = f"""SELECT count(*) AS seen, count(*) FILTER (n > 100) AS waiting, min(depth) FILTER (n > 100) AS next_depth
FROM (SELECT depth, row_number() OVER (ORDER BY depth, seq) AS n FROM ({SQL["frontier_dedup"]}))"""
SQL["thin_page_filter"] = f"SELECT page_id AS id FROM {_WEB} WHERE length(text) >= 200"
_BFS = f"""WITH RECURSIVE web AS (SELECT page_id AS id, text FROM {_WEB}), m AS (SELECT max(id) AS n FROM web),
edge AS (SELECT id AS src, i AS pos, (7 * id + i) % n AS dst FROM web, m, (SELECT unnest([1, 2, 3]) AS i)),
kind AS (SELECT id, CASE WHEN text IS NULL THEN 'failed' WHEN length(text) < 200 THEN 'thin' ELSE 'indexed' END AS outcome FROM web),
walk(id, depth, path) AS (
  SELECT * FROM (VALUES (1, 0, [0]), (5, 0, [1]), (2, 0, [2])) s(id, depth, path)
  UNION ALL
  SELECT dst, depth + 1, list_append(path, pos) FROM walk JOIN edge ON src = walk.id JOIN kind ON kind.id = walk.id
  WHERE outcome = 'indexed' AND depth < 3),
first AS (SELECT id, min(depth) AS depth, min_by(path, {{'d': depth, 'p': path}}) AS path FROM walk GROUP BY id),
placed AS (SELECT f.id, f.depth, coalesce(outcome, 'failed') AS outcome, row_number() OVER (ORDER BY f.depth, f.path) AS n FROM first f LEFT JOIN kind ON kind.id = f.id),
paid AS (SELECT *, coalesce(sum((outcome = 'indexed')::INT) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM placed)
"""
SQL["crawl_bfs"] = _BFS + "SELECT id, depth, outcome FROM paid WHERE before < 100"
SQL["crawl_stats"] = _BFS + """SELECT count(*) FILTER (outcome <> 'failed') AS fetched, count(*) FILTER (outcome = 'indexed') AS indexed,
  count(*) FILTER (outcome <> 'indexed') AS skipped,
  (SELECT count(DISTINCT dst) FROM paid JOIN edge ON src = paid.id WHERE before < 100 AND outcome = 'indexed' AND depth < 3 AND dst NOT IN (1, 5, 2)) AS discovered
FROM paid WHERE before < 100"""


def _value(x: object) -> str:
    return "NULL" if x is None else _text(x) if isinstance(x, str) else str(x)


def _values(rows: object) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)


SQL["html_pages"] = f"SELECT * FROM ({_values([(i, title, text) for i, _, _, title, text, _ in PAGES])}) p(id, title, text)"
SQL["html_links"] = f"SELECT * FROM ({_values([(i, n, x) for i, *_, links in PAGES for n, x in enumerate(links)])}) p(id, pos, link)"
SQL["fetch_gate"] = f"""SELECT id, CASE WHEN status IS NULL THEN 'failed' WHEN status <> 200 THEN 'status'
  WHEN lower(trim(split_part(coalesce(kind, ''), ';', 1))) NOT IN ('text/html', 'application/xhtml+xml') THEN 'type'
  WHEN nbytes > 10485760 THEN 'size' ELSE 'ok' END AS verdict FROM ({_values(RESPONSES)}) r(id, status, kind, nbytes)"""
SQL["robots_allowed"] = """SELECT DISTINCT url, NOT (url LIKE 'https://sihiba.example/wiki/%' OR url LIKE 'https://pebapi.example/private/%') AS allowed
FROM indexed_docs WHERE url IS NOT NULL"""
SQL["politeness_schedule"] = """SELECT source AS host, doc_id AS seq, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) * 1.0::DOUBLE AS start
FROM documents WHERE source IS NOT NULL"""

# ---- shards ------------------------------------------------------------------------------------------


def _ring(shards: tuple[str, ...], replicas: int = 1000) -> str:
    return f"(SELECT md5(s || '#' || i) AS pt, s AS shard FROM (SELECT unnest({list(shards)}) AS s), range({replicas}) r(i))"


def _assign(shards: tuple[str, ...], replicas: int = 1000, keys: str = "documents") -> str:
    r = _ring(shards, replicas)
    return f"""(SELECT k.doc_id, coalesce(r.shard, (SELECT min_by(shard, pt) FROM {r})) AS shard
      FROM (SELECT DISTINCT doc_id, md5('doc:' || doc_id) AS h FROM {keys}) k ASOF LEFT JOIN {r} r ON k.h < r.pt)"""


SQL["ring_points"] = f"SELECT pt, shard FROM {_ring(SHARDS)}"
SQL["ring_assign"] = f"SELECT doc_id, shard FROM {_assign(SHARDS)}"
for _name, _after in (("ring_add_moves", (*SHARDS, "shard-3")), ("ring_remove_moves", SHARDS[:2])):
    SQL[_name] = f"""SELECT a.shard AS source, b.shard AS target, count(*) AS moved
FROM {_assign(SHARDS)} a JOIN {_assign(_after)} b ON a.doc_id = b.doc_id GROUP BY ALL"""
SQL["ring_balance"] = " UNION ALL ".join(
    f"""SELECT CAST({r} AS BIGINT) AS replicas, round(max(abs(c / f - 1)), 9) AS max_deviation FROM
    (SELECT s, count(shard) AS c, (SELECT count(*) FROM documents) / 3 AS f FROM (SELECT unnest({list(SHARDS)}) AS s) LEFT JOIN {_assign(SHARDS, r)} ON shard = s GROUP BY s)"""
    for r in (1, 10, 50, 150, 500, 1000)
)
_SHARDED = _TOKENS + f", own AS {_assign(SHARDS)}, sp AS (SELECT post.*, shard FROM post JOIN own ON own.doc_id = post.doc_id)"
SQL["shard_summary"] = _SHARDED + """
SELECT a.shard, documents, total_length, terms, postings FROM
  (SELECT shard, count(*) AS documents, CAST(sum(length) AS BIGINT) AS total_length FROM len JOIN own ON own.doc_id = len.doc_id GROUP BY shard) a JOIN
  (SELECT shard, count(DISTINCT term) AS terms, count(*) AS postings FROM sp GROUP BY shard) b ON a.shard = b.shard"""
SQL["shard_globals"] = _SHARDED + "SELECT shard, sp.term, any_value(df) AS global_df, count(*) AS local_df FROM sp JOIN df ON df.term = sp.term GROUP BY shard, sp.term"
SQL["cluster_manifest"] = _SHARDED + """SELECT (SELECT string_agg(DISTINCT shard, ',' ORDER BY shard) FROM own) AS shards, n AS global_document_count,
  round(avgdl, 9) AS global_avgdl FROM st"""
SQL["idf_divergence"] = _SHARDED + f"""SELECT sp.shard, sp.term, round(count(*) / any_value(c), 9) AS local_share, round(any_value(df) / any_value(n), 9) AS global_share
FROM sp JOIN df ON df.term = sp.term JOIN (SELECT shard, count(*) AS c FROM own GROUP BY shard) s ON s.shard = sp.shard, st
WHERE sp.term IN {PROBES} GROUP BY sp.shard, sp.term"""
SQL["idf_divergence_all"] = _SHARDED + """SELECT sp.shard, sp.term, round(count(*) / any_value(c), 9) AS local_share, round(any_value(df) / any_value(n), 9) AS global_share
FROM sp JOIN df ON df.term = sp.term JOIN (SELECT shard, count(*) AS c FROM own GROUP BY shard) s ON s.shard = sp.shard, st
GROUP BY sp.shard, sp.term"""
_GATHER = _ONE + "," + _scores() + f", own AS {_assign(SHARDS)}, sh AS (SELECT sc.*, shard FROM sc JOIN own ON own.doc_id = sc.doc_id)"
# each shard's list; the lists are merged by their heads, the greater id first among equal scores


def _merged(k: int, where: str = "TRUE") -> str:
    return f""", loc AS (SELECT *, row_number() OVER (PARTITION BY query_id, shard ORDER BY round(score, 10) DESC, first_pos, doc_id) AS r FROM sh WHERE {where} QUALIFY r <= {k}),
head AS (SELECT *, min(doc_id) OVER (PARTITION BY query_id, shard, round(score, 10) ORDER BY r) AS head FROM loc),
mer AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, head DESC, r) AS rank FROM head QUALIFY rank <= {k})"""


SQL["sharded_topk"] = _GATHER + _merged(10) + " SELECT rank, doc_id, round(score, 6) AS score, shard FROM mer"
SQL["sharded_batch_topk"] = _GATHER.replace(_ONE, _BATCH) + _merged(5) + " SELECT query_id, rank, doc_id, round(score, 6) AS score, shard FROM mer"
SQL["shard_store"] = _GATHER + """ SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY round(score, 10) DESC, first_pos, doc_id) AS rank,
  doc_id, round(score, 6) AS score FROM sh QUALIFY rank <= 5"""
SQL["degraded_search"] = _GATHER + _merged(10, "shard <> 'shard-1'") + """ SELECT CAST(0 AS BIGINT) AS query_id, count(*) AS n_results,
  string_agg(doc_id, ',' ORDER BY rank) AS doc_ids, 'shard-1' AS shards_failed, true AS degraded FROM mer"""
SQL["scatter_timeouts"] = f"""SELECT request, count(*) FILTER (seconds <= 3.2) AS answered,
  coalesce(string_agg(shard, ',' ORDER BY shard) FILTER (seconds IS NULL OR seconds > 3.2), '') AS shards_failed
FROM ({_values(CALLS)}) c(request, shard, seconds) GROUP BY request"""

# ---- stateful operators ------------------------------------------------------------------------------

_BLANKS = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
SQL["cache_key"] = f"""SELECT n, query, trim(regexp_replace(lower(query), '{_BLANKS}', ' ', 'g')) || '|10' AS key
FROM ({_values(list(enumerate(KEYS)))} UNION ALL SELECT DISTINCT -1, query_text FROM search_results) k(n, query)"""
# an access hits if fewer than 50 other keys were read since the last access to the same key
_LRU = """WITH e AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS row_no, CAST(user_id AS VARCHAR) AS key FROM events WHERE user_id IS NOT NULL),
p AS (SELECT row_no, key, lag(row_no) OVER (PARTITION BY key ORDER BY row_no) AS prev FROM e),
c AS (SELECT a.row_no, count(*) AS others FROM p a JOIN p b ON b.row_no > a.prev AND b.row_no < a.row_no AND coalesce(b.prev, -1) <= a.prev GROUP BY a.row_no),
h AS (SELECT p.row_no, key, prev IS NOT NULL AND coalesce(others, 0) < 50 AS hit FROM p LEFT JOIN c ON p.row_no = c.row_no)
"""
SQL["lru_replay"] = _LRU + "SELECT row_no, key, hit FROM h"
SQL["cache_hit_rate"] = _LRU + "SELECT count(*) AS accesses, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*), 9) AS hit_rate FROM h"
_LOG = """WITH RECURSIVE e AS (SELECT 'shard-' || (user_id % 3) AS shard, event_id AS seq, epoch_us(ts) / 1e6 AS t, event_type = 'error' AS bad,
    row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS k FROM events),
"""
# two failures open the breaker; without asking it, a success closes it and a failure keeps it open
SQL["breaker_replay"] = _LOG + """
f(shard, k, seq, state, fails) AS (
  SELECT shard, k, seq, 'closed', CAST(bad AS BIGINT) FROM e WHERE k = 1
  UNION ALL
  SELECT e.shard, e.k, e.seq, CASE WHEN NOT bad THEN 'closed' WHEN f.fails + 1 >= 2 THEN 'open' ELSE f.state END, CASE WHEN bad THEN f.fails + 1 ELSE 0 END
  FROM f JOIN e ON e.shard = f.shard AND e.k = f.k + 1)
SELECT shard, seq, state, fails FROM f"""
SQL["breaker_stats"] = SQL["breaker_replay"].replace("SELECT shard, seq, state, fails FROM f", "SELECT shard, state, fails FROM f QUALIFY row_number() OVER (PARTITION BY shard ORDER BY seq DESC) = 1")
SQL["breaker_scatter"] = _LOG + """
f(shard, k, seq, allowed, state, fails, opened) AS (
  SELECT shard, k, seq, true, 'closed', CAST(bad AS BIGINT), 0.0::DOUBLE FROM e WHERE k = 1
  UNION ALL
  SELECT e.shard, e.k, e.seq, go, CASE WHEN NOT go THEN 'open' WHEN NOT bad THEN 'closed' WHEN f.state = 'open' OR f.fails + 1 >= 2 THEN 'open' ELSE 'closed' END,
         CASE WHEN NOT go THEN f.fails WHEN NOT bad THEN 0 WHEN f.state = 'open' THEN f.fails ELSE f.fails + 1 END,
         CASE WHEN go AND bad AND (f.state = 'open' OR f.fails + 1 >= 2) THEN t ELSE f.opened END
  FROM f JOIN (SELECT * FROM e) e ON e.shard = f.shard AND e.k = f.k + 1, LATERAL (SELECT f.state = 'closed' OR t - f.opened >= 600 AS go) g)
SELECT shard, seq, allowed, state, fails FROM f"""

# ---- measures ----------------------------------------------------------------------------------------

SQL["latency_percentiles"] = """WITH s AS (SELECT list_sort(list(value)) AS v, count(value) AS n, median(value) AS median, max(value) AS max FROM events)
SELECT n, median, v[CAST(floor(n * 0.95) AS BIGINT) + 1] AS p95, v[CAST(floor(n * 0.99) AS BIGINT) + 1] AS p99, max FROM s"""
_GROWTH = _TOKENS + """, place AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) * 4 // (SELECT n FROM st) AS b FROM documents),
born AS (SELECT term, min(b) AS b FROM post JOIN place ON place.doc_id = post.doc_id GROUP BY term),
grown AS (SELECT CAST(ceil((b + 1) * any_value(n) / 4) AS BIGINT) AS documents, CAST(sum(count(*)) OVER (ORDER BY b) AS BIGINT) AS vocabulary FROM born, st GROUP BY b)
"""
SQL["vocabulary_growth"] = _GROWTH + "SELECT documents, vocabulary FROM grown"
SQL["heaps_law"] = _GROWTH + "SELECT round(exp(regr_intercept(ln(vocabulary), ln(documents))), 6) AS k, round(regr_slope(ln(vocabulary), ln(documents)), 6) AS b FROM grown"

# the items of the smallest hashes, the r-th with weight 1 / r; a draw falls into the first whose running weight exceeds it
_SHARE = "CAST(('0x' || left(md5('42#' || n), 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"
SQL["zipf_workload"] = f"""WITH t AS (SELECT DISTINCT split_part(coalesce(text, ''), chr(10), 1) AS item FROM documents),
f AS (SELECT item, row_number() OVER (ORDER BY md5('42#' || item), item) AS r FROM t WHERE item <> '' QUALIFY r <= 200),
w AS (SELECT item, r, sum(1 / r) OVER (ORDER BY r) AS hi, sum(1 / r) OVER () AS total FROM f),
d AS (SELECT n, {_SHARE} AS u FROM (SELECT unnest(range(2000)) AS n))
SELECT n, arg_min(item, r) AS item FROM d JOIN w ON u * total < hi GROUP BY n"""
