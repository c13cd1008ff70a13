"""DuckDB SQL for the registered queries, composed from shared common table expressions."""

from __future__ import annotations

import re

import numpy as np

from citadex.plans.roles import PREFIXES
from citadex.settings import (
    ACRONYMS, DEFAULT_GUIDANCE, DEFAULT_LABEL, GLOSSARY_CONFIDENCE, GLOSSARY_REASONING, INTENT_GUIDANCE, INTENT_LABELS,
    INTENT_RULES, NO_CITATION_NOTE, STOP_WORDS, TYPOS, VALIDATED_CONFIDENCE,
)

CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


def _needed(sql: str, seen: list[str]) -> None:
    for name in CTES:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(CTES[name], seen)
            if name not in seen:
                seen.append(name)


def assembled() -> dict[str, str]:
    out = {}
    for name, sql in ORACLES.items():
        used: list[str] = []
        _needed(sql, used)
        head = ",\n".join(f"{c} AS ({CTES[c]})" for c in used)
        out[name] = f"WITH {head}\n{sql}" if head else sql
    return out


def quoted(value: str) -> str:
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def prefix(n: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PREFIXES[:5]))
    return f"CASE ({n}) % 6 {cases} ELSE '{PREFIXES[5]}' END"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return rf"regexp_extract_all({x}, '\S+')"


def tokens(x: str) -> str:
    return words(f"lower({x})")


def mapping(pairs: dict[str, str], key: str, default: str) -> str:
    cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in pairs.items())
    return f"CASE {key} {cases} ELSE {quoted(default)} END"


def intent_case(q: str, part: int) -> str:
    def value(rule):
        return quoted(rule[1]) if part == 0 else f"{rule[2]}e0"

    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({q}), {quoted(n)})" for n in rule[0]) + f" THEN {value(rule)}" for rule in INTENT_RULES
    )
    return f"CASE {cases} ELSE {quoted('lookup') if part == 0 else '0.6e0'} END"


def keywords(q: str) -> str:
    stop = ", ".join(quoted(w) for w in STOP_WORDS)
    return rf"list_filter(regexp_extract_all(lower({q}), '[\p{{L}}\p{{N}}_]+'), lambda w: w NOT IN ({stop}) AND length(w) > 2)"


def cleaned(q: str) -> str:
    out = f"array_to_string({words(q)}, ' ')"
    for wrong, right in TYPOS.items():
        out = f"replace({out}, '{wrong}', '{right}')"
    return out


def expanded(q: str) -> str:
    key = "regexp_replace(lower(w), '^[.,!?;:]+|[.,!?;:]+$', '', 'g')"
    cases = " ".join(f"WHEN '{k}' THEN w || ' ({v})'" for k, v in ACRONYMS.items())
    return f"array_to_string(list_transform({words(q)}, lambda w: CASE {key} {cases} ELSE w END), ' ')"


def variations(table: str, limit: int = 3) -> str:
    q = "query"
    options = [
        q, expanded(cleaned(q)),
        *[f"CASE WHEN intent_type = 'troubleshooting' THEN '{w} ' || {q} END" for w in ("error", "fix", "solve")],
        f"CASE WHEN intent_type = 'definition' THEN 'what is ' || {q} END",
        f"CASE WHEN intent_type = 'definition' THEN {q} || ' definition' END",
        f"CASE WHEN intent_type = 'comparison' THEN {q} || ' differences' END",
        f"CASE WHEN intent_type = 'comparison' THEN 'compare ' || {q} END",
    ]
    raw = ", ".join(f"({i}, {o})" for i, o in enumerate(options))
    return f"""
      SELECT query_id, rn - 1 AS variant_ix, variant FROM (
        SELECT query_id, variant, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rn FROM (
          SELECT query_id, v.variant AS variant, min(v.pos) AS pos
          FROM {table}, LATERAL (SELECT * FROM (VALUES {raw}) AS t(pos, variant)) v
          WHERE v.variant IS NOT NULL GROUP BY 1, 2))
      WHERE rn <= {limit}"""


def index_ctes(p: str, nodes: str) -> None:
    cte(f"{p}_tok", f"SELECT node_id, {tokens('text')} AS t FROM {nodes}")
    cte(f"{p}_post", f"SELECT node_id, dl, term, count(*) AS tf FROM (SELECT node_id, len(t) AS dl, unnest(t) AS term FROM {p}_tok) GROUP BY ALL")
    cte(f"{p}_corpus", f"SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {p}_tok WHERE len(t) > 0")
    cte(f"{p}_df", f"SELECT term, count(*) AS df FROM {p}_post GROUP BY 1")
    cte(f"{p}_raw", f"SELECT term, df, ln(n - df + 0.5e0) - ln(df + 0.5e0) AS raw FROM {p}_df, {p}_corpus")
    cte(f"{p}_idf", f"SELECT term, df, CASE WHEN raw < 0 THEN 0.25e0 * avg(raw) OVER () ELSE raw END AS idf FROM {p}_raw")


def ranked(scored: str, keys: str = "query_id", k: str | int | None = None, extra: str = "") -> str:
    cut = f"WHERE rank <= {k}" if k is not None else ""
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, node_id) AS rank FROM ({scored})) {cut}"


def bm25(p: str, queries: str, k: int, keys: str = "query_id", text: str = "query", post: str | None = None) -> str:
    return ranked(f"""
      SELECT {keys}, node_id, round(sum(qtf * idf * (tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl)))), 6) AS score
      FROM (SELECT {keys}, term, count(*) AS qtf FROM (SELECT {keys}, unnest({tokens(text)}) AS term FROM {queries}) GROUP BY ALL)
      JOIN {p}_idf USING (term) JOIN {post or p + '_post'} USING (term), {p}_corpus
      GROUP BY {keys}, node_id HAVING score > 0""", keys, k)


def dense(queries: str, vectors: str, k: int) -> str:
    return ranked(f"""
      SELECT q.query_id, v.node_id,
        round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
      FROM {queries} q, {vectors} v WHERE v.node_id <> q.query_id AND q.embedding IS NOT NULL""", "query_id", k)


def fusion(dense_hits: str, sparse_hits: str, keys: str = "query_id") -> str:
    norm = lambda t, c: f"SELECT {keys}, node_id, CASE WHEN m > 0 THEN score / m ELSE 0e0 END AS {c} FROM (SELECT *, max(score) OVER (PARTITION BY {keys}) AS m FROM {t})"
    return f"""SELECT {keys}, node_id, coalesce(dense, 0e0) AS dense, coalesce(bm25, 0e0) AS bm25,
      round(0.5e0 * coalesce(dense, 0e0) + 0.5e0 * coalesce(bm25, 0e0), 6) AS score
      FROM ({norm(dense_hits, 'dense')}) d FULL OUTER JOIN ({norm(sparse_hits, 'bm25')}) b USING ({keys}, node_id)"""


def windowed(hits: str, k: int) -> str:
    return f"""SELECT * FROM (
      SELECT query_id, node_id, score,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank,
        round(avg(score) OVER (PARTITION BY query_id) - 0.5e0 * stddev_pop(score) OVER (PARTITION BY query_id), 6) AS floor_
      FROM ({hits})) WHERE (score >= floor_ OR rank <= {k}) AND rank <= {2 * k}"""


# --- roles --------------------------------------------------------------------------------------

cte("nodes", """SELECT doc_id AS node_id, source AS file_name, CAST(doc_id % 50 AS VARCHAR) AS page_label,
  CASE lang WHEN 'de' THEN 'table' WHEN 'fr' THEN 'image' WHEN 'es' THEN 'figure_caption' ELSE 'text' END AS content_type, text FROM documents""")
cte("queries", f"SELECT item_id AS query_id, {prefix('item_id')} || text AS query FROM benchmark")
cte("vectors", "SELECT vec_id AS node_id, embedding FROM embeddings")
cte("qvecs", "SELECT query_id, query, embedding FROM queries LEFT JOIN embeddings ON vec_id = query_id")
cte("uq", f"""SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS query_id, conv_id, turn,
  {prefix('conv_id + turn')} || text AS query FROM conversations WHERE role = 'user'""")
cte("odd", "SELECT query_id, 'pritner  PPU, ' || query AS query FROM uq")
cte("qlog", """SELECT CAST(user_id AS VARCHAR) || '_' || CAST(event_id AS VARCHAR) AS query_id, CAST(user_id AS VARCHAR) AS "user",
  'q' || CAST(k AS VARCHAR) AS query_text, 'a' || CAST(event_id AS VARCHAR) AS answer_text, event_type AS intent_type,
  (100 - k) / 100e0 AS intent_confidence, 'src' || CAST(k % 20 AS VARCHAR) AS sources, k / 100e0 AS confidence,
  CAST(floor(value * 10) AS BIGINT) AS response_time_ms,
  CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id, ts, CAST(ts AS DATE) AS dt
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)""")
cte("votes", """SELECT query_id, "user", intent_type = 'purchase' AS is_helpful, '' AS feedback_text, ts FROM qlog
  WHERE intent_type IN ('purchase', 'error')""")
cte("flat", """SELECT CAST(doc_id AS VARCHAR) AS id, '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00' AS "timestamp",
  CASE WHEN toxic = 0 THEN source END AS "user", 'about ' || lang || ' ' || CAST(doc_id % 50 AS VARCHAR) AS query, text AS answer,
  quality = 1 AS is_helpful, (doc_id % 100) / 100e0 AS confidence, 'intent' || CAST(doc_id % 5 AS VARCHAR) AS intent_type,
  source, lang, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS feedback_type, toxic FROM labels JOIN documents USING (doc_id)""")
cte("corrections", """SELECT 'n' || id AS id, replace("timestamp", '2024-01-', '2024-02-') AS "timestamp", query, answer, NOT is_helpful AS is_helpful
  FROM flat WHERE toxic = 1""")
cte("both_votes", 'SELECT id, "timestamp", query, answer, is_helpful FROM flat UNION ALL SELECT * FROM corrections')
cte("gloss_raw", rf"""SELECT doc_id AS entry_id, regexp_extract(text, '^\s*([^\s.,]+)', 1) AS term,
  regexp_replace(text, '^\s*[^\s.,]+', '') AS definition, ' ' || lang || ' | | ' || source || '|doc-' || CAST(doc_id AS VARCHAR) AS aliases FROM documents""")
cte("gloss", f"""SELECT entry_id, {strip('term')} AS term, {strip('definition')} AS definition,
  list_filter(list_transform(string_split(aliases, '|'), lambda a: {strip('a')}), lambda a: a <> '') AS aliases
  FROM gloss_raw WHERE {strip('term')} <> '' AND {strip('definition')} <> ''""")
cte("gloss_pages", r"""SELECT doc_id, regexp_replace(text, '(^|\n)(\S+) ', CASE WHEN doc_id % 2 = 0 THEN '\1\2: ' ELSE '\1\2 - ' END, 'g') AS text FROM documents""")
cte("cache", f"""SELECT key, max(doc_id) AS entry_id, 'answer ' || CAST(max(doc_id) AS VARCHAR) AS response
  FROM (SELECT md5({strip('lower(text)')} || ':10:0.5') AS key, doc_id FROM documents) GROUP BY 1""")
cte("again", """SELECT item_id AS query_id, '  ' || text AS query, CASE WHEN item_id % 4 = 3 THEN 5 ELSE 10 END AS top_k, 0.5e0 AS alpha FROM benchmark""")
cte("again_keyed", f"SELECT *, md5({strip('lower(query)')} || ':' || CAST(top_k AS VARCHAR) || ':0.5') AS key FROM again")
cte("raw_rows", r"""SELECT doc_id AS table_index, '/data/' || source || '.pdf' AS source_path, source || '.pdf' AS file_name, CAST(doc_id % 50 AS INTEGER) AS page_number,
  list_transform(string_split(text, chr(10)), lambda l: [regexp_extract(l, '\S+'), CAST(length(l) AS VARCHAR), CAST(len(regexp_extract_all(l, '\S+')) AS VARCHAR)]) AS body FROM documents""")
cte("norm_tables", """SELECT table_index, source_path, file_name, page_number, 'word|size|size_2' AS header, len(body) AS row_count, 3 AS column_count, body,
  '[' || array_to_string(list_transform(body, lambda r: '{"word":' || CAST(to_json(r[1]) AS VARCHAR) || ',"size":"' || r[2] || '","size_2":"' || r[3] || '"}'), ',') || ']' AS table_json,
  '| word | size | size_2 |' || chr(10) || '|---|---|---|' || chr(10) || array_to_string(list_transform(body, lambda r: '| ' || r[1] || ' | ' || r[2] || ' | ' || r[3] || ' |'), chr(10)) AS table_markdown
  FROM raw_rows""")
cte("caption_rows", f"""SELECT source_path, page_number, doc_id, line_number, {strip('line')} AS caption_text FROM (
  SELECT '/data/' || source || '.pdf' AS source_path, CAST(doc_id % 50 AS INTEGER) AS page_number, doc_id,
    unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents)
  WHERE contains(lower(line), 'license') AND length({strip('line')}) > 10""")
cte("image_rows", """SELECT url AS source_path, CAST(page_id % 50 AS INTEGER) AS page_number, page_id AS image_index, length(html) AS width,
  regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS caption FROM pages""")

# --- shared steps -------------------------------------------------------------------------------

index_ctes("ix", "nodes")
cte("gloss_nodes", "SELECT entry_id AS node_id, term || ' ' || definition AS text FROM gloss")
index_ctes("gx", "gloss_nodes")
cte("bm10", bm25("ix", "queries", 10))
cte("bm20", bm25("ix", "queries", 20))
cte("dn10", dense("qvecs", "vectors", 10))
cte("dn20", dense("qvecs", "vectors", 20))
cte("fused", fusion("dn20", "bm20"))
cte("ctx", "SELECT b.query_id, b.node_id, b.score, b.rank, n.file_name, n.page_label, n.content_type, n.text FROM bm10 b JOIN nodes n USING (node_id)")
cte("asked", f"SELECT query_id, query, {intent_case('query', 0)} AS intent_type, {intent_case('query', 1)} AS intent_confidence, {keywords('query')} AS keywords FROM queries")
cte("uq_intent", f"""SELECT *, intent_type IN ('comparison', 'reasoning') OR len(kw) > 5 AS requires_subqueries FROM (
  SELECT query_id, conv_id, turn, query, {intent_case('query', 0)} AS intent_type, {intent_case('query', 1)} AS intent_confidence, {keywords('query')} AS kw FROM uq)""")
def response_ctes(p: str, ctx: str) -> None:
    cte(f"{p}numbered", f"""SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY first_rank) AS source_no FROM (
      SELECT *, min(rank) OVER (PARTITION BY query_id, file_name) AS first_rank FROM {ctx})""")
    cte(f"{p}extracted", f"""SELECT q.query_id, coalesce(a.answer, 'The provided context does not include information to answer this query.') AS answer FROM queries q LEFT JOIN (
      SELECT query_id, string_agg('According to ' || file_name || ' [' || CAST(source_no AS VARCHAR) || ']:' || chr(10) || body, chr(10) || chr(10) ORDER BY source_no) AS answer FROM (
        SELECT query_id, file_name, source_no, string_agg({strip('text')}, ' ' ORDER BY rank) AS body FROM (
          SELECT * FROM {p}numbered) GROUP BY ALL)
      GROUP BY query_id) a USING (query_id)""")
    cte(f"{p}sources_", f"""SELECT query_id, source_no, '[' || CAST(source_no AS VARCHAR) || ']' AS id, file_name AS name,
      array_to_string(list_transform(list_sort(list(DISTINCT CAST(page_label AS INTEGER))), lambda x: CAST(x AS VARCHAR)), ', ') AS pages,
      arg_min(content_type, rank) AS content_type FROM {p}numbered GROUP BY query_id, source_no, file_name""")
    cte(f"{p}conf", f"""SELECT query_id, CASE WHEN files IS NULL THEN 0e0 ELSE round(least(0.5e0 * relevance + 0.3e0 * intent_confidence + 0.2e0 * least(files / 3e0, 1e0), 1e0), 6) END AS confidence
      FROM asked LEFT JOIN (SELECT query_id, avg(score) AS relevance, count(DISTINCT file_name) AS files FROM {ctx} GROUP BY 1) USING (query_id)""")
    cte(f"{p}reasons", f"""SELECT query_id, CASE WHEN n IS NULL THEN 'No relevant documents were retrieved for this query.' ELSE
      printf('Retrieved %d relevant document chunks using hybrid search (dense embeddings + BM25).', n) || ' ' ||
      printf('Query intent classified as: %s (confidence: %.2f%%).', intent_type, intent_confidence * 100) || ' ' ||
      printf('Prioritized %d sources based on reliability and recency.', n) || ' ' || printf('Average relevance score: %.3f', round(avg_, 3)) END AS reasoning
      FROM asked LEFT JOIN (SELECT query_id, count(*) AS n, avg(score) AS avg_ FROM {ctx} GROUP BY 1) USING (query_id)""")


response_ctes("", "ctx")
cte("answers", "SELECT a.*, e.answer, r.reasoning, c.confidence FROM asked a JOIN extracted e USING (query_id) JOIN reasons r USING (query_id) JOIN conf c USING (query_id)")

# --- sources and sinks --------------------------------------------------------------------------

oracle("scan_documents", "SELECT node_id AS doc_id, file_name, page_label, content_type, text FROM nodes")
oracle("glossary_csv", "SELECT term, definition, array_to_string(aliases, '|') AS aliases FROM gloss")
oracle("glossary_lines", f"""SELECT doc_id, line_ix, term, definition FROM (
  SELECT doc_id, line_ix, {strip("substr(line, 1, cut - 1)")} AS term, {strip("substr(line, cut + w)")} AS definition FROM (
    SELECT *, CASE WHEN contains(line, ':') THEN position(':' IN line) ELSE position(' - ' IN line) END AS cut, CASE WHEN contains(line, ':') THEN 1 ELSE 3 END AS w FROM (
      SELECT doc_id, line_ix - 1 AS line_ix, {strip('raw')} AS line FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_ix FROM gloss_pages))
    WHERE contains(line, ':') OR contains(line, ' - ')))
  WHERE length(term) > 1 AND length(definition) > 1""")
oracle("index_roundtrip", "SELECT * FROM bm10")
oracle("index_replace", "SELECT * FROM bm10")
oracle("index_overwrite", "SELECT term, df, round(idf, 6) AS idf FROM ix_idf")
oracle("index_compact", "SELECT term, df, round(idf, 6) AS idf FROM ix_idf")
oracle("index_append", "SELECT term, df, round(idf, 6) AS idf FROM ix_idf")
oracle("feedback_json", """SELECT id, "timestamp", "user", query, answer, is_helpful, confidence, intent_type, feedback_type, source || '|' || lang AS source_list FROM flat""")
oracle("feedback_export", """SELECT "timestamp", coalesce("user", '') AS "user", query, answer, CASE WHEN is_helpful THEN 'true' ELSE 'false' END AS is_helpful,
  CAST(confidence AS VARCHAR) AS confidence, intent_type, source || ', ' || lang AS sources FROM flat""")


def _report(parts: list[str]) -> str:
    return " || chr(10) || ".join(parts)


def _sec(rule: str, title: str, *body: str) -> list[str]:
    r = f"repeat('{rule}', 80)"
    return [r, f"'{title}'", r, *body, "''"]


oracle("report_text", f"""SELECT a.query_id,
  {_report(["repeat('=', 80)", "'QUERY REPORT'", "repeat('=', 80)", "'Generated: '", "''",
    *_sec("-", "QUERY:", "query"), *_sec("-", "ANSWER:", "answer"),
    *_sec("-", "METADATA:", "printf('Confidence: %.0f%%', confidence * 100)", "'Intent Type: ' || intent_type", "'Keywords: ' || array_to_string(keywords, ', ')"),
    *_sec("-", "SOURCES:", "s.long_"), *_sec("-", "REASONING:", "reasoning"),
    "repeat('=', 80)", "'End of Report'", "repeat('=', 80)"])} AS report,
  {_report([*_sec("=", "ANSWER:", "answer"), *_sec("=", "REASONING SUMMARY:", "reasoning"), *_sec("=", "SOURCE SUMMARY:", "s.short_"),
    "printf('Confidence: %.2f%% | Intent: %s', confidence * 100, intent_type)", "repeat('=', 80)"])} AS display
  FROM answers a JOIN (SELECT query_id, string_agg(id || ' ' || name || ' (Pages: ' || pages || ')', chr(10) ORDER BY source_no) AS long_,
    string_agg(id || ' ' || name || ' (pages: ' || pages || ')' || CASE WHEN content_type <> 'text' THEN ' [' || content_type || ']' ELSE '' END, chr(10) ORDER BY source_no) AS short_
    FROM sources_ GROUP BY 1) s USING (query_id)""")
oracle("report_tables", """SELECT query_id, 'source' AS part, id || '|' || name || '|' || pages || '|' || content_type AS value FROM sources_
  UNION ALL SELECT query_id, 'keyword', CAST(i - 1 AS VARCHAR) || '|' || keywords[i] FROM (SELECT query_id, keywords, unnest(range(1, len(keywords) + 1)) AS i FROM asked)
  UNION ALL SELECT query_id, 'summary', printf('%.0f%%', confidence * 100) || '|' || intent_type FROM answers""")
oracle("log_project", """SELECT "user" || '_' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS query_id, "user", query_text, answer_text, intent_type, intent_confidence, sources,
  confidence, response_time_ms, session_id, strftime(dt, '%Y-%m-%d') AS dt FROM qlog""")
oracle("feedback_project", """SELECT query_id, "user", is_helpful, feedback_text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM votes""")
_moved = """SELECT coalesce("user", 'Unknown') || '_' || "timestamp" AS query_id, coalesce("user", 'Unknown') AS "user", """
oracle("migrate_log", _moved + """query AS query_text, answer AS answer_text, intent_type, 0.8e0 AS intent_confidence, confidence,
  CAST(0 AS BIGINT) AS response_time_ms, 'migrated' AS session_id, "timestamp", source || '|' || lang AS source_list FROM flat""")
oracle("migrate_feedback", _moved + """is_helpful, '' AS feedback_text, "timestamp" FROM flat""")

_lost = 'toxic <> 0 AND NOT is_helpful'
oracle("migration_errors", f"SELECT id, query, is_helpful FROM flat WHERE {_lost}")
oracle("migration_counts", f"SELECT count(*) FILTER (WHERE NOT ({_lost})) AS migrated, count(*) FILTER (WHERE {_lost}) AS errors, count(*) AS with_stand_in FROM flat")

# --- corpus preparation -------------------------------------------------------------------------

oracle("table_normalise", "SELECT table_index, source_path, page_number, header, row_count, column_count, table_json, table_markdown FROM norm_tables")
oracle("captions", "SELECT * FROM caption_rows")
oracle("artefact_nodes", """
  SELECT 'table' AS content_type, file_name, CAST(page_number AS VARCHAR) AS page_label,
    'Table from ' || file_name || ', page ' || CAST(page_number AS VARCHAR) || ':' || chr(10) || table_markdown AS text,
    table_index, row_count, NULL AS line_number, NULL AS image_index, NULL AS width FROM norm_tables
  UNION ALL SELECT 'figure_caption', regexp_replace(source_path, '^.*/', ''), CAST(page_number AS VARCHAR), caption_text, NULL, NULL, line_number, NULL, NULL FROM caption_rows
  UNION ALL SELECT 'image', regexp_replace(source_path, '^.*/', ''), CAST(page_number AS VARCHAR),
    'Image from ' || regexp_replace(source_path, '^.*/', '') || ', page ' || CAST(page_number AS VARCHAR) || ': ' || caption, NULL, NULL, NULL, image_index, width FROM image_rows""")
oracle("chunk_window", f"""SELECT doc_id, source, i AS chunk_ix, array_to_string(w[i * 262 + 1 : i * 262 + 350], ' ') AS text,
  CAST(doc_id AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS node_id FROM (
  SELECT doc_id, source, w, unnest(range(CAST(greatest(ceil((len(w) - 88) / 262e0), 1) AS BIGINT))) AS i
  FROM (SELECT doc_id, source, {words('text')} AS w FROM documents) WHERE len(w) > 0)""")
cte("sentence_words", rf"""SELECT doc_id, source, list_filter(list_transform(string_split(replace(regexp_replace(text, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(10), chr(1)), chr(1)),
  lambda s: {words('s')}), lambda w: len(w) > 0) AS s FROM documents""")
cte("sentence_pieces", """SELECT doc_id, source, flatten(list_transform(s, lambda w: list_transform(range(CAST(ceil(len(w) / 350e0) AS BIGINT)), lambda k: w[k * 350 + 1 : k * 350 + 350]))) AS p
  FROM sentence_words WHERE len(s) > 0""")
cte("piece_sums", "SELECT *, list_transform(range(len(p) + 1), lambda i: CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: len(x))), 0) AS BIGINT)) AS sums FROM sentence_pieces")
oracle("chunk_sentences", """SELECT c.doc_id, s.source, ix AS chunk_ix, array_to_string(flatten(s.p[start + 1 : stop]), ' ') AS text, CAST(c.doc_id AS VARCHAR) || '-' || CAST(ix AS VARCHAR) AS node_id FROM (
  WITH RECURSIVE chunks(doc_id, ix, start, stop) AS (
    SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(len(list_filter(sums, lambda x: x <= 350)) - 1 AS BIGINT) FROM piece_sums
    UNION ALL SELECT doc_id, ix + 1, next_, CAST(len(list_filter(sums, lambda x: x <= sums[next_ + 1] + 350)) - 1 AS BIGINT) FROM (
      SELECT c.doc_id, c.ix, s.sums, CAST(len(list_filter(s.sums, lambda x: x < s.sums[c.stop + 1] - least(88, 350 - (s.sums[c.stop + 2] - s.sums[c.stop + 1])))) AS BIGINT) AS next_
      FROM chunks c JOIN piece_sums s USING (doc_id) WHERE c.stop < len(s.p)))
  SELECT * FROM chunks) c JOIN piece_sums s USING (doc_id)""")
oracle("ingest_summary", "SELECT file_name, content_type, count(*) AS n_nodes FROM nodes GROUP BY ALL")
_blocks = (
    ("heading", "text", r"(?is)<h[1-6](?:\s[^>]*)?>(.*?)</h[1-6]>"), ("paragraph", "text", r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"),
    ("list_item", "text", r"(?is)<li(?:\s[^>]*)?>(.*?)</li>"), ("link", "text", r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""),
    ("table", "table", r"(?is)<table(?:\s[^>]*)?>(.*?)</table>"), ("image", "image", r"""(?is)<img\s(?:[^>]*?\s)?alt\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""),
    ("caption", "figure_caption", r"(?is)<figcaption(?:\s[^>]*)?>(.*?)</figcaption>"),
)
_quoted = lambda x: x.replace("'", "''")
_seen = r"regexp_replace(html, '(?is)<!--.*?-->|<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>', '', 'g')"
_plain_value = "regexp_replace(body, '^[\"'']|[\"'']$', '', 'g')"
oracle("page_blocks", f"""SELECT page_id, kind, content_type, block_ix, {strip("regexp_replace(body, '(?s)<[^>]*>', '', 'g')")} AS text FROM (""" + " UNION ALL ".join(
    f"SELECT page_id, '{k}' AS kind, '{c}' AS content_type, {_plain_value if k in ('link', 'image') else 'body'} AS body, block_ix FROM ("
    f"SELECT page_id, unnest(m) AS body, generate_subscripts(m, 1) - 1 AS block_ix FROM (SELECT page_id, regexp_extract_all({_seen}, '{_quoted(x)}', 1) AS m FROM pages))"
    for k, c, x in _blocks) + f""") WHERE {strip("regexp_replace(body, '(?s)<[^>]*>', '', 'g')")} <> ''""")

# --- question understanding ---------------------------------------------------------------------

oracle("query_clean", f"SELECT query_id, {cleaned('query')} AS cleaned FROM odd")
oracle("query_acronyms", f"SELECT query_id, {expanded('query')} AS expanded FROM odd")
oracle("query_keywords", f"SELECT query_id, array_to_string({keywords('query')}, '|') AS keywords FROM uq")
cte("odd_intent", f"SELECT query_id, query, {intent_case('query', 0)} AS intent_type FROM odd")
oracle("query_variations", variations("odd_intent"))
oracle("query_intent", "SELECT query_id, intent_type, intent_confidence, array_to_string(kw, '|') AS keywords, requires_subqueries FROM uq_intent")
oracle("query_options", f"""SELECT query_id, CASE conv_id % 3 WHEN 0 THEN array_to_string({words('query')}, ' ') WHEN 1 THEN 'alpha:x ' || array_to_string({words('query')}, ' ') ELSE query END AS query_text,
  CASE conv_id % 3 WHEN 0 THEN 0.3e0 WHEN 1 THEN 1e0 ELSE 0.5e0 END AS alpha, CASE conv_id % 3 WHEN 0 THEN 15 WHEN 1 THEN 50 ELSE 10 END AS top_k FROM uq""")
oracle("search_mode", "SELECT query_id, confidence, CASE WHEN confidence < 0.3e0 THEN 'keyword' WHEN confidence > 0.7e0 THEN 'semantic' ELSE 'balanced' END AS mode FROM qlog")
cte("ghits", "SELECT h.query_id, h.node_id AS entry_id, h.rank, h.score, g.term, g.definition, g.aliases FROM (" + bm25("gx", "queries", 5) + ") h JOIN gloss g ON g.entry_id = h.node_id")
oracle("glossary_hits", "SELECT query_id, entry_id, rank, score, term FROM ghits")
oracle("query_augment", """SELECT query_id, CASE WHEN len(al) > 0 THEN query || ' (' || array_to_string(al, ' | ') || ')' ELSE query END AS augmented_query, glossary_definition
  FROM queries LEFT JOIN (
    SELECT query_id, (SELECT list(a ORDER BY p) FROM (SELECT a, min(p) AS p FROM (SELECT unnest(f) AS a, generate_subscripts(f, 1) AS p) GROUP BY a)) AS al, glossary_definition FROM (
      SELECT query_id, flatten(list(aliases ORDER BY rank)) AS f, arg_min(term || ': ' || definition, rank) AS glossary_definition FROM ghits WHERE rank <= 3 GROUP BY 1)) USING (query_id)""")
oracle("acronym_map", r"""SELECT lower(a) AS acronym, arg_max(term, entry_id) AS term FROM (SELECT entry_id, term, unnest(aliases) AS a FROM gloss)
  WHERE regexp_full_match(lower(a), '[\p{L}\p{N}]{2,10}') GROUP BY 1""")
oracle("intent_json", """SELECT query_id, CASE n WHEN 3 THEN intent_type WHEN 1 THEN 'lookup' ELSE 'reasoning' END AS intent_type,
  CASE n WHEN 3 THEN intent_confidence WHEN 2 THEN 0.85e0 ELSE (turn % 10) / 10e0 END AS intent_confidence,
  CASE n WHEN 3 THEN array_to_string(kw, '|') WHEN 2 THEN '' ELSE 'a|' || query_id END AS keywords,
  CASE n WHEN 3 THEN requires_subqueries ELSE false END AS requires_subqueries FROM (SELECT *, (conv_id + turn) % 4 AS n FROM uq_intent)""")
oracle("prompt_context", f"""SELECT query_id, upper(intent_type[1]) || intent_type[2:] || ' - ' || {mapping(INTENT_GUIDANCE, 'intent_type', DEFAULT_GUIDANCE)} AS guidance,
  coalesce(documents, '') AS documents FROM asked LEFT JOIN (
  SELECT query_id, string_agg('[' || CAST(rank AS VARCHAR) || '] ' || file_name || ' (Page ' || page_label || '):' || chr(10) || substr(text, 1, 800) || chr(10), chr(10) ORDER BY rank) AS documents
  FROM ctx WHERE rank <= 5 GROUP BY 1) USING (query_id)""")

# --- retrieval ----------------------------------------------------------------------------------

oracle("bm25_terms", "SELECT term, df, round(idf, 6) AS idf FROM ix_idf")
oracle("bm25_postings", "SELECT node_id, dl, term, tf FROM ix_post")
oracle("bm25_topk", "SELECT * FROM bm10")
oracle("dense_topk", "SELECT * FROM dn10")
oracle("dense_index", "SELECT * FROM dn10")


def cell(bits: int = 6, dim: int = 64, seed: int = 7) -> str:
    """The fixed planes as literals: which side of each a vector lies on."""
    sides = (", ".join(repr(float(x)) for x in plane) for plane in np.random.default_rng(seed).standard_normal((bits, dim)))
    return " + ".join(f"CASE WHEN list_inner_product(CAST(embedding AS DOUBLE[]), CAST([{s}] AS DOUBLE[])) > 0 THEN {1 << i} ELSE 0 END" for i, s in enumerate(sides))


cte("lsh_nodes", f"SELECT node_id, embedding, {cell()} AS cell FROM vectors")
cte("lsh_asked", f"SELECT query_id, embedding, {cell()} AS cell FROM qvecs")
oracle("dense_lsh", ranked("""SELECT q.query_id, v.node_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
  FROM lsh_asked q JOIN lsh_nodes v ON bit_count(xor(q.cell, v.cell)) <= 2 AND v.node_id <> q.query_id""", k=10))
oracle("score_norm", "SELECT query_id, node_id, rank, round(score / max(score) OVER (PARTITION BY query_id), 6) AS norm FROM bm10")
oracle("hybrid_fuse", f"SELECT query_id, node_id, round(dense, 6) AS dense, round(bm25, 6) AS bm25, score, rank FROM ({ranked('SELECT * FROM fused', 'query_id', 10)})")
cte("en_vectors", "SELECT node_id, embedding FROM vectors JOIN nodes USING (node_id) WHERE content_type = 'text'")
cte("en_post", "SELECT p.* FROM ix_post p JOIN nodes n USING (node_id) WHERE n.content_type = 'text'")
cte("en_dense", dense("qvecs", "en_vectors", 20))
cte("en_bm", bm25("ix", "queries", 20, post="en_post"))
oracle("hybrid_prefiltered", f"SELECT query_id, node_id, score, rank FROM ({ranked(fusion('en_dense', 'en_bm'), 'query_id', 10)})")
ORACLES["hybrid_filtered"] = ORACLES["hybrid_prefiltered"]
oracle("content_filter", "SELECT node_id, content_type FROM nodes WHERE content_type IN ('table', 'image', 'text')")


def coverage(q: str, t: str) -> str:
    return f"round(len(list_intersect(list_distinct({tokens(q)}), {tokens(t)})) / len(list_distinct({tokens(q)})), 6)"


oracle("rerank_overlap", ranked(f"SELECT c.query_id, c.node_id, c.score AS fused, CASE WHEN count(*) OVER (PARTITION BY c.query_id) > 1 THEN {coverage('q.query', 'c.text')} ELSE c.score END AS score FROM ctx c JOIN queries q USING (query_id)"))
oracle("llm_blend", ranked(f"""SELECT query_id, node_id, CASE WHEN rank <= 3 AND (node_id % 100) * 7 % 100 / 100e0 > 0.7e0
  THEN round(0.8e0 * score + 0.2e0 * ((node_id % 100) / 100e0), 6) ELSE score END AS score FROM (SELECT query_id, node_id, score, rank FROM ({ranked('SELECT * FROM fused', 'query_id', 10)}))"""))
cte("worded", variations("asked"))
cte("worded_hits", bm25("ix", "worded", 20, "query_id, variant_ix", "variant"))
oracle("hits_dedupe", ranked("SELECT query_id, node_id, max(score) AS score, min(variant_ix) AS variant_ix FROM worded_hits GROUP BY 1, 2"))
oracle("dynamic_window", f"SELECT query_id, node_id, score, rank FROM ({windowed('SELECT * FROM fused', 5)})")
oracle("fixed_topk", f"SELECT query_id, node_id, score, rank FROM ({ranked('SELECT * FROM fused', 'query_id', 5)})")
cte("worded_dense", "SELECT w.query_id, w.variant_ix, d.node_id, d.score FROM worded w JOIN dn20 d USING (query_id)")
cte("worded_both", fusion("worded_dense", "worded_hits", "query_id, variant_ix"))
cte("worded_fused", ranked("SELECT b.* FROM worded_both b JOIN nodes USING (node_id)", "query_id, variant_ix"))
cte("reranked", ranked(f"""SELECT f.query_id, f.variant_ix, f.node_id, CASE WHEN count(*) OVER (PARTITION BY f.query_id, f.variant_ix) > 1 THEN {coverage('w.variant', 'n.text')} ELSE f.score END AS score
  FROM worded_fused f JOIN nodes n USING (node_id) JOIN worded w USING (query_id, variant_ix) WHERE f.rank <= 20""", "query_id, variant_ix", 5))
cte("deduped", "SELECT query_id, node_id, max(score) AS score, min(variant_ix) AS variant_ix FROM reranked GROUP BY 1, 2")
cte("full_ctx", f"SELECT w.query_id, w.node_id, w.score, w.rank, n.file_name, n.page_label, n.content_type, n.text FROM ({windowed('SELECT * FROM deduped', 5)}) w JOIN nodes n USING (node_id)")
response_ctes("full_", "full_ctx")
cte("full_answers", "SELECT a.query_id, a.query, e.answer, r.reasoning, c.confidence FROM asked a JOIN full_extracted e USING (query_id) JOIN full_reasons r USING (query_id) JOIN full_conf c USING (query_id)")
oracle("answer_full", """SELECT a.*, coalesce(s.sources, '') AS sources FROM full_answers a LEFT JOIN (
  SELECT query_id, string_agg(id || ':' || name || ':' || CASE WHEN pages = '' THEN 'N/A' ELSE pages END || ':' || content_type, '|' ORDER BY source_no) AS sources FROM full_sources_ GROUP BY 1) s USING (query_id)""")
oracle("answer_context", f"SELECT w.query_id, w.node_id, w.score, w.rank, d.variant_ix, n.file_name FROM ({windowed('SELECT * FROM deduped', 5)}) w JOIN deduped d USING (query_id, node_id) JOIN nodes n USING (node_id)")

# --- context and response -----------------------------------------------------------------------

oracle("source_ids", "SELECT query_id, node_id, rank, file_name, source_no FROM numbered")
oracle("meta_priority", "SELECT node_id, content_type, CASE WHEN content_type = 'table' THEN 1.2e0 ELSE 1e0 END AS priority FROM nodes")
oracle("answer_extract", "SELECT * FROM extracted")
oracle("answer_short", """SELECT q.query_id, coalesce(a.answer, 'I couldn''t find relevant information to answer your query.') AS answer FROM queries q LEFT JOIN (
  SELECT query_id, string_agg('According to ' || file_name || ' [' || CAST(rank AS VARCHAR) || ']:' || chr(10) || substr(text, 1, 500) || '...', chr(10) || chr(10) ORDER BY rank) AS answer
  FROM ctx WHERE rank <= 3 GROUP BY 1) a USING (query_id)""")
oracle("source_summary", "SELECT query_id, id, name, pages, content_type FROM sources_")
oracle("confidence", "SELECT query_id, confidence FROM conf")
oracle("reasoning", "SELECT query_id, reasoning FROM reasons")
oracle("confidence_band", f"""SELECT query_id, intent_confidence, CASE WHEN intent_confidence >= 0.8e0 THEN 'high' WHEN intent_confidence >= 0.5e0 THEN 'medium' ELSE 'low' END AS band,
  {mapping(INTENT_LABELS, 'intent_type', DEFAULT_LABEL)} AS label FROM uq_intent""")
_part = "'According to ' || source || ' [' || {} || ']:' || chr(10) || text"
cte("cited", f"""SELECT doc_id, source, text, CAST(doc_id % 7 + 1 AS VARCHAR) AS n, doc_id % 5 = 0 AS far,
  CASE WHEN doc_id % 5 = 0 THEN 'Answer: ' || text || ' [9]' ELSE {_part.format("'1'")} || chr(10) || chr(10) || {_part.format("CAST(doc_id % 7 + 1 AS VARCHAR)")} END AS answer, 3 AS n_documents FROM documents""")
cte("checked", r"""SELECT *, len(list_filter(found, lambda c: TRY_CAST(c AS HUGEINT) BETWEEN 1 AND n_documents)) AS n_valid FROM (
  SELECT *, regexp_extract_all(answer, '\[([0-9]+)\]', 1) AS found FROM cited)""")
oracle("answer_segments", rf"""SELECT doc_id, i - 1 AS segment_ix, header, content, regexp_extract(header, '\[([0-9]+)\]', 1) AS citation_no FROM (
  SELECT doc_id, i, {strip('h[i]')} AS header, {strip('b[i + 1]')} AS content FROM (
    SELECT doc_id, h, b, unnest(range(1, len(h) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(answer, 'According to [^\[]+\[[0-9]+\]:') AS h, regexp_split_to_array(answer, 'According to [^\[]+\[[0-9]+\]:') AS b FROM cited)))
  WHERE content <> ''""")
oracle("citation_check", f"""SELECT doc_id, len(found) AS n_citations, n_valid, md5(CASE WHEN n_valid > 0 THEN answer ELSE answer || {quoted(NO_CITATION_NOTE)} END) AS answer_md5 FROM checked""")
oracle("answer_clean", f"""SELECT doc_id, md5({strip(f"regexp_replace({strip('answer')}, '^(Answer|Response):', '')")}) AS answer_md5 FROM cited""")
cte("verdicts", r"""SELECT doc_id, n, document, CASE n WHEN 0 THEN least((doc_id % 130) / 100e0, 1e0) WHEN 2 THEN 0.7e0 ELSE 0.5e0 END AS relevance_score,
  CASE n WHEN 0 THEN 0.9e0 WHEN 1 THEN 0.8e0 WHEN 2 THEN 0.3e0 ELSE 0.3e0 END AS confidence,
  CASE n WHEN 0 THEN 'direct' WHEN 1 THEN 'Unknown' WHEN 2 THEN 'Fallback parsing used' ELSE 'Fallback parsing used' END AS reasoning,
  CASE n WHEN 0 THEN [first_, 'certainly not in there', 'nor this'] WHEN 1 THEN [first_] ELSE [] END AS facts
  FROM (SELECT doc_id, text AS document, doc_id % 4 AS n, regexp_extract(text, '\S+') AS first_ FROM documents)""")
oracle("eval_parse", "SELECT doc_id, relevance_score, confidence, reasoning, array_to_string(facts, '|') AS key_facts FROM verdicts")
oracle("fact_validation", """SELECT doc_id, CASE WHEN ratio < 0.5e0 THEN round(confidence * 0.7e0, 6) ELSE confidence END AS confidence, round(ratio, 6) AS fact_validation_score,
  array_to_string(held, '|') AS validated_facts FROM (
  SELECT *, CASE WHEN len(facts) > 0 THEN len(held) / len(facts) ELSE 1e0 END AS ratio FROM (
    SELECT *, list_filter(facts, lambda f: contains(lower(document), lower(f))) AS held FROM verdicts))""")
cte("artefacts", r"""SELECT table_index AS artefact_id, 'table' AS kind, regexp_replace(file_name, '\.[^.]*$', '') AS stem, page_number, list_transform(body, lambda r: array_to_string(r, ',')) AS body FROM norm_tables
  UNION ALL SELECT image_index, 'image', CASE WHEN length(regexp_replace(source_path, '^.*/', '')) > 1 THEN regexp_replace(regexp_replace(source_path, '^.*/', ''), '(.)\.[^.]*$', '\1') ELSE regexp_replace(source_path, '^.*/', '') END, page_number, [caption] FROM image_rows""")
oracle("attach_artefacts", """SELECT query_id, source_no, kind, tier, artefact_id, array_to_string(body[1:3], '|') AS preview, greatest(len(body) - 3, 0) AS more_rows FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, kind, artefact_id ORDER BY source_no) AS nth FROM (
    SELECT *, min(tier) OVER (PARTITION BY query_id, source_no, kind) AS best FROM (
      SELECT s.query_id, s.source_no, a.kind, a.artefact_id, a.body, CASE WHEN a.stem = s.file_name THEN 1 ELSE 2 END AS tier
      FROM (SELECT query_id, source_no, file_name, arg_min(page_label, rank) AS page FROM numbered GROUP BY ALL) s JOIN artefacts a ON a.page_number = CAST(s.page AS INTEGER))) WHERE tier = best) WHERE nth = 1""")
oracle("snippets", "SELECT doc_id, " + ", ".join(f"CASE WHEN length(text) > {n} THEN substr(text, 1, {n}) || '...' ELSE text END AS s{n}" for n in (200, 50, 40)) + " FROM documents")

# --- re-use of answers --------------------------------------------------------------------------

oracle("cache_key", "SELECT query_id, top_k, alpha, key FROM again_keyed")
oracle("exact_reuse", "SELECT query_id, key, response FROM again_keyed LEFT JOIN cache USING (key)")
cte("near", "SELECT query_id, node_id AS entry_id, score FROM (" + dense("qvecs", "vectors", 1) + ") WHERE score >= 0.4e0")
oracle("semantic_reuse", "SELECT * FROM near")
oracle("cache_retain", "SELECT key, entry_id, response, entry_id AS inserted_at FROM cache ORDER BY entry_id DESC, key LIMIT 100")
oracle("cache_invalidate", "SELECT key, entry_id, response, entry_id AS inserted_at FROM cache WHERE entry_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")


def validated(log: str, votes: str) -> str:
    return f"""SELECT md5({strip('lower(query_text)')}) AS query_hash, arg_min(query_text, CASE WHEN is_helpful THEN (ts, query_id) END) AS query_text,
      arg_min(answer_text, CASE WHEN is_helpful THEN (ts, query_id) END) AS answer_text, arg_min(sources, CASE WHEN is_helpful THEN (ts, query_id) END) AS sources,
      count(*) FILTER (WHERE is_helpful) AS helpful_count, count(*) FILTER (WHERE NOT is_helpful) AS unhelpful_count,
      min(ts) FILTER (WHERE is_helpful) AS first_validated, max(ts) FILTER (WHERE is_helpful) AS last_used, true AS is_active
      FROM (SELECT l.query_id, l.query_text, l.answer_text, l.sources, v.is_helpful, v.ts FROM {log} l JOIN {votes} v USING (query_id)) GROUP BY 1 HAVING helpful_count > 0"""


cte("doc_log", "SELECT CAST(doc_id AS VARCHAR) AS query_id, text AS query_text, 'a' || CAST(doc_id AS VARCHAR) AS answer_text, [source, lang] AS sources FROM documents")
cte("doc_votes", "SELECT CAST(doc_id AS VARCHAR) AS query_id, quality = 1 AS is_helpful, doc_id AS ts FROM labels")
cte("approved", validated("doc_log", "doc_votes"))
oracle("validated_build", f"""SELECT query_hash, query_text, answer_text, sources, helpful_count, unhelpful_count, strftime(first_validated, '%Y-%m-%d %H:%M:%S') AS first_validated,
  strftime(last_used, '%Y-%m-%d %H:%M:%S') AS last_used, is_active FROM ({validated('qlog', 'votes')})""")
oracle("validated_reuse", f"""SELECT q.query_id, q.query_hash, a.answer_text, a.helpful_count, CASE WHEN a.query_hash IS NOT NULL THEN {VALIDATED_CONFIDENCE}e0 END AS confidence,
  '[1]:' || a.sources[1] || ':N/A:text|[2]:' || a.sources[2] || ':N/A:text' AS sources
  FROM (SELECT *, md5({strip('lower(query)')}) AS query_hash FROM again) q LEFT JOIN approved a USING (query_hash)""")
oracle("definition_path", f"""SELECT query_id, string_agg(term || ': ' || definition, chr(10) ORDER BY rank) AS answer, '[G]' AS source_id, 'Glossary' AS source_name,
  {GLOSSARY_CONFIDENCE}e0 AS confidence, '{GLOSSARY_REASONING}' AS reasoning FROM ghits JOIN asked USING (query_id) WHERE rank <= 3 AND intent_type = 'definition' GROUP BY query_id""")
cte("held_vectors", "SELECT node_id, embedding FROM vectors WHERE node_id IN (SELECT entry_id FROM cache)")
cte("near_held", "SELECT query_id, node_id AS entry_id, score FROM (" + dense("qvecs", "held_vectors", 1) + ") WHERE score >= 0.4e0")
cte("routed", f"""SELECT k.query_id, CASE WHEN k.key IN (SELECT key FROM cache) THEN 'exact' WHEN k.query_id IN (SELECT query_id FROM near_held) THEN 'semantic'
  WHEN md5({strip('lower(k.query)')}) IN (SELECT query_hash FROM approved) THEN 'validated' WHEN a.intent_type = 'definition' THEN 'glossary' ELSE 'retrieve' END AS route
  FROM again_keyed k JOIN asked a USING (query_id)""")
oracle("route", "SELECT query_id, route FROM routed")
oracle("served_batch", f"""SELECT r.query_id, r.route, CASE r.route WHEN 'exact' THEN c.response WHEN 'semantic' THEN s.response WHEN 'validated' THEN a.answer_text
    WHEN 'glossary' THEN g.answer ELSE x.answer END AS answer,
  CASE r.route WHEN 'validated' THEN {VALIDATED_CONFIDENCE}e0 WHEN 'glossary' THEN {GLOSSARY_CONFIDENCE}e0 WHEN 'retrieve' THEN x.confidence END AS confidence
  FROM routed r JOIN again_keyed k ON k.query_id = r.query_id LEFT JOIN cache c ON c.key = k.key LEFT JOIN near_held n ON n.query_id = r.query_id LEFT JOIN cache s ON s.entry_id = n.entry_id
  LEFT JOIN approved a ON a.query_hash = md5({strip('lower(k.query)')})
  LEFT JOIN (SELECT query_id, string_agg(term || ': ' || definition, chr(10) ORDER BY rank) AS answer FROM ghits WHERE rank <= 3 GROUP BY 1) g ON g.query_id = r.query_id
  LEFT JOIN full_answers x ON x.query_id = r.query_id""")
oracle("cache_stats", """SELECT hits, total - hits AS misses, total, round(hits / total, 6) AS hit_rate, (SELECT count(*) FROM cache) AS size FROM (
  SELECT count(*) FILTER (WHERE route IN ('exact', 'semantic')) AS hits, count(*) AS total FROM routed)""")
oracle("answer_keys", """SELECT query_id, rank, md5(query) || '_' || md5(text) AS key FROM ctx JOIN queries USING (query_id)
  UNION ALL SELECT query_id, 0, 'answer_' || md5(query) || '_' || md5(coalesce(h, '')) FROM queries LEFT JOIN (
    SELECT query_id, string_agg(md5(text), '' ORDER BY rank) AS h FROM ctx GROUP BY 1) USING (query_id)""")

# --- log and votes ------------------------------------------------------------------------------

_ts = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
oracle("user_history", f"""SELECT query_id, "user", {_ts}, nth FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, query_id) AS nth FROM qlog) WHERE nth <= 20""")
oracle("query_by_id", """SELECT query_id, "user", query_text, intent_type FROM qlog WHERE query_id IN (SELECT query_id FROM votes WHERE NOT is_helpful)""")
oracle("feedback_for", f"""SELECT query_id, "user", is_helpful, {_ts} FROM votes WHERE query_id IN (SELECT query_id FROM qlog WHERE confidence >= 0.5e0)""")
oracle("feedback_stats", "SELECT total, helpful, total - helpful AS unhelpful, coalesce(round(helpful / total * 100, 10), 0) AS helpful_percentage FROM (SELECT count(*) AS total, count(*) FILTER (WHERE is_helpful) AS helpful FROM votes)")
oracle("date_range", f"""SELECT query_id, "user", {_ts} FROM qlog WHERE dt BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'""")
_asof = "TIMESTAMP '2024-01-31'"
cte("dist30", f"""SELECT *, n = max(n) OVER () AND intent_type = max(CASE WHEN n = mx THEN intent_type END) OVER () AS is_top FROM (
  SELECT *, max(n) OVER () AS mx, n / sum(n) OVER () AS share FROM (SELECT intent_type, count(*) AS n FROM qlog WHERE ts BETWEEN {_asof} - INTERVAL 30 DAY AND {_asof} GROUP BY 1))""")
oracle("intent_dist", "SELECT intent_type, n, round(share, 10) AS share, is_top, share > 0.5 AS dominant FROM dist30")


def averages(days: int) -> str:
    mean = lambda c: f"round(coalesce(avg({c}), 0), 10) AS avg_{c}"
    return f"SELECT {mean('confidence')}, {mean('response_time_ms')}, {mean('intent_confidence')}, count(*) AS total_queries FROM qlog WHERE ts BETWEEN {_asof} - INTERVAL {days} DAY AND {_asof}"


oracle("avg_metrics", averages(7))
oracle("metrics_by_range", " UNION ALL ".join(
    f"SELECT {d} AS days, intent_type, count(*) AS total_queries, round(avg(confidence), 10) AS avg_confidence, round(avg(response_time_ms), 10) AS avg_response_time_ms, "
    f"round(avg(intent_confidence), 10) AS avg_intent_confidence FROM qlog WHERE ts BETWEEN {_asof} - INTERVAL {d} DAY AND {_asof} GROUP BY intent_type" for d in (7, 30, 90)))
oracle("health", f"""SELECT total, round(rate, 10) AS helpful_rate, total_queries, CASE WHEN avg_response_time_ms < 1000 THEN 'excellent' WHEN avg_response_time_ms < 2000 THEN 'good' ELSE 'slow' END AS speed,
  CASE WHEN avg_confidence > 0.8 THEN 'high' WHEN avg_confidence > 0.6 THEN 'good' ELSE 'low' END AS quality,
  CASE WHEN len(advice) > 0 THEN array_to_string(advice, '|') WHEN total_queries < 5 THEN 'not enough data' ELSE 'no issues' END AS recommendations FROM (
  SELECT *, list_filter([CASE WHEN total >= 5 AND rate < 0.5 THEN 'low helpful rate' END, CASE WHEN total >= 5 AND rate > 0.8 THEN 'high helpful rate' END,
    CASE WHEN avg_response_time_ms > 2000 THEN 'slow response times' END, CASE WHEN avg_confidence < 0.7 AND total_queries >= 10 THEN 'low confidence scores' END,
    CASE WHEN share > 0.5 THEN 'most queries are ' || intent_type END], lambda a: a IS NOT NULL) AS advice
  FROM (SELECT count(*) AS total, coalesce(count(*) FILTER (WHERE is_helpful) / count(*), 0) AS rate FROM votes), ({averages(30)}), (SELECT intent_type, share FROM dist30 WHERE is_top))""")
oracle("feedback_insights", "SELECT intent_type, count(*) AS n, round(avg(confidence) FILTER (WHERE is_helpful), 10) AS avg_helpful_confidence FROM flat GROUP BY 1")
oracle("helpful_rows", 'SELECT id, "timestamp", query FROM flat WHERE is_helpful')
cte("last_votes", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, answer ORDER BY "timestamp" DESC, id DESC) AS nth FROM both_votes) WHERE nth = 1""")
oracle("feedback_upsert", 'SELECT id, "timestamp", query, md5(answer) AS answer_md5, is_helpful FROM last_votes')
ORACLES["feedback_merge"] = ORACLES["feedback_upsert"]
ORACLES["stream_health"] = ORACLES["health"]
oracle("rating_lookup", "SELECT f.id AS pair_id, v.is_helpful AS rating FROM flat f LEFT JOIN last_votes v ON v.query = f.query AND v.answer = f.answer")
oracle("feedback_delete", "SELECT id, query, is_helpful FROM flat WHERE toxic = 0")
oracle("session_stats", f"""SELECT session_id, min("user") AS "user", count(*) AS n_queries, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended,
  CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS BIGINT) AS duration_s, (epoch_us({_asof}) - epoch_us(min(ts))) / 1e6 > 86400 AS expired FROM qlog GROUP BY 1""")
oracle("session_gaps", """SELECT "user", session_no, count(*) AS n_queries, CAST(floor((max(t) - min(t)) / 1e6) AS BIGINT) AS duration_s FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY "user" ORDER BY t, query_id) AS session_no FROM (
    SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY "user" ORDER BY t, query_id) < 86400000000 THEN 0 ELSE 1 END AS fresh FROM (SELECT *, epoch_us(ts) AS t FROM qlog))) GROUP BY 1, 2""")
oracle("recent_history", """SELECT "user", query_id, query_text, nth FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, query_id DESC) AS nth FROM (
  SELECT *, lag(query_text) OVER (PARTITION BY "user" ORDER BY ts, query_id) AS prev FROM qlog) WHERE prev IS NULL OR prev <> query_text) WHERE nth <= 50""")
oracle("latest_ratings", f"""SELECT sources AS source, intent_type AS segment, arg_max(confidence >= 0.5e0, ts) AS rating, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts FROM qlog GROUP BY 1, 2""")
oracle("decimal_cast", """SELECT query_id, CAST(CAST(response_time_ms / 4e0 AS DECIMAL(10, 6)) AS VARCHAR) AS stored,
  CASE WHEN response_time_ms % 4 = 0 THEN CAST(response_time_ms // 4 AS VARCHAR) ELSE CAST(response_time_ms / 4e0 AS VARCHAR) END AS plain FROM qlog""")

# --- quality ------------------------------------------------------------------------------------

oracle("precision_at_k", """SELECT query_id, count(*) FILTER (WHERE a.label = b.label) AS n_relevant, round(count(*) FILTER (WHERE a.label = b.label) / 10e0, 6) AS precision
  FROM dn10 JOIN embeddings a ON a.vec_id = node_id JOIN embeddings b ON b.vec_id = query_id GROUP BY 1""")
oracle("intent_accuracy", """SELECT expected, predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY expected), 6) AS share FROM (
  SELECT ['definition', 'reasoning', 'troubleshooting', 'comparison', 'lookup', 'lookup'][(conv_id + turn) % 6 + 1] AS expected, intent_type AS predicted FROM uq_intent) GROUP BY 1, 2""")
oracle("grounding_rate", "SELECT count(*) AS n_answers, round(avg(CASE WHEN len(found) > 0 AND len(found) = n_valid THEN 1 ELSE 0 END), 6) AS grounded_share FROM checked")

# --- streams ------------------------------------------------------------------------------------

oracle("stream_log", """SELECT query_id, "user", intent_type, response_time_ms, strftime(dt, '%Y-%m-%d') AS dt FROM qlog""")
_measures = "count(*) AS n, round(avg(confidence), 10) AS avg_confidence, round(avg(response_time_ms), 10) AS avg_response_time_ms"
oracle("stream_daily", f"SELECT strftime(dt, '%Y-%m-%d %H:%M:%S') AS start, intent_type, {_measures} FROM qlog GROUP BY dt, intent_type")
oracle("stream_sliding", f"""SELECT strftime(day, '%Y-%m-%d %H:%M:%S') AS start, intent_type, {_measures} FROM (
  SELECT *, unnest([dt - CAST(i AS INTEGER) for i in range(7)]) AS day FROM qlog) GROUP BY day, intent_type""")
oracle("stream_sessions", """SELECT "user", strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n_queries FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY "user" ORDER BY ts, query_id) AS session_no FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY "user" ORDER BY ts, query_id) < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS fresh FROM qlog)) GROUP BY "user", session_no""")
ORACLES["stream_validated"] = ORACLES["validated_build"]
ORACLES["stream_index"] = ORACLES["index_append"]
