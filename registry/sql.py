"""The same queries as SQL over the given tables."""

from __future__ import annotations


def _uuid(digest: str) -> str:
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return " || '-' || ".join(f"substr({digest}, {start}, {size})" for start, size in cuts)


EVENT_WRITES = f"""
writes AS (
  SELECT *, {_uuid("content_hash")} AS id
  FROM (
    SELECT event_id, ts, event_type AS type, replace(props, ': ', ':') AS content, 'app' AS source,
           'user:' || user_id AS tag, value / 500 AS confidence,
           sha256(event_type || '::app::' || replace(props, ': ', ':')) AS content_hash
    FROM events)
)"""

EVENT_RECORDS = f"""{EVENT_WRITES},
memories AS (
  SELECT content_hash, min(id) AS id, min(type) AS type, min(content) AS content, min(source) AS source,
         list_sort(list(DISTINCT tag)) AS tag_list, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags,
         max(confidence) AS confidence, min(ts) AS created_at, max(ts) AS updated_at
  FROM writes GROUP BY content_hash
)"""

RANK = "row_number() OVER (ORDER BY created_at DESC, id) AS rank"
LIST_ROW = "id, type, tags, confidence, created_at, updated_at"
RECORD = "content_hash, id, type, content, source, tags, confidence, created_at, updated_at"

DOCUMENT_REQUESTS = """
requests AS (
  SELECT doc_id, lang, source, '{"text":' || to_json(text) || '}' AS content,
         CASE WHEN quality = 1 THEN 0.9 WHEN quality = 0 THEN 0.4 ELSE 0.5 END::DOUBLE AS confidence,
         CASE
           WHEN n_chars BETWEEN 20 AND 39 THEN 'Failed to parse JSON'
           WHEN n_chars < 20 THEN 'type is required and must be a non-empty string'
           WHEN quality = 0 AND toxic = 1 THEN 'source is required and must be a non-empty string'
           WHEN quality = 1 AND toxic = 1 THEN 'confidence is required and must be a number between 0 and 1'
           WHEN length('{"text":' || to_json(text) || '}') > 10000 THEN 'content is too large (max 10000 characters)'
           WHEN contains(text, '"') THEN 'invalid tag: "' || source || ' ' || lang || '"'
         END AS error
  FROM documents LEFT JOIN labels USING (doc_id)
),
checked AS (
  SELECT doc_id, error, lang AS type, source, confidence, content,
         sha256(lang || '::' || source || '::' || content) AS content_hash,
         lang || ',' || source AS tags
  FROM requests
)"""

CENTROID = """
means AS (
  SELECT pos, avg(x::DOUBLE) AS x
  FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  GROUP BY pos
),
centroid AS (
  SELECT list(x / norm ORDER BY pos) AS v FROM means, (SELECT sqrt(sum(x * x)) AS norm FROM means)
)"""

SCORE = "floor((1 + list_inner_product({}::DOUBLE[], {}::DOUBLE[])) * 1000000 + 0.5) / 1000000"
TYPED = """
typed AS (
  SELECT vec_id AS id, embedding, label, lang AS type, lang || ',' || d.source AS tags, d.source AS source
  FROM embeddings JOIN documents d ON vec_id = doc_id
)"""

FILTERED_HITS = f"""{TYPED},
queries AS (
  SELECT id AS query_id, embedding, type, CASE WHEN label < 5 THEN source END AS tag, label + 1 AS limit_rows FROM typed
),
hits AS (
  SELECT * FROM (
    SELECT query_id, limit_rows, m.id, m.type, m.tags, {SCORE.format("m.embedding", "q.embedding")} AS similarity,
           row_number() OVER (
             PARTITION BY query_id ORDER BY {SCORE.format("m.embedding", "q.embedding")} DESC, m.id) AS rank
    FROM queries q JOIN typed m ON m.type = q.type AND (q.tag IS NULL OR q.tag IN (m.type, m.source))
  ) WHERE rank <= limit_rows
)"""

SELF_SEARCH = f"""
SELECT query_id, rank, id, similarity FROM (
  SELECT q.vec_id AS query_id, q.label + 1 AS limit_rows, m.vec_id AS id,
         {SCORE.format("m.embedding", "q.embedding")} AS similarity,
         row_number() OVER (
           PARTITION BY q.vec_id ORDER BY {SCORE.format("m.embedding", "q.embedding")} DESC, m.vec_id) AS rank
  FROM embeddings q CROSS JOIN embeddings m
) WHERE rank <= limit_rows"""

TOPK = f"""
WITH {CENTROID}
SELECT vec_id AS id, {SCORE.format("embedding", "v")} AS similarity
FROM embeddings, centroid ORDER BY 2 DESC, 1 LIMIT 10"""



def _vectors(name: str, texts: str) -> str:
    """Entries (key, place, x) of the vector of each text: signed words by their MD5, mean, unit length."""
    return f"""
{name}_words AS (
  SELECT key, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS word
  FROM ({texts})),
{name}_hashed AS (SELECT key, ('0x' || substr(md5(word), 1, 16))::UBIGINT AS h FROM {name}_words),
{name}_sums AS (
  SELECT key, (h % 64)::INTEGER AS place, sum(CASE WHEN h >= 9223372036854775808 THEN -1.0 ELSE 1.0 END::DOUBLE) AS s
  FROM {name}_hashed GROUP BY key, place),
{name}_means AS (
  SELECT key, place, s / n AS m FROM {name}_sums JOIN (SELECT key, count(*) AS n FROM {name}_hashed GROUP BY key) USING (key)),
{name} AS (
  SELECT key, place, (m / CASE WHEN norm > 0 THEN norm ELSE 1 END)::FLOAT AS x
  FROM {name}_means JOIN (SELECT key, sqrt(sum(m * m)) AS norm FROM {name}_means GROUP BY key) USING (key))"""


def _number(x: str) -> str:
    """A number as JavaScript prints it: no trailing ``.0``, and an exponent only below 1e-6."""
    text = f"({x})::VARCHAR"
    digits = f"replace(split_part({text}, 'e', 1), '.', '')"
    zeros = f"repeat('0', split_part({text}, 'e-', 2)::INTEGER - 1)"
    short = f"regexp_replace(regexp_replace({text}, '\\.0$', ''), 'e-0', 'e-')"
    return f"CASE WHEN ({x}) >= 1e-6 AND contains({text}, 'e-') THEN '0.' || {zeros} || {digits} ELSE {short} END"


LONG_TIME = "strftime({}, '%a %b %d %Y %H:%M:%S GMT+0000 (Coordinated Universal Time)')"
JSON_TAGS = """'["' || array_to_string(tag_list, '","') || '"]'"""

UPSERT_FOLD = f"WITH {EVENT_RECORDS} SELECT {RECORD} FROM memories"

BROWSE_MANY = f"""
WITH {EVENT_RECORDS},
newest AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS place FROM memories),
asked AS (
  SELECT event_id, event_type, 'user:' || user_id AS tag, greatest(1, floor(value)::BIGINT % 7) AS limit_rows
  FROM events WHERE event_type IN ('click', 'error', 'view')),
per_tag AS (
  SELECT tag, place FROM (SELECT unnest(tag_list) AS tag, place FROM newest)),
pairs AS (
  SELECT event_id, limit_rows, place FROM asked JOIN newest ON event_type = 'view' AND place <= limit_rows
  UNION
  SELECT event_id, limit_rows, place FROM asked JOIN (
    SELECT place, type, row_number() OVER (PARTITION BY type ORDER BY place) AS n FROM newest
  ) t ON event_type = 'click' AND type = 'click' AND n <= limit_rows
  UNION
  SELECT event_id, limit_rows, place FROM asked JOIN (
    SELECT tag, place, row_number() OVER (PARTITION BY tag ORDER BY place) AS n FROM per_tag
  ) t ON event_type = 'error' AND (t.tag = asked.tag OR t.tag = 'user:7') AND n <= limit_rows),
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY place) AS rank FROM pairs)
SELECT event_id AS request_id, rank, id, created_at FROM ranked JOIN newest USING (place) WHERE rank <= limit_rows"""

LISTS_MANY = f"""
WITH {EVENT_RECORDS},
newest AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS place FROM memories),
asked AS (
  SELECT user_id AS query_id, user_id % 20 AS kind, 'user:' || user_id AS own, 'user:' || (user_id + 1) AS next_one
  FROM (SELECT DISTINCT user_id FROM events)),
hits AS (
  SELECT query_id, id, type, created_at, tag_list, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank,
         count(*) OVER (PARTITION BY query_id) AS n
  FROM asked JOIN newest ON CASE
    WHEN kind < 8 THEN list_has_any(tag_list, [own, next_one])
    WHEN kind < 16 THEN type = 'click' AND list_contains(tag_list, own)
    WHEN kind = 16 THEN type = 'view' ELSE kind = 17 END)"""

CREATED = f"""
WITH {DOCUMENT_REQUESTS}
SELECT content_hash, {_uuid("content_hash")} AS id, type, source,
       array_to_string(list_sort([type, source]), ',') AS tags, max(confidence) AS confidence, 64 AS width
FROM checked WHERE error IS NULL GROUP BY content_hash, type, source"""

ORACLE = {
    "validate_creates": f"""
WITH {DOCUMENT_REQUESTS}
SELECT doc_id, error,
       CASE WHEN error IS NULL THEN type END AS type,
       CASE WHEN error IS NULL THEN content_hash END AS content_hash,
       CASE WHEN error IS NULL THEN source END AS source,
       CASE WHEN error IS NULL THEN tags END AS tags,
       CASE WHEN error IS NULL THEN confidence END AS confidence
FROM checked""",
    "rejects_by_error": f"""
WITH {DOCUMENT_REQUESTS}
SELECT error, count(*) AS n FROM checked WHERE error IS NOT NULL GROUP BY error""",
    "validate_searches": """
SELECT doc_id, error,
       CASE WHEN error IS NULL THEN sha256(text) END AS query_key,
       CASE WHEN error IS NULL AND source <> 'src0' THEN lang END AS type,
       CASE WHEN error IS NULL THEN source || ',' || source END AS tags,
       CASE WHEN error IS NULL THEN limit_rows END AS limit_rows
FROM (
  SELECT *,
    CASE lang WHEN 'en' THEN least(n_chars, 100) WHEN 'de' THEN least(n_chars / 4.0, 100)::INTEGER WHEN 'fr' THEN 10 END::INTEGER AS limit_rows,
    CASE
      WHEN n_chars > 1000 THEN 'query length cannot exceed 1000 characters'
      WHEN lang = 'es' THEN 'limit must be a positive number'
      WHEN lang = 'de' AND n_chars < 400 AND n_chars % 4 <> 0 THEN 'limit must be a whole number'
    END AS error
  FROM documents)""",
    "validate_lists": """
SELECT doc_id, error, CASE WHEN error IS NULL AND lang = 'en' THEN 'en' END AS type,
       CASE WHEN error IS NULL AND source <> 'src1' THEN
         CASE source WHEN 'src3' THEN 'src3,null,3' ELSE source END END AS tags
FROM (
  SELECT *, CASE
    WHEN lang IN ('de', 'es') THEN 'type must be a non-empty string'
    WHEN source = 'src2' THEN 'tags must be an array'
    WHEN source = 'src4' THEN 'invalid tag: "Src 4"' END AS error
  FROM documents)""",
    "content_hash": "SELECT event_id, sha256(event_type || '::app::' || replace(props, ': ', ':')) AS content_hash FROM events",
    "canonical_pages": """
SELECT page_id, sha256('{"html":' || to_json(html) || ',"url":' || to_json(url) || '}') AS text_key FROM pages""",
    "canonical_numbers": f"""
SELECT o_orderkey, '{{"key":' || (o_orderkey * 1000)::VARCHAR || ',"price":' || {_number("o_totalprice")}
       || ',"tiny":' || {_number("o_totalprice / 1e12")} || '}}' AS text
FROM orders""",
    "lexemes": r"""
WITH words AS (
  SELECT doc_id, list_filter(
    regexp_split_to_array(lower('{"text":' || to_json(text) || '} ' || source), '[^\p{L}\p{N}]+'),
    lambda w: w <> '') AS w
  FROM documents)
SELECT doc_id, lexeme, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions
FROM (SELECT doc_id, unnest(w) AS lexeme, generate_subscripts(w, 1) AS position FROM words)
GROUP BY doc_id, lexeme""",
    "lexemes_stored": rf"""
WITH {DOCUMENT_REQUESTS},
words AS (
  SELECT {_uuid("content_hash")} AS id, list_filter(
    regexp_split_to_array(lower(min(content) || ' ' || source), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w
  FROM checked WHERE error IS NULL GROUP BY content_hash, source)
SELECT id, lexeme, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions
FROM (SELECT id, unnest(w) AS lexeme, generate_subscripts(w, 1) AS position FROM words)
GROUP BY id, lexeme""",
    "embed_key": "SELECT doc_id, sha256(text) || '::model' AS embed_key FROM documents",
    "embed_distinct": "SELECT sha256(text) || '::model' AS embed_key, count(*) AS n FROM documents GROUP BY text",
    "embed_once": f"""
WITH {_vectors("entries", "SELECT doc_id AS key, text FROM documents")}
SELECT doc_id, NULL::VARCHAR AS embed_error, 64 AS width, round(coalesce(length, 0), 3) AS length,
       round(coalesce(moment, 0), 3) + 0 AS moment
FROM documents LEFT JOIN (
  SELECT key, sqrt(sum(x::DOUBLE * x)) AS length, sum((place + 1) * x::DOUBLE) AS moment FROM entries GROUP BY key
) ON key = doc_id""",
    "embed_cls_raw": r"""
SELECT doc_id, (h % 64)::INTEGER AS place, CASE WHEN h >= 9223372036854775808 THEN -1.0 ELSE 1.0 END::DOUBLE AS x
FROM (
  SELECT doc_id, ('0x' || substr(md5(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')[1]), 1, 16))::UBIGINT AS h
  FROM documents)
WHERE h IS NOT NULL""",
    "mean_pool_normalize": """
WITH means AS (
  SELECT label, pos, avg(x::DOUBLE) AS x
  FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  GROUP BY label, pos)
SELECT label, (pos - 1)::INTEGER AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) + 0 AS x FROM means""",
    "dimension_check": "SELECT vec_id, len(embedding) = 64 AS ok FROM embeddings",
    "upsert_fold": UPSERT_FOLD,
    "upsert_incremental": UPSERT_FOLD,
    "compact_buckets": f"""
WITH {EVENT_RECORDS},
late AS (SELECT DISTINCT content_hash FROM writes, (SELECT value, event_id FROM events) e
         WHERE writes.event_id = e.event_id AND NOT coalesce(value < 50, false)),
folded AS (SELECT DISTINCT left(content_hash, 1) AS bucket FROM late WHERE left(content_hash, 1) < '8')
SELECT {RECORD}, left(content_hash, 1) IN (SELECT bucket FROM folded) AS rewritten FROM memories""",
    "known_hashes": f"""
WITH {EVENT_WRITES}
SELECT content_hash, bool_or(confidence < 50 / 500.0) AS stored FROM writes GROUP BY content_hash""",
    "upsert_returning": f"""
WITH {EVENT_RECORDS}
SELECT id, type, content, source, tags, confidence, created_at, updated_at FROM memories WHERE type = 'purchase'""",
    "upsert_items": f"""
WITH {EVENT_RECORDS} SELECT id, type, tags, confidence, created_at AS "createdAt" FROM memories""",
    "upsert_text": f"""
WITH {EVENT_RECORDS}
SELECT id, 'Memory upserted.' || chr(10) || 'ID: ' || id || chr(10) || 'Type: ' || type || chr(10)
       || 'Tags: ' || {JSON_TAGS} || chr(10) || 'Confidence: ' || {_number("confidence")} || chr(10)
       || 'Created: ' || {LONG_TIME.format("created_at")} AS text
FROM memories""",
    "append_plain": f"""
WITH {EVENT_RECORDS}
SELECT content_hash, id, type, tags, confidence FROM memories
UNION ALL
SELECT NULL, {_uuid("h")}, role, 'conv:' || conv_id, 1.0::DOUBLE
FROM (SELECT *, sha256(role || '::chat::{{"role":' || to_json(role) || ',"text":' || to_json(text) || '}}') AS h
      FROM conversations)""",
    "duplicate_hashes": f"""
WITH {EVENT_WRITES} SELECT content_hash, count(*) AS n FROM writes GROUP BY content_hash HAVING count(*) > 1""",
    "filter_type": f"WITH {EVENT_RECORDS} SELECT id, type, tags FROM memories WHERE type = 'click'",
    "filter_tags_any": f"""
WITH {EVENT_RECORDS} SELECT id, type, tags FROM memories
WHERE list_has_any(tag_list, ['user:7', 'user:11', 'user:none'])""",
    "filter_tags_lookup": f"""
WITH {EVENT_RECORDS} SELECT id, type, tags FROM memories
WHERE list_has_any(tag_list, ['user:7', 'user:11', 'user:none'])""",
    "filter_both": f"""
WITH {EVENT_RECORDS} SELECT id, type, tags FROM memories
WHERE type = 'view' AND list_has_any(tag_list, ['user:7', 'user:11'])""",
    "get_by_ids": f"""
WITH {EVENT_RECORDS},
requests AS (
  SELECT 'e' || event_id AS request_id, upper(id) AS asked FROM writes
  UNION ALL SELECT 't' || doc_id, {_uuid("sha256(text)")} FROM documents
  UNION ALL SELECT 's' || doc_id, source FROM documents)
SELECT request_id, id, type, content, source, tags, confidence, created_at, updated_at,
       CASE WHEN request_id LIKE 's%' THEN 'id must be a valid UUID format'
            WHEN id IS NULL THEN 'Memory not found: ' || asked END AS error
FROM requests LEFT JOIN memories ON id = lower(asked)""",
    "list_newest": f"WITH {EVENT_RECORDS} SELECT {LIST_ROW} FROM memories",
    "list_filtered": f"""
WITH {EVENT_RECORDS} SELECT id, type, tags, created_at AS "createdAt" FROM memories
WHERE type = 'view' AND list_has_any(tag_list, ['user:7', 'user:11'])""",
    "recent_n": f"""
WITH {EVENT_RECORDS} SELECT {LIST_ROW}, {RANK} FROM memories ORDER BY created_at DESC, id LIMIT 25""",
    "recent_by_tags": f"""
WITH {EVENT_RECORDS} SELECT {LIST_ROW}, {RANK} FROM memories
WHERE list_has_any(tag_list, ['user:7', 'user:11', 'USER:1']) ORDER BY created_at DESC, id LIMIT 20""",
    "recent_by_type": f"""
WITH {EVENT_RECORDS} SELECT {LIST_ROW}, {RANK} FROM memories
WHERE type = 'error' ORDER BY created_at DESC, id LIMIT 100""",
    "browse_many": BROWSE_MANY,
    "browse_lists": BROWSE_MANY,
    "items_by_address": f"""
WITH {EVENT_RECORDS},
requests AS (
  SELECT 'e' || event_id AS request_id, id AS asked FROM writes
  UNION ALL SELECT 't' || doc_id, {_uuid("sha256(text)")} FROM documents)
SELECT request_id, id, type, content, source, tags, confidence, created_at, updated_at
FROM requests LEFT JOIN memories ON id = asked""",
    "parse_addresses": """
SELECT page_id, CASE WHEN contains(url, '?') THEN 'by-type' ELSE 'by-tags' END AS view,
       CASE WHEN contains(url, '?') THEN url ELSE 'a+b,' || url END AS argument,
       CASE WHEN contains(url, '?') THEN 100 ELSE 20 END AS limit_rows, NULL::VARCHAR AS error
FROM pages""",
    "search_topk": TOPK,
    "search_topk_arrow": TOPK,
    "search_filtered_topk": f"""
WITH {CENTROID}, {TYPED}
SELECT id, type, tags, {SCORE.format("embedding", "v")} AS similarity FROM typed, centroid
WHERE type = 'en' AND source IN ('src1', 'src2', 'src3') ORDER BY similarity DESC, id LIMIT 20""",
    "search_batch": SELF_SEARCH,
    "search_batch_passes": SELF_SEARCH,
    "search_batch_filtered": f"WITH {FILTERED_HITS} SELECT query_id, rank, id, type, similarity FROM hits",
    "search_grouped": SELF_SEARCH,
    "search_grouped_filtered": f"WITH {FILTERED_HITS} SELECT query_id, rank, id, type, similarity FROM hits",
    "search_by_label_mean": f"""
WITH means AS (
  SELECT label, pos, avg(x::DOUBLE) AS x
  FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  GROUP BY label, pos),
units AS (SELECT label, pos, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM means),
queries AS (SELECT label, list(x ORDER BY pos) AS v FROM units GROUP BY label)
SELECT query_id, rank, id, similarity FROM (
  SELECT q.label AS query_id, vec_id AS id, {SCORE.format("embedding", "v")} AS similarity,
         row_number() OVER (PARTITION BY q.label ORDER BY {SCORE.format("embedding", "v")} DESC, vec_id) AS rank
  FROM queries q CROSS JOIN embeddings
) WHERE rank <= 15""",
    "search_items": f"""
WITH {CENTROID}, {TYPED}
SELECT id, type, tags, {SCORE.format("embedding", "v")} AS similarity, TIMESTAMP '2024-01-01' AS "createdAt"
FROM typed, centroid WHERE type = 'en' ORDER BY similarity DESC, id LIMIT 50""",
    "digest": f"""
WITH {FILTERED_HITS},
texts AS (
  SELECT query_id, 'Found ' || count(*) || ' memories:' || chr(10) || string_agg(
    '• [' || type || '] sim=' || printf('%.3f', similarity) || ' tags=' || replace(tags, ',', ', '),
    chr(10) ORDER BY rank) AS text
  FROM hits WHERE limit_rows <> 10 GROUP BY query_id)
SELECT query_id, coalesce(text, 'No memories found.') AS text FROM queries LEFT JOIN texts USING (query_id)""",
    "list_digest": f"""
WITH {EVENT_RECORDS}
SELECT 'Found ' || count(*) || ' memories:' AS line FROM memories
UNION ALL SELECT '• [' || type || '] tags=' || array_to_string(tag_list, ', ') FROM memories""",
    "list_items_many": f"{LISTS_MANY} SELECT query_id, rank, id, type, created_at FROM hits",
    "list_digests_many": f"""
{LISTS_MANY},
chunks AS (
  SELECT query_id, (rank - 1) // 50 AS chunk, any_value((n + 49) // 50) AS chunks,
         CASE WHEN (rank - 1) // 50 = 0 THEN 'Found ' || any_value(n) || ' memories:' || chr(10) ELSE '' END || string_agg(
           '• [' || type || '] tags=' || array_to_string(tag_list, ', '), chr(10) ORDER BY rank) AS text
  FROM hits GROUP BY query_id, (rank - 1) // 50)
SELECT query_id, coalesce(chunk, 0) AS chunk, coalesce(chunks, 1) AS chunks, coalesce(text, 'No memories found.') AS text
FROM asked LEFT JOIN chunks USING (query_id) WHERE kind < 19
UNION ALL SELECT NULL, NULL, NULL, 'tags must be an array' FROM asked WHERE kind = 19""",
    "resource_links": f"""
WITH {EVENT_RECORDS}
SELECT id, 'mem://item/' || id AS uri, 'memory:' || id AS name, 'Full content for ' || id AS description,
       'application/json' AS "mimeType" FROM memories""",
    "full_records": f"""
WITH {EVENT_RECORDS}
SELECT id, type, content, source, tags, confidence, created_at AS "createdAt", updated_at AS "updatedAt" FROM memories""",
    "record_cards": f"""
WITH {EVENT_RECORDS}
SELECT id, concat_ws(chr(10), 'Memory: ' || id, 'Type: ' || type, 'Source: ' || source, 'Tags: ' || {JSON_TAGS},
       'Confidence: ' || {_number("confidence")}, 'Created: ' || {LONG_TIME.format("created_at")},
       'Updated: ' || {LONG_TIME.format("updated_at")}, '', 'Content:',
       replace(replace(replace(content, '{{', '{{' || chr(10) || '  '), ':', ': '), '}}', chr(10) || '}}')) AS text
FROM memories""",
    "json_lines": f"""
WITH {EVENT_RECORDS}
SELECT '{{"id":"' || id || '","type":"' || type || '","content":' || to_json(content) || ',"tags":' || {JSON_TAGS}
       || '}}' AS value FROM memories""",
    "create_documents": CREATED,
    "reuse_vectors": f"""
WITH {DOCUMENT_REQUESTS}
SELECT sha256(content) || '::hashed-words-64' AS embed_key,
       CASE WHEN bool_or(error IS NULL AND doc_id % 3 <> 0) THEN 64 END AS width
FROM checked GROUP BY content""",
    "create_retried": f"SELECT *, true AS first_time, 0 AS waiting FROM ({CREATED})",
    "embed_retry": "SELECT doc_id, 64 AS width, NULL::VARCHAR AS embed_error FROM documents",
    "reject_vectors": """
SELECT doc_id, CASE WHEN length(text) % 5 = 4 THEN 64 END AS width,
       CASE length(text) % 5 WHEN 0 THEN 'Failed to generate embedding after retries' WHEN 1 THEN 'expected 64 dimensions, not 65'
         WHEN 2 THEN 'NaN not allowed in vector' WHEN 3 THEN 'infinite value not allowed in vector' END AS embed_error
FROM documents""",
    "search_documents": f"""
WITH {DOCUMENT_REQUESTS},
records AS (
  SELECT content_hash, {_uuid("content_hash")} AS id, type, array_to_string(list_sort([type, source]), ',') AS tags,
         max(confidence) AS confidence, min(content) AS content
  FROM checked WHERE error IS NULL GROUP BY content_hash, type, source),
asked AS (
  SELECT conv_id || '/' || turn || '/' || role AS query_id, text
  FROM conversations WHERE length(text) <= 1000 AND trim(text) <> ''),
{_vectors("stored", "SELECT id AS key, content AS text FROM records")},
{_vectors("wanted", "SELECT query_id AS key, text FROM asked")},
products AS (
  SELECT w.key AS query_id, s.key AS id, sum(w.x::DOUBLE * s.x::DOUBLE) AS p
  FROM wanted w JOIN stored s USING (place) GROUP BY w.key, s.key),
scores AS (
  SELECT query_id, id, type, tags, confidence, floor((1 + coalesce(p, 0)) * 1000000 + 0.5) / 1000000 AS similarity
  FROM asked CROSS JOIN records LEFT JOIN products USING (query_id, id))
SELECT query_id, rank, id, type, tags, confidence, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM scores)
WHERE rank <= 5""",
    "create_incremental": CREATED,
    "first_writer": """
SELECT content_hash, first(type ORDER BY ts, event_id) AS type, first(source ORDER BY ts, event_id) AS source,
       min(ts) AS created_at, count(DISTINCT type) AS types
FROM (
  SELECT ts, event_id, CASE WHEN event_id % 2 = 0 THEN 'a::b' ELSE 'a' END AS type,
         CASE WHEN event_id % 2 = 0 THEN 'c' ELSE 'b::c' END AS source,
         sha256('a::b::c::' || replace(props, ': ', ':')) AS content_hash
  FROM events)
GROUP BY content_hash""",
    "validate_edge_creates": """
SELECT doc_id, CASE WHEN doc_id % 8 < 5 THEN 'content is required' WHEN doc_id % 8 = 5 THEN 'tags must be an array'
         WHEN doc_id % 8 = 6 THEN 'tags array cannot have more than 20 items' END AS error,
       CASE WHEN doc_id % 8 = 7 THEN 50 END AS type_length, CASE WHEN doc_id % 8 = 7 THEN 100 END AS source_length
FROM documents""",
    "browse_rejects": """
SELECT event_id AS request_id, 'Unknown resource: mem://unknown/' || event_type AS error
FROM events WHERE event_type NOT IN ('click', 'error', 'view')""",
    "search_edge_vectors": f"""
WITH {CENTROID}, ways AS (SELECT unnest(['builtin', 'arrow', 'many']) AS way)
SELECT way, id, similarity FROM ways, (
  SELECT vec_id AS id, {SCORE.format("embedding", "v")} AS similarity
  FROM embeddings, centroid WHERE vec_id % 7 > 3 ORDER BY 2 DESC, 1 LIMIT 50)""",
    "stream_upsert": UPSERT_FOLD,
    "stream_keyed": UPSERT_FOLD,
    "stream_ingest": f"""
WITH {EVENT_WRITES}
SELECT content_hash, min(id) AS id, min(type) AS type, min(content) AS content, min(source) AS source,
       array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags, max(confidence) AS confidence
FROM writes WHERE confidence BETWEEN 0 AND 1 GROUP BY content_hash""",
}
