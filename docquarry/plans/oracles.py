"""SQL statements of the registered queries, for checking values.

Written against the same tables in a generic dialect with list functions and
recursive queries, independently of how the operators work.
"""

from __future__ import annotations

from docquarry.functions import labels
from docquarry.operators import highlights, prompts

TRIM = "concat(" + ", ".join(
    f"chr({code})"
    for code in [9, 10, 11, 12, 13, 32, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279]
) + ")"
NL = "chr(10)"
STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


def text_sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def normalized(text: str) -> str:
    return f"trim(replace({text}, chr(13) || chr(10), {NL}), {TRIM})"


def chunks_of(source: str, size: int = 800, overlap: int = 120, name: str = "chunks") -> str:
    """CTEs from ``source(doc_id, page, t)`` (normalised t) to the chunk table."""
    shortest = int(size * 0.6)
    at = f"(s + {size + 1} - instr(reverse(substr(t, s + 1, {size + 1})), {NL}))"
    has = f"instr(reverse(substr(t, s + 1, {size + 1})), {NL}) > 0"
    stop = (
        f"CASE WHEN s + {size} >= n THEN n WHEN {has} AND {at} > s + {shortest} THEN {at} ELSE s + {size} END"
    )
    return f"""
    walk AS (
      SELECT doc_id, page, t, n, s, {stop} AS e
      FROM (SELECT doc_id, page, t, length(t) AS n, CAST(0 AS BIGINT) AS s FROM {source} WHERE length(t) > 0)
      UNION ALL
      SELECT doc_id, page, t, n, s, {stop} AS e
      FROM (SELECT doc_id, page, t, n, greatest(e - {overlap}, s + 1) AS s FROM walk WHERE e < n)
    ),
    {name} AS (
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, s) - 1 AS chunk_index, page, piece AS text
      FROM (SELECT doc_id, page, s, trim(substr(t, s + 1, e - s), {TRIM}) AS piece FROM walk)
      WHERE piece <> ''
    )"""


DOC_SOURCE = f"src AS (SELECT doc_id, 0 AS page, {normalized('text')} AS t FROM documents)"
DOC_CHUNKS = f"{DOC_SOURCE}, {chunks_of('src')}"
PAGE_SOURCE = f"src AS (SELECT conv_id AS doc_id, turn + 1 AS page, {normalized('text')} AS t FROM conversations)"
PAGE_CHUNKS = f"{PAGE_SOURCE}, {chunks_of('src', 200, 30)}"

UPLOADS = """
    uploads AS (
      SELECT doc_id, source || '-' || doc_id
               || list_extract(['.txt', '.MD', '.csv', '.pdf', '.docx', '.html', ''], CAST(doc_id % 7 + 1 AS INT)) AS file_name,
             text, TIMESTAMP '2024-01-01' + to_minutes(doc_id // 3) AS uploaded_at
      FROM documents
    )"""
SUPPORTED = " OR ".join(f"lower(file_name) LIKE '%{e}'" for e in (".txt", ".md", ".csv", ".pdf", ".docx"))


def terms_of(source: str, keys: str, name: str) -> str:
    """Long-form hashed vectors of ``source(keys, text)``."""
    return f"""
    {name}_slots AS (
      SELECT {keys}, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 1536 AS slot
      FROM (SELECT {keys}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {source})
    ),
    {name}_counts AS (SELECT {keys}, slot, count(*) AS hits FROM {name}_slots GROUP BY {keys}, slot),
    {name} AS (
      SELECT {keys}, slot,
             CAST(CAST(hits / sqrt(CAST(sum(hits * hits) OVER (PARTITION BY {keys}) AS DOUBLE)) AS FLOAT) AS DOUBLE) AS weight
      FROM {name}_counts
    )"""


def question_hits(source: str, order: str = "score DESC, doc_id, chunk_index") -> str:
    """CTEs ending in ``sources``: the best chunks of ``source(doc_id, page, t)``
    for each benchmark question."""
    return f"""
    {UPLOADS},
    src AS ({source}),
    {chunks_of('src')},
    {terms_of('chunks', 'doc_id, chunk_index', 'cv')},
    asked AS (SELECT item_id AS query_id, text FROM benchmark),
    {terms_of('asked', 'query_id', 'qv')},
    cn AS (SELECT doc_id, chunk_index, sqrt(sum(weight * weight)) AS len FROM cv GROUP BY ALL),
    qn AS (SELECT query_id, sqrt(sum(weight * weight)) AS len FROM qv GROUP BY ALL),
    dots AS (
      SELECT query_id, doc_id, chunk_index, sum(qv.weight * cv.weight) AS d FROM qv JOIN cv USING (slot) GROUP BY ALL
    ),
    ranked AS (
      SELECT query_id, doc_id, chunk_index, score,
             row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank
      FROM (SELECT query_id, doc_id, chunk_index, round(d / (cn.len * qn.len), 6) AS score
            FROM dots JOIN cn USING (doc_id, chunk_index) JOIN qn USING (query_id))
      JOIN (SELECT doc_id, uploaded_at FROM uploads) USING (doc_id)
    ),
    sources AS (
      SELECT query_id, rank, 'chunk-' || chunk_index AS chunk_id, score, chunks.text AS text, chunk_index, doc_id,
             file_name, CAST(NULL AS BIGINT) AS page
      FROM ranked JOIN chunks USING (doc_id, chunk_index) JOIN uploads USING (doc_id)
      WHERE rank <= 3
    )"""


ALL_DOCUMENTS = f"SELECT doc_id, 0 AS page, {normalized('text')} AS t FROM uploads"
QUESTION_HITS = question_hits(ALL_DOCUMENTS)
CONTEXTS = f"""
    contexts AS (
      SELECT query_id,
             string_agg('Source ' || rank || ' (' || file_name || ', chunk ' || (chunk_index + 1) || '):' || {NL} || text,
                        {NL} || {NL} ORDER BY rank) AS context
      FROM sources GROUP BY query_id
    )"""
PROMPTS = f"""
    SELECT query_id, 'Question:' || {NL} || text || {NL} || {NL} || 'Context:' || {NL} || coalesce(context, '') AS prompt
    FROM asked LEFT JOIN contexts USING (query_id)"""

VECTORS = """
    vecs AS (SELECT CAST(label AS BIGINT) AS doc_id, vec_id AS chunk_index, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    entries AS (SELECT doc_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vecs),
    centroids AS (
      SELECT doc_id AS query_id, list(x ORDER BY pos) AS q
      FROM (SELECT doc_id, pos, avg(x) AS x FROM entries GROUP BY doc_id, pos) GROUP BY doc_id
    ),
    scored AS (
      SELECT query_id, doc_id, chunk_index, round(list_cosine_similarity(q, v), 6) AS score FROM centroids, vecs
    )"""
ORDER_HITS = "ORDER BY score DESC, doc_id, chunk_index"

VERSIONS = """
    versions AS (
      SELECT CAST(label AS BIGINT) AS doc_id, vec_id AS chunk_index, 'first' AS text, CAST(0 AS BIGINT) AS batch_id FROM embeddings
      UNION ALL
      SELECT CAST(label AS BIGINT), vec_id, 'second', 2 FROM embeddings WHERE embedding[1] > 0
    )"""
NEWEST_VERSION = "QUALIFY batch_id = max(batch_id) OVER (PARTITION BY doc_id)"

CHATS = "chats AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant'))"
HISTORY = f"""
    history AS (
      SELECT conv_id, turn, role, text FROM conversations
      WHERE role IN ('user', 'assistant') AND trim(text, {TRIM}) <> ''
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4
    )"""
LATEST = """
    latest AS (
      SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS question FROM chats GROUP BY conv_id
    )"""
PAIRS = """
    pairs AS (
      SELECT conv_id, turn, coalesce(before, '') AS question, text AS answer
      FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM chats) WHERE role = 'assistant'
    )"""
KEPT = "kept AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)"
BY_ROUTE = """
    routes AS (
      SELECT route, CAST(sum(n) AS BIGINT) AS requests
      FROM (SELECT event_type AS route, count(*) AS n FROM kept GROUP BY 1
            UNION ALL SELECT 'chat', 0 UNION ALL SELECT 'upload', 0) GROUP BY route
    )"""
REQUEST_ID = "conv_id || '-' || turn"

# One step per attempt and client: reject when the share of the previous
# bucket's admissions plus the current bucket's count reaches the limit.
_LIMIT, _WINDOW = 3, 86_400_000_000
ADMISSION = f"""
    WITH RECURSIVE attempts AS (
      SELECT event_id, user_id AS client, epoch_us(ts) // {_WINDOW} AS b, epoch_us(ts) % {_WINDOW} AS elapsed,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
      FROM events WHERE event_id % 97 <> 0
    ),
    steps AS (
      SELECT event_id, client, i, b, CAST(0 AS BIGINT) AS prev, CAST(1 AS BIGINT) AS cur, true AS admitted
      FROM attempts WHERE i = 1
      UNION ALL
      SELECT event_id, client, i, b, prev, CASE WHEN ok THEN cur + 1 ELSE cur END, ok
      FROM (
        SELECT event_id, client, i, b, prev, cur,
               floor((1.0::DOUBLE - elapsed / {_WINDOW}.0::DOUBLE) * prev) + cur < {_LIMIT} AS ok
        FROM (
          SELECT a.event_id, a.client, a.i, a.b, a.elapsed,
                 CASE WHEN a.b = s.b THEN s.prev WHEN a.b = s.b + 1 THEN s.cur ELSE 0 END AS prev,
                 CASE WHEN a.b = s.b THEN s.cur ELSE 0 END AS cur
          FROM steps s JOIN attempts a ON a.client = s.client AND a.i = s.i + 1
        )
      )
    )
    SELECT event_id, client, strftime(ts, {STAMP}) AS decided_at, admitted FROM steps JOIN events USING (event_id)
    UNION ALL SELECT event_id, user_id, NULL, NULL FROM events WHERE event_id % 97 = 0"""

_STOP = ", ".join(text_sql(word) for word in highlights.STOP_WORDS)
TERMS = f"""
    found AS (
      SELECT item_id AS query_id,
             list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{4,}}'), lambda w: NOT list_contains([{_STOP}], w)) AS words
      FROM benchmark
    ),
    firsts AS (
      SELECT query_id, list_filter(words, lambda w, i: list_position(words, w) = i)[1:{highlights.MAX_TERMS}] AS terms FROM found
    )"""

_MESSAGES = ("['Missing OPENAI_API_KEY', 'Missing GEMINI_API_KEY', 'Incorrect API key provided', "
             "'You exceeded your current QUOTA', 'billing hard limit', 'socket closed']")

ORACLES: dict[str, str] = {
    "extension_gate": f"WITH {UPLOADS} SELECT doc_id, file_name, ({SUPPORTED}) AS supported FROM uploads",
    "ingest_gate": f"""
        WITH RECURSIVE {UPLOADS},
        files AS (
          SELECT doc_id, CASE WHEN doc_id % 17 <> 4 THEN file_name END AS file_name,
                 CASE WHEN doc_id % 11 = 3 THEN ' ' || {NL} || chr(9) WHEN doc_id % 13 <> 5 THEN text END AS text
          FROM uploads
        ),
        src AS (SELECT doc_id, 0 AS page, {normalized('text')} AS t FROM files WHERE text IS NOT NULL),
        {chunks_of('src')},
        counts AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id),
        judged AS (
          SELECT doc_id, file_name, coalesce(n, 0) AS n,
                 CASE WHEN file_name IS NULL THEN 'invalid'
                      WHEN NOT ({SUPPORTED}) THEN 'unsupported'
                      WHEN text IS NULL THEN 'unreadable'
                      WHEN trim(text, {TRIM}) = '' THEN 'empty'
                      WHEN coalesce(n, 0) = 0 THEN 'no_chunks' ELSE 'ready' END AS status
          FROM files LEFT JOIN counts USING (doc_id)
        )
        SELECT doc_id, file_name, status, CASE WHEN status = 'ready' THEN n ELSE 0 END AS chunk_count FROM judged""",
    "normalize_text": f"SELECT doc_id, trim(text, {TRIM}) AS text FROM documents",
    "chunk_text": f"""
        WITH RECURSIVE {DOC_CHUNKS}
        SELECT doc_id, chunk_index, 'chunk-' || chunk_index AS chunk_id, text FROM chunks""",
    "chunk_pages": f"""
        WITH RECURSIVE {PAGE_CHUNKS}
        SELECT doc_id, chunk_index, 'chunk-' || chunk_index AS chunk_id, page, text FROM chunks""",
    "merge_pages": f"""
        SELECT conv_id AS doc_id, CAST(0 AS BIGINT) AS part, trim(string_agg(text, {NL} || {NL} ORDER BY turn), {TRIM}) AS text
        FROM conversations GROUP BY conv_id""",
    "chunk_counts": f"WITH RECURSIVE {DOC_CHUNKS} SELECT doc_id, count(*) AS chunk_count FROM chunks GROUP BY doc_id",
    "embed_hashed": f"""
        WITH RECURSIVE {DOC_CHUNKS}, {terms_of('chunks', 'doc_id, chunk_index', 'cv')}
        SELECT doc_id, chunk_index, slot, round(weight, 6) AS weight FROM cv""",
    "attach_vectors": f"""
        WITH {VECTORS}
        SELECT doc_id, chunk_index, 'chunk-' || chunk_index AS chunk_id, len(v) AS dim,
               round(sqrt(list_inner_product(v, v)), 6) AS length FROM vecs""",
    "upsert_latest": f"WITH {VERSIONS} SELECT doc_id, chunk_index, text, batch_id FROM versions {NEWEST_VERSION}",
    "list_documents": f"""
        WITH RECURSIVE {UPLOADS}, {DOC_CHUNKS}
        SELECT doc_id, file_name, strftime(uploaded_at, {STAMP}) AS uploaded_at, n AS chunk_count
        FROM uploads JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) USING (doc_id)""",
    "registry_after_delete": f"""
        WITH RECURSIVE {UPLOADS}, {DOC_CHUNKS}
        SELECT doc_id, file_name, strftime(uploaded_at, {STAMP}) AS uploaded_at,
               CASE WHEN doc_id % 10 = 0 THEN 1 ELSE n END AS chunk_count
        FROM uploads JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) USING (doc_id)
        WHERE doc_id % 5 <> 0 OR doc_id % 10 = 0""",
    "paged_ingest": f"""
        WITH RECURSIVE {PAGE_SOURCE}, {chunks_of('src')}
        SELECT doc_id, chunk_index, page, text, 'talk-' || doc_id || '.pdf' AS file_name FROM chunks WHERE doc_id % 4 <> 0""",
    "delete_documents": f"""
        WITH {VERSIONS},
        gone AS (SELECT DISTINCT label AS doc_id FROM embeddings WHERE label % 3 = 0)
        SELECT doc_id, chunk_index, text, batch_id FROM versions
        WHERE batch_id > 1 OR doc_id NOT IN (SELECT doc_id FROM gone) {NEWEST_VERSION}""",
    "compact_store": f"""
        WITH {VERSIONS},
        gone AS (SELECT DISTINCT label AS doc_id FROM embeddings WHERE label % 3 = 0)
        SELECT doc_id, chunk_index, text, CAST(64 AS BIGINT) AS dim
        FROM (SELECT * FROM versions WHERE batch_id > 1 OR doc_id NOT IN (SELECT doc_id FROM gone) {NEWEST_VERSION})""",
    "cosine_scores": f"WITH {VECTORS} SELECT query_id, doc_id, chunk_index, score FROM scored WHERE query_id = doc_id",
    "topk_in_document": f"""
        WITH {VECTORS}
        SELECT query_id, doc_id, chunk_index, score, row_number() OVER (PARTITION BY query_id {ORDER_HITS}) AS rank
        FROM scored WHERE query_id = doc_id QUALIFY rank <= 3""",
    "topk_all_documents": f"""
        WITH {VECTORS}
        SELECT query_id, doc_id, chunk_index, score, row_number() OVER (PARTITION BY query_id {ORDER_HITS}) AS rank
        FROM scored QUALIFY rank <= 3""",
    "topk_per_document": f"""
        WITH {VECTORS}
        SELECT query_id, doc_id, chunk_index, score, row_number() OVER (PARTITION BY query_id, doc_id {ORDER_HITS}) AS rank
        FROM scored QUALIFY rank <= 3""",
    "scoped_topk": f"""
        WITH {VECTORS},
        registered AS (SELECT DISTINCT doc_id FROM vecs WHERE doc_id % 3 <> 0),
        pool AS (
          SELECT 'in-' || query_id AS query_id, doc_id, chunk_index, score FROM scored WHERE query_id = doc_id
          UNION ALL
          SELECT 'all-' || query_id, doc_id, chunk_index, score FROM scored WHERE doc_id IN (SELECT doc_id FROM registered)
        )
        SELECT query_id, doc_id, chunk_index, score, row_number() OVER (PARTITION BY query_id {ORDER_HITS}) AS rank
        FROM pool QUALIFY rank <= 3""",
    "answer_sources": f"WITH RECURSIVE {QUESTION_HITS} SELECT * FROM sources",
    "citation_labels": f"""
        WITH RECURSIVE {PAGE_CHUNKS}, shifted AS (SELECT * REPLACE (page - 1 AS page) FROM chunks)
        SELECT doc_id, chunk_index,
               CASE WHEN page > 0 THEN 'page ' || page ELSE 'chunk ' || (chunk_index + 1) END AS location,
               CASE WHEN page % 2 = 0 THEN 'talk-' || doc_id || ' · ' ELSE '' END
                 || CASE WHEN page > 0 THEN 'Page ' || page ELSE 'Chunk ' || (chunk_index + 1) END AS label,
               printf('%.3f', length(text) / 777.0::DOUBLE) AS score
        FROM shifted""",
    "build_context": f"""
        WITH RECURSIVE {QUESTION_HITS}, {CONTEXTS}
        SELECT query_id, coalesce(context, '') AS context FROM asked LEFT JOIN contexts USING (query_id)""",
    "build_prompt": f"WITH RECURSIVE {QUESTION_HITS}, {CONTEXTS} {PROMPTS}",
    "sources_newest_first": f"""
        WITH RECURSIVE {question_hits(ALL_DOCUMENTS, 'score DESC, uploaded_at DESC, doc_id, chunk_index')}
        SELECT query_id, rank, chunk_id, score, text, chunk_index, doc_id, file_name, page FROM sources""",
    "store_prompts": f"WITH RECURSIVE {question_hits(f'{ALL_DOCUMENTS} WHERE {SUPPORTED}')}, {CONTEXTS} {PROMPTS}",
    "history_window": f"WITH {HISTORY} SELECT conv_id, turn, role, text FROM history",
    "message_list": f"""
        WITH {CHATS}, {LATEST}, {HISTORY},
        lines AS (
          SELECT conv_id, 0 AS part, 0 AS turn, 'system' AS role, {text_sql(prompts.SYSTEM_PROMPT)} AS content FROM latest
          UNION ALL
          SELECT conv_id, 1, turn, role, text FROM history SEMI JOIN latest USING (conv_id)
          UNION ALL
          SELECT conv_id, 2, 0, 'user', 'Question:' || {NL} || question || {NL} || {NL} || 'Context:' || {NL} FROM latest
        )
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, turn) AS position, role, content FROM lines""",
    "chat_messages": f"""
        WITH RECURSIVE {question_hits(f'{ALL_DOCUMENTS} WHERE {SUPPORTED}')}, {CONTEXTS}, {HISTORY},
        prompt AS (SELECT query_id AS conv_id, prompt FROM ({PROMPTS})),
        lines AS (
          SELECT conv_id, 0 AS part, 0 AS turn, 'system' AS role, {text_sql(prompts.SYSTEM_PROMPT)} AS content FROM prompt
          UNION ALL
          SELECT conv_id, 1, turn, role, text FROM history SEMI JOIN prompt USING (conv_id)
          UNION ALL
          SELECT conv_id, 2, 0, 'user', prompt FROM prompt
        )
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, turn) AS position, role, content FROM lines""",
    "validate_questions": f"""
        SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' ELSE trim(text, {TRIM}) END AS question,
               CASE WHEN role = 'system' OR trim(text, {TRIM}) = '' THEN {text_sql(prompts.NO_QUESTION_TEXT)}
                    WHEN NOT EXISTS (SELECT 1 FROM documents) THEN {text_sql(prompts.NO_DOCUMENT_TEXT)} END AS error
        FROM conversations""",
    "highlight_terms": f"WITH {TERMS} SELECT query_id, array_to_string(terms, ' ') AS terms FROM firsts",
    "highlight_text": f"""
        WITH RECURSIVE {QUESTION_HITS}, {TERMS}
        SELECT query_id, rank,
               CASE WHEN len(terms) = 0 THEN text
                    ELSE regexp_replace(text, '(?i)(' || array_to_string(terms, '|') || ')', '<mark>\\1</mark>', 'g') END AS marked
        FROM sources JOIN firsts USING (query_id)""",
    "latest_question": f"WITH {CHATS}, {LATEST} SELECT conv_id, question FROM latest",
    "latest_sources": f"""
        WITH {CHATS},
        given AS (
          SELECT conv_id, turn,
                 CASE WHEN role = 'assistant' AND length(text) % 3 = 0 THEN []
                      WHEN role = 'assistant' AND length(text) % 3 = 1
                      THEN list_filter(string_split(text, {NL}), lambda x: x <> '') END AS sources
          FROM chats
        ),
        picked AS (SELECT conv_id, sources FROM given WHERE sources IS NOT NULL
                   QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
        SELECT conv_id, CAST(coalesce(len(sources), 0) AS BIGINT) AS source_count,
               coalesce(array_to_string(sources, '|'), '') AS sources
        FROM (SELECT DISTINCT conv_id FROM chats) LEFT JOIN picked USING (conv_id)""",
    "feedback_pairs": f"WITH {CHATS}, {PAIRS} SELECT conv_id, turn, question, answer FROM pairs",
    "export_markdown": f"""
        WITH {CHATS}
        SELECT conv_id, CAST(0 AS BIGINT) AS part,
               '# Conversation export' || {NL} || {NL}
                 || string_agg(CASE WHEN role = 'user' THEN '**You:** ' ELSE '**Assistant:** ' END || text, {NL} || {NL} ORDER BY turn)
                 || {NL} AS markdown
        FROM chats GROUP BY conv_id""",
    "replay_answers": f"""
        SELECT {REQUEST_ID} AS request_id, CAST(0 AS BIGINT) AS part, text AS answer,
               '[{{"index":' || turn || '}}]' AS sources
        FROM conversations WHERE role = 'assistant' AND length(text) % 2 <> 0""",
    "replay_requests": f"""
        SELECT {REQUEST_ID} AS request_id, length(text) % 2 = 0 AS failed,
               CASE WHEN length(text) % 2 = 0 THEN 'Chat request failed.' END AS error,
               '[{{"index":' || turn || '}}]' AS sources, len(string_split(text, {NL})) AS deltas
        FROM conversations WHERE role = 'assistant'""",
    "usage_retained": f"""
        WITH {KEPT}
        SELECT event_id, event_type AS route, value AS latency_ms, strftime(ts, {STAMP}) AS ts FROM kept""",
    "decode_usage": """
        WITH damaged AS (
          SELECT event_id, CASE WHEN event_id % 7 = 0 THEN substr(props, 2) ELSE props END AS raw FROM events
        )
        SELECT event_id, CAST(raw::JSON ->> 'k' AS BIGINT) AS k
        FROM (SELECT event_id, CASE WHEN json_valid(raw) THEN raw END AS raw FROM damaged) WHERE raw IS NOT NULL""",
    "usage_summary": f"""
        WITH {KEPT}, {BY_ROUTE},
        recent AS (SELECT * FROM kept ORDER BY ts DESC, event_id DESC LIMIT 20)
        SELECT (SELECT count(*) FROM kept) AS total_requests,
               (SELECT CAST(floor(avg(value) + 0.5) AS BIGINT) FROM kept) AS average_latency_ms,
               (SELECT string_agg(route || '=' || requests, ',' ORDER BY route) FROM routes) AS by_route,
               (SELECT string_agg(event_type || '@' || strftime(ts, {STAMP}), ',' ORDER BY ts DESC, event_id DESC)
                FROM recent) AS recent""",
    "usage_by_route": f"WITH {KEPT}, {BY_ROUTE} SELECT route, requests FROM routes",
    "usage_recent": f"""
        WITH {KEPT}
        SELECT event_id, event_type AS route, value AS latency_ms, strftime(ts, {STAMP}) AS ts
        FROM (SELECT * FROM kept ORDER BY ts DESC, event_id DESC LIMIT 20)""",
    "feedback_retained": f"""
        WITH {CHATS}, {PAIRS},
        submitted AS (
          SELECT conv_id, turn, question, length(answer) AS n,
                 CASE WHEN length(answer) % 5 = 0 THEN 'maybe' WHEN length(answer) % 2 = 0 THEN 'up' ELSE 'down' END AS vote,
                 CASE WHEN length(answer) % 7 = 0 THEN '' WHEN length(answer) % 7 = 1 THEN ' ' ELSE answer END AS answer
          FROM pairs
        )
        SELECT conv_id * 1000 + turn AS event_id, vote, question, answer, CASE WHEN n % 3 <> 0 THEN conv_id END AS doc_id
        FROM submitted WHERE vote IN ('up', 'down') AND question <> '' AND answer <> ''
        ORDER BY conv_id DESC, event_id DESC LIMIT 500""",
    "client_id": f"""
        SELECT event_id,
               CASE WHEN user_id % 5 <= 2 THEN {text_sql(labels.ANONYMOUS)} ELSE '10.0.0.' || user_id END AS client
        FROM events""",
    "throttle_flags": f"""
        SELECT event_id, client, strftime(ts, {STAMP}) AS ts, attempts, attempts > 3 AS throttled
        FROM (SELECT event_id, user_id AS client, ts,
                     count(*) OVER (PARTITION BY user_id ORDER BY ts
                                    RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS attempts
              FROM events WHERE event_id % 97 <> 0)
        UNION ALL SELECT event_id, user_id, NULL, NULL, NULL FROM events WHERE event_id % 97 = 0""",
    "admission_replay": ADMISSION,
    "classify_errors": f"""
        WITH failed AS (
          SELECT event_id,
                 list_extract({_MESSAGES}, CAST(event_id % 6 + 1 AS INT)) AS message,
                 coalesce(list_extract(['invalid_api_key', 'insufficient_quota', 'rate_limit_exceeded', '', NULL],
                                       CAST((event_id // 6) % 5 + 1 AS INT)), '') AS code,
                 coalesce(list_extract([401, 429, 500, NULL], CAST((event_id // 30) % 4 + 1 AS INT)), 0) AS status
          FROM events
        ),
        judged AS (
          SELECT event_id,
                 CASE WHEN message LIKE '%Missing OPENAI_API_KEY%' THEN 1
                      WHEN status = 401 OR code = 'invalid_api_key' OR message ILIKE '%incorrect api key%'
                        OR message ILIKE '%invalid api key%' THEN 2
                      WHEN code = 'insufficient_quota' OR message ILIKE '%quota%' OR message ILIKE '%credits%'
                        OR message ILIKE '%billing%' THEN 3
                      WHEN status = 429 OR code = 'rate_limit_exceeded' THEN 4 ELSE 5 END AS rule
          FROM failed
        )
        SELECT event_id,
               list_extract([{text_sql(labels.MISSING_KEY_TEXT)}, {text_sql(labels.REJECTED_KEY_TEXT)},
                             {text_sql(labels.QUOTA_TEXT)}, {text_sql(labels.RATE_LIMIT_TEXT)},
                             'Chat request failed.'], rule) AS error,
               CAST(CASE WHEN rule = 4 THEN 429 ELSE 500 END AS BIGINT) AS status
        FROM judged""",
    "ingest_stream": f"""
        WITH RECURSIVE {DOC_CHUNKS}
        SELECT doc_id, 'doc-' || doc_id || '.txt' AS file_name, count(*) AS chunk_count FROM chunks GROUP BY doc_id""",
    "usage_stream": f"""
        WITH {KEPT}
        SELECT count(*) AS total_requests, CAST(floor(avg(value) + 0.5) AS BIGINT) AS average_latency_ms FROM kept""",
    # The last day stays open: the watermark never passes its end.
    "request_windows": """
        SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS route, count(*) AS requests
        FROM events GROUP BY 1, 2""",
    "admission_stream": ADMISSION,
    "admission_state_stream": ADMISSION,
}

ORACLES["usage_incremental"] = ORACLES["usage_summary"]
ORACLES["usage_routes_incremental"] = "SELECT event_type AS route, count(*) AS requests FROM events GROUP BY 1"
ORACLES["paged_files"] = ORACLES["chunk_pages"]
ORACLES["export_files"] = ORACLES["export_markdown"]
ORACLES["ingest_once"] = f"""
    WITH RECURSIVE {DOC_CHUNKS},
    delivered AS (
      SELECT doc_id FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0
      UNION ALL SELECT doc_id FROM documents WHERE doc_id % 2 <> 0 OR doc_id % 3 = 0
    ),
    stored AS (SELECT doc_id FROM delivered QUALIFY row_number() OVER (PARTITION BY doc_id) = 1),
    sizes AS (SELECT doc_id, count(*) AS chunk_count FROM chunks GROUP BY doc_id)
    SELECT doc_id, 'doc-' || doc_id || '.txt' AS file_name, count(*) AS times, sum(chunk_count)::BIGINT AS chunk_count
    FROM stored JOIN sizes USING (doc_id) GROUP BY doc_id"""
ORACLES["corpus_files"] = f"""
    WITH RECURSIVE {DOC_CHUNKS}
    SELECT 'doc-' || doc_id || '.txt' AS file_name, count(*) AS chunk_count FROM chunks WHERE doc_id % 5 <> 0 GROUP BY doc_id"""
ORACLES["usage_from_outcomes"] = f"""
    WITH asked AS ({ORACLES["replay_requests"]}), sent AS ({ORACLES["ingest_gate"]}),
    logged AS (
      SELECT request_id AS event_id, 'chat' AS route, deltas * 10.0::DOUBLE AS latency_ms, TIMESTAMP '2024-01-01' + to_seconds(deltas) AS ts
      FROM asked WHERE NOT failed
      UNION ALL
      SELECT CAST(doc_id AS VARCHAR), 'upload', chunk_count * 5.0::DOUBLE, TIMESTAMP '2024-01-01' + to_seconds(doc_id) FROM sent WHERE status = 'ready'
    )
    SELECT event_id, route, latency_ms, strftime(ts, {STAMP}) AS ts FROM (SELECT * FROM logged ORDER BY ts DESC, event_id DESC LIMIT 500)"""
