"""DuckDB statements of the registered queries that SQL can express."""

_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def line_dedup(table: str) -> str:
    """CTEs ending in ``lines_kept(doc_id, n_lines, n_dropped, kept)`` for ``table(doc_id, text)``."""
    return f"""
cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM {table}),
line AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS n, unnest(parts) AS part FROM cut),
keyed AS (SELECT *, translate(trim(part, {_BLANKS}), {_A_TO_Z}) AS key FROM line),
holder AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT doc_id, n, part, coalesce(doc_id > first, false) AS gone FROM keyed LEFT JOIN holder USING (key)),
lines_kept AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           coalesce(string_agg(part, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') AS kept
    FROM marked GROUP BY doc_id)"""


ORACLES = {
    "op3_substring_dedup": r"""
WITH cut AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
word AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS w FROM cut),
win AS (SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS run FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM cut)),
first AS (SELECT run, min(doc_id) AS least FROM win GROUP BY run HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT DISTINCT doc_id, p FROM win JOIN first USING (run) WHERE doc_id > least),
marked AS (
    SELECT word.doc_id, word.p, w, max(hit.p IS NOT NULL) OVER (PARTITION BY word.doc_id ORDER BY word.p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
    FROM word LEFT JOIN hit ON word.doc_id = hit.doc_id AND word.p = hit.p),
kept AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS text
    FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)""",
    "op6_line_dedup": f"WITH {line_dedup('documents')} SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM lines_kept",
}


def contained_items(table: str) -> str:
    """CTEs ending in ``held(doc_id, item_id, n_shingles, n_found, containment)``."""
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), %s), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')" % _A_TO_Z
    return f"""
item AS (SELECT item_id, {words} AS w FROM benchmark),
item_size AS (SELECT item_id, w, least(len(w), 5) AS k FROM item WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM item_size)),
total AS (SELECT item_id, count(*) AS n_shingles FROM wanted GROUP BY item_id),
doc AS (SELECT doc_id, {words} AS w FROM {table}),
placed AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM item_size) WHERE len(w) >= k),
spelled AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS run FROM placed),
held AS (
    SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
    FROM spelled JOIN wanted USING (k, run) JOIN total USING (item_id)
    GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= ceil(n_shingles * 0.8 - 1e-9))"""


ORACLES["op4_benchmark_decontamination"] = f"WITH {contained_items('documents')} SELECT * FROM held"

ORACLES["op11_exact_top_k"] = """
WITH usable AS (SELECT row_number() OVER () AS row, vec_id, embedding AS e FROM embeddings WHERE len(embedding) > 0),
numbers AS (
    SELECT row, vec_id, list_transform(e, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM usable
    WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asked AS (SELECT row, vec_id AS query_id, v AS q FROM numbers WHERE vec_id % 50 = 0),
scored AS (
    SELECT asked.row, query_id, numbers.vec_id, list_sum(list_transform(list_zip(q, v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM asked JOIN numbers ON asked.row <> numbers.row AND len(q) = len(v))
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored) WHERE rank <= 5"""

ORACLES["op13_phrase_collocations"] = rf"""
WITH piece AS (
    SELECT row_number() OVER () AS piece, lang, regexp_extract_all(part, '[^\x20\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_A_TO_Z}), '[.,;:!?\x0A-\x0D]')) AS part FROM documents)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY lang),
f AS (
    SELECT lang, k, phrase, count(*) AS a
    FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS phrase FROM piece, unnest(range(1, 6)) AS t(k))
    GROUP BY lang, k, phrase HAVING count(*) >= 100),
inside AS (
    SELECT DISTINCT lang, phrase, a FROM (
        SELECT lang, a, phrase[1:k - 1] AS phrase FROM f WHERE k > 2
        UNION ALL SELECT lang, a, phrase[2:k] FROM f WHERE k > 2)),
kept AS (SELECT lang, k, phrase, a FROM f ANTI JOIN inside USING (lang, phrase, a) WHERE k > 1),
cut AS (SELECT lang, phrase, a, phrase[1:i] AS x, phrase[i + 1:k] AS y, i FROM (SELECT *, unnest(range(1, k)) AS i FROM kept)),
scored AS (
    SELECT cut.lang, cut.phrase, cut.a, i, l.a AS l, r.a AS r, n, ((1000::HUGEINT * cut.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
    FROM cut JOIN f AS l ON l.lang = cut.lang AND l.phrase = x JOIN f AS r ON r.lang = cut.lang AND r.phrase = y JOIN total ON total.lang = cut.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
    SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, n, score,
           row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank
    FROM lowest) WHERE rank <= 2000"""
