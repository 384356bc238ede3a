"""DuckDB twins of the corpus queries whose rows SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
    SELECT DISTINCT doc_id, gram FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS gram
        FROM words)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
    WHERE 100 * common >= 90 * (s.n + t.n - common)
), reached AS (
    SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, coalesce(min(r.b), d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN reached r ON r.a = d.doc_id GROUP BY d.doc_id
"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP6 = f"""
WITH docs AS (
    SELECT doc_id, {_WORDS} AS w FROM documents
), phrases AS (
    SELECT DISTINCT item_id, len(p) AS n, array_to_string(p, ' ') AS phrase FROM (
        SELECT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 13 THEN [w]
            ELSE list_transform(range(1, len(w) - 11), lambda i: w[i : i + 12]) END) AS p
        FROM (SELECT item_id, {_WORDS} AS w FROM benchmark))
), places AS (
    SELECT doc_id, n, place, array_to_string(w[place : place + n - 1], ' ') AS phrase
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS place FROM docs, (SELECT DISTINCT n FROM phrases))
), hits AS (
    SELECT doc_id, item_id, place, n FROM places JOIN phrases USING (n, phrase)
), words_hit AS (
    SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + n)) AS word FROM hits) GROUP BY doc_id
), items_hit AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""

_DIGITS32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_FIVE_HEX = "CAST('0x' || substr(hex, 5 * g + 1, 5) AS BIGINT)"  # 20 bits are four base-32 digits
_FOUR = " || ".join(f"substr({_DIGITS32}, (({_FIVE_HEX} >> {k}) & 31) + 1, 1)" for k in (15, 10, 5, 0))

_OP9 = f"""
WITH hashed AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), named AS (
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
        array_to_string(list_transform(range(0, 8), lambda g: {_FOUR}), '') AS payload_digest, min(page_id) OVER (PARTITION BY hex) AS first
    FROM hashed
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to
FROM named
"""

ORACLE_SQL = {"op1_ngram_jaccard_join": _OP1, "op6_benchmark_decontamination": _OP6, "op9_warc_chunks": _OP9}
