"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_filters(rules) -> str:
    values = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in rules)
    return f"""
WITH rules(verdict, host, path) AS (VALUES {values}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
best AS (
  SELECT p.rid, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.rid)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b USING (rid)"""


def decontamination(window: int, min_share: int) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {words} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), {window}) AS size, array_to_string(w[i:i + least(len(w), {window}) - 1], ' ') AS key
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {window} + 1, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
spans AS (
  SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS key
  FROM (SELECT rid, size, w, unnest(range(1, len(w) - size + 2)) AS i
        FROM docs CROSS JOIN (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT s.rid, s.i, s.size, x.item FROM spans s JOIN windows x ON s.key = x.key AND s.size = x.size),
hits AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS place FROM found) GROUP BY rid),
names AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AND {min_share} * coalesce(h.n, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hits h USING (rid) LEFT JOIN names m USING (rid)"""


def warc() -> str:
    # the 160 bits of the SHA-1 as 32 digits of 5 bits, from 8 numbers of 20 bits
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
s AS (SELECT page_id, body, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS keeper FROM p),
n AS (SELECT *, [CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT) FOR i IN range(0, 8)] AS v FROM s)
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1 AS INTEGER), 1) FOR i IN range(0, 32)], '') AS payload_digest,
       CASE WHEN keeper IS NULL OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper IS NULL OR page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM n"""


def ranked_search(top: int) -> str:
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH items AS (SELECT DISTINCT item, item_id, unnest(w) AS term
               FROM (SELECT row_number() OVER () AS item, item_id, {terms} AS w FROM benchmark)),
docs AS (SELECT * FROM (SELECT row_number() OVER () AS rid, doc_id, {terms} AS w FROM documents) WHERE len(w) > 0),
corpus AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS terms FROM docs),
tf AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM docs)
       WHERE term IN (SELECT term FROM items) GROUP BY rid, doc_id, n, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(c.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM tf CROSS JOIN corpus c GROUP BY term),
scores AS (
  SELECT i.item, any_value(i.item_id) AS item_id, t.rid, any_value(t.doc_id) AS doc_id,
         CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 90 + (90 * t.n * c.n) // c.terms)))) AS BIGINT) AS score
  FROM items i JOIN tf t USING (term) JOIN weights w USING (term) CROSS JOIN corpus c GROUP BY i.item, t.rid)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= {top}"""
