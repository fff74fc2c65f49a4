"""SQL of the queries that SQL can express; the others are tested against brute force in tests/llm."""

from __future__ import annotations

_CANONICAL = """
regexp_replace(regexp_replace(lower(regexp_extract(u2, '^[^/?]*', 0)), '^www[.]', ''), ':(80|443)$', '')
|| regexp_replace(regexp_extract(regexp_replace(u2, '^[^/?]*', ''), '^[^?]*', 0), '/+$', '')
|| CASE WHEN q = '' THEN '' ELSE '?' || q END
"""

OP1 = f"""
WITH u AS (
  SELECT page_id, url, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u2,
         instr('0123456789abcdef', substr(md5(coalesce(url, '')), 1, 1)) - 1 AS h FROM pages),
v AS (SELECT *, regexp_replace(regexp_replace('&' || regexp_replace(regexp_replace(u2, '^[^/?]*', ''), '^[^?]*[?]?', ''),
         '&(utm_source|utm_medium|utm_campaign|utm_term|utm_content|gclid|fbclid)=[^&]*', '', 'g'), '^&+', '') AS q FROM u),
p AS (SELECT page_id, h, md5(html) AS etag, sha256(html) AS digest, CAST(strlen(html) AS BIGINT) AS size, {_CANONICAL} AS c,
         1700000000 + page_id * 60 AS t, 1700000000 + page_id * 60 + CASE WHEN h = 3 THEN -7200 ELSE 129600 END AS asked FROM v),
hit AS (
  SELECT a.page_id, b.page_id AS b_id, b.t AS b_t, b.etag AS b_etag, b.digest, b.size, b.h AS b_h,
         row_number() OVER (PARTITION BY a.page_id ORDER BY b.t DESC, b.page_id DESC) AS k
  FROM p a JOIN p b ON a.c = b.c AND b.t < a.asked)
SELECT p.page_id, p.c AS canonical_url,
       CASE WHEN p.c IS NULL THEN 'no_key' WHEN b_id IS NULL THEN 'no_response' WHEN x.ok THEN 'resolved' ELSE 'validator_mismatch' END AS status,
       2 * x.b_id AS response_id, b_t AS response_epoch, CASE WHEN x.ok THEN 200 ELSE 304 END AS http_status,
       CASE WHEN p.h = 7 THEN 'changed' ELSE p.etag END AS etag,
       CASE WHEN x.ok THEN 'lm-' || b_h END AS last_modified,
       CASE WHEN x.ok THEN 'text/html' ELSE 'text/plain' END AS content_type,
       'max-age=' || p.h AS cache_control,
       CASE WHEN x.ok THEN x.digest END AS payload_digest, CASE WHEN x.ok THEN x.size END AS n_bytes
FROM p LEFT JOIN (SELECT hit.*, (p2.h <> 7 AND p2.etag = hit.b_etag) AS ok FROM hit JOIN p p2 USING (page_id) WHERE k = 1) x USING (page_id)
"""

ORACLES: dict[str, str] = {"op1_warc_revisits": OP1}
