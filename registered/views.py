"""Input tables of the queries, derived from the driver's tables by plain SQL.

The texts run unchanged on Spark and on the checking database.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS = {
    "companies": """
SELECT page_id AS id, regexp_extract(html, '<title>(.*?)</title>', 1) AS name,
  nullif(regexp_extract(html, '[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}', 0), '') AS phone,
  CASE page_id % 20 WHEN 17 THEN 'n/a' WHEN 18 THEN '' WHEN 19 THEN CAST(NULL AS VARCHAR(9)) ELSE url END AS website,
  concat('pages in ', regexp_extract(html, '<html lang="([a-z]+)"', 1)) AS search_query,
  CASE page_id % 4 WHEN 0 THEN CAST(NULL AS VARCHAR(9)) WHEN 1 THEN '[]' WHEN 2 THEN '["static"]'
    ELSE '["static", "scraper"]' END AS email_methods_completed,
  CASE WHEN page_id % 5 = 0 THEN concat(' INFO@', regexp_extract(url, '^https?://([^/?#]+)', 1), ', bad, ,ceo@',
    regexp_extract(url, '^https?://([^/?#]+)', 1)) END AS existing_emails
FROM pages""",
    "companies_big": """
SELECT c_custkey AS id,
  concat(c_name, CASE c_custkey % 6 WHEN 0 THEN ' Tech' WHEN 1 THEN ' Solutions' WHEN 2 THEN ' Group'
    WHEN 3 THEN ' Inc' WHEN 4 THEN ' Services' ELSE '' END) AS name,
  CASE c_custkey % 3 WHEN 0 THEN concat('https://www.c', c_custkey, '.example.com/about')
    WHEN 1 THEN concat('c', c_custkey, '.example.net') ELSE concat('http://C', c_custkey, '.Example.org') END AS website
FROM customer""",
    "candidates": """
SELECT user_id AS company_id,
  concat(CASE WHEN event_id % 5 = 0 THEN ' ' ELSE '' END,
    CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END, '@u', user_id, '.example.com') AS email,
  CASE event_id % 3 WHEN 0 THEN 'static' WHEN 1 THEN 'harvester' ELSE 'scraper' END AS source,
  CAST(event_id % 3 AS INT) AS method_ord, event_id AS seq,
  CAST(event_id % 100 AS DOUBLE) / 100 AS confidence, ts AS found_at
FROM events""",
    "emails": """
SELECT seq AS id, company_id, lower(trim(email)) AS email, source, confidence, found_at AS created_at,
  CASE WHEN seq % 3 = 0 THEN found_at END AS checked_at,
  CASE WHEN seq % 3 = 0 AND seq % 9 <> 0 THEN CASE WHEN seq % 2 = 0 THEN 'safe' ELSE 'risky' END END AS is_reachable,
  CASE WHEN seq % 9 = 0 THEN 'timeout' END AS check_error
FROM (SELECT *, row_number() OVER (PARTITION BY company_id, lower(trim(email)) ORDER BY seq) AS rn
  FROM candidates) t
WHERE rn = 1""",
    "stored_emails": "SELECT * FROM emails WHERE source = 'static'",
    "stored_companies": "SELECT * FROM companies WHERE email_methods_completed IS NOT NULL",
    "replies": """
SELECT id, company_id, email,
  CASE WHEN id % 7 = 0 THEN '{"error": "timeout"}' WHEN id % 7 = 1 THEN ''
    ELSE concat('{"is_reachable": "', CASE WHEN id % 2 = 0 THEN 'safe' ELSE 'risky' END,
      '", "mx": {"accepts_mail": true, "records": ["mx', company_id, '.example.com.", "mx2.example.com."]}, ',
      '"misc": {"is_disposable": false, "is_role_account": ',
      CASE WHEN id % 3 = 0 THEN 'true' ELSE 'false' END,
      '}, "syntax": {"is_valid_syntax": true}, "smtp": {"can_connect_smtp": true, "is_deliverable": true, ',
      '"is_catch_all": false, "has_full_inbox": false, "is_disabled": false}}') END AS reply
FROM emails""",
    "reply_log": """
SELECT event_id AS id, user_id AS company_id,
  CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'timeout' WHEN 'signup' THEN 'http_error'
    WHEN 'error' THEN 'connection_error'
    ELSE CASE event_id % 3 WHEN 0 THEN 'request_exception' WHEN 1 THEN 'json_decode_error' ELSE 'exception' END
  END AS outcome,
  400 + event_id % 200 AS status, CASE WHEN event_id % 2 = 0 THEN 'KeyError' ELSE 'ValueError' END AS detail
FROM events""",
    "result_json": """
SELECT event_id AS doc_id, user_id AS company_id,
  concat('{"emails": ["', event_type, '@U', user_id, '.example.com", "bad"], "people": [{"email": "p', event_id,
    '@x.example.org"}], "email": "a..b@c.com"}') AS body
FROM events""",
    "result_json_odd": """
SELECT event_id AS doc_id, user_id AS company_id,
  CASE event_id % 4
    WHEN 0 THEN concat('[{"score": NaN, "email": "n', event_id, '@nan.example.com"}, -Infinity]')
    WHEN 1 THEN concat('["', event_type, '@list', user_id, '.example.com", ["deep', event_id, '@x.example.org"]] ')
    WHEN 2 THEN concat('{"email": "first', event_id, '@twice.example.com", "email": "second@twice.example.com", "x": Infinity}')
    ELSE concat('["broken@b', event_id, '.example.com", NaN') END AS body
FROM events""",
    "bench_candidates": """
SELECT l_partkey AS company_id, concat('s', l_suppkey, '@p', l_partkey, '.example.com') AS email,
  l_orderkey * 10 + l_linenumber AS seq, l_shipdate AS found_at
FROM lineitem""",
    "runs": """
SELECT company_id, source AS method, confidence > 0.5 AS completed, seq AS run_no FROM candidates""",
    "target_domains": """
SELECT concat('https://www.U', user_id, '.example.com/x?y') AS target FROM events
WHERE event_type = 'signup'""",
    "listings": """
SELECT page_id AS id, page_id AS arrival, search_query, title, url,
  CASE page_id % 4 WHEN 0 THEN 'Results' WHEN 1 THEN CAST(NULL AS VARCHAR(9)) WHEN 2 THEN concat('  ', title, ' ')
    ELSE title END AS label,
  CASE page_id % 3 WHEN 0 THEN concat('https://maps.example.org/maps/place/',
      replace(replace(title, '%', '%25'), ' ', '+'), '/data')
    WHEN 1 THEN concat('/maps/place/Results/', page_id) ELSE url END AS href,
  h1 AS child
FROM (SELECT page_id, url, concat('pages in ', regexp_extract(html, '<html lang="([a-z]+)"', 1)) AS search_query,
    regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS h1
  FROM pages) t""",
    "details": """
SELECT page_id AS id, search_query,
  CASE page_id % 3 WHEN 0 THEN concat('Results for ', h1) WHEN 1 THEN concat(' ', h1, ' ') ELSE 'R' END AS head_1,
  CASE page_id % 5 WHEN 0 THEN bold WHEN 1 THEN 'results' ELSE CAST(NULL AS VARCHAR(9)) END AS head_2,
  CASE WHEN page_id % 2 = 0 THEN concat(title, ' - Maps') ELSE title END AS page_title,
  CASE WHEN page_id % 7 = 0 THEN 'Results' ELSE title END AS fallback,
  CASE page_id % 3 WHEN 0 THEN CAST(NULL AS VARCHAR(9)) WHEN 1 THEN concat(page_id, ' Main Street ') ELSE 'nowhere'
    END AS address_1,
  para AS address_2,
  CASE page_id % 4 WHEN 0 THEN 'javascript:void.x' WHEN 1 THEN CAST(NULL AS VARCHAR(9)) WHEN 2 THEN concat(' ', url)
    ELSE 'none' END AS website_1,
  CASE WHEN page_id % 6 = 0 THEN CAST(NULL AS VARCHAR(9)) ELSE url END AS website_2,
  CASE page_id % 3 WHEN 0 THEN CAST(NULL AS VARCHAR(9)) WHEN 1 THEN 'call us' ELSE concat('Phone: +61 ', page_id)
    END AS phone_text,
  CASE page_id % 4 WHEN 0 THEN concat('tel: +49-30-', page_id) WHEN 1 THEN 'mailto:x' ELSE CAST(NULL AS VARCHAR(9))
    END AS phone_link,
  para AS phone_last,
  CASE page_id % 3 WHEN 0 THEN 'five stars' WHEN 1 THEN concat('4.', page_id % 10, ' ')
    ELSE 'rated 4.5 of 5' END AS rating_1,
  CASE WHEN page_id % 2 = 0 THEN '3.9' END AS rating_2,
  CASE page_id % 4 WHEN 0 THEN concat(page_id, ' reviews') WHEN 1 THEN concat('1,', 100 + page_id % 900, ' reviews')
    ELSE CAST(NULL AS VARCHAR(9)) END AS reviews_label,
  CASE page_id % 3 WHEN 0 THEN concat('(', page_id * 7, '   reviews)') WHEN 1 THEN 'Reviews' ELSE para END
    AS reviews_text,
  CASE WHEN page_id % 2 = 0 THEN title ELSE '' END AS category_1, bold AS category_2
FROM (SELECT page_id, url, concat('pages in ', regexp_extract(html, '<html lang="([a-z]+)"', 1)) AS search_query,
    regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS h1,
    regexp_extract(html, '<b>([^<]*)', 1) AS bold, regexp_extract(html, '<p>([^<]*)</p>', 1) AS para
  FROM pages) t
WHERE page_id % 9 <> 4""",
    "templates": """
SELECT p_partkey AS id, CASE p_partkey % 4
  WHEN 0 THEN concat(p_type, ' makers in ', '$', '{country}')
  WHEN 1 THEN concat(p_name, ' in ', '$', '{state}')
  WHEN 2 THEN concat(p_name, ' in ', '$', '{state}', ' of ', '$', '{country}')
  ELSE p_name END AS template
FROM part""",
    "manifest": """
SELECT concat('logs/', event_id) AS path,
  CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN '2024-02-30_101010'
    ELSE concat(substring(CAST(ts AS VARCHAR(30)), 1, 10), '_',
      replace(substring(CAST(ts AS VARCHAR(30)), 12, 8), ':', '')) END AS run_name,
  ts AS created_at
FROM events""",
}

_TABLE = re.compile(r"\b(FROM|JOIN) (" + "|".join([*BASE, *VIEWS]) + r")\b")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a view over driver tables."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    inputs = {m.group(2): read(spark, sf_dir, m.group(2)) for m in _TABLE.finditer(text)}
    return spark.sql(_TABLE.sub(r"\1 {\2}", text), **inputs)
