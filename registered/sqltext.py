"""SQL building blocks of the checks, written apart from the Spark expressions."""

from __future__ import annotations

import re

from contactloom.functions.patterns import LARGE_WORDS, PATTERN_ROWS, SUPPORT_WORDS, TECHNICAL_WORDS

from .views import VIEWS

WS = (
    r"\t\n\v\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
ALNUM_LABEL = "[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def clean_text(x: str) -> str:
    kept = rf"regexp_replace({x}, '[^\x20-\x7E\x{{A0}}-\x{{FF}}]', '', 'g')"
    return rf"coalesce(nullif(trim(regexp_replace({kept}, '[ \x{{A0}}]+', ' ', 'g')), ''), 'N/A')"


def clean_phone(x: str) -> str:
    kept = rf"regexp_replace({x}, '[^\p{{Nd}}{WS}()+-]', '', 'g')"
    return f"coalesce(nullif(trim(regexp_replace({kept}, '[{WS}]+', ' ', 'g')), ''), 'N/A')"


def clean_email(x: str) -> str:
    kept = rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_.@-]', '', 'g')"
    return f"CASE WHEN contains({kept}, '@') THEN {kept} ELSE 'N/A' END"


def clean_website(x: str) -> str:
    return rf"coalesce(nullif(regexp_replace({x}, '[^\p{{L}}\p{{N}}_./:?=&%-]', '', 'g'), ''), 'N/A')"


def domain_record(x: str) -> str:
    full = f"CASE WHEN starts_with({x}, 'http') THEN {x} ELSE concat('http://', {x}) END"
    host = f"lower(regexp_extract({full}, '^[a-zA-Z0-9+.-]+://([^/?#]*)', 1))"
    return rf"CASE WHEN {x} <> '' THEN regexp_replace({host}, '^www\.', '') END"


def _host(x: str, schemes: str, stop: str) -> str:
    """Scheme, then ``www.``, then everything up to a stop character."""
    bare = f"regexp_replace({x}, '^{schemes}://', '')"
    return rf"regexp_extract(regexp_replace({bare}, '^www\.', ''), '^[^{stop}]*', 0)"


def domain_static(x: str) -> str:
    return f"coalesce({strip('lower(' + _host(x, 'https?', '/?#') + ')')}, '')"


def domain_strict(x: str) -> str:
    host = _host(strip(x), "https?", "/?#")
    return f"CASE WHEN {valid_domain(host)} THEN lower({host}) END"


def domain_normalized(x: str) -> str:
    return f"nullif(lower({_host(strip(x), '(https?|ftps?)', '/?#:')}), '')"


def domain_naive(x: str) -> str:
    return f"split_part(replace(replace({x}, 'http://', ''), 'https://', ''), '/', 1)"


def valid_domain(d: str) -> str:
    return rf"coalesce(regexp_matches({d}, '^{ALNUM_LABEL}(\.{ALNUM_LABEL})+$'), false)"


def valid_domain_strict(x: str) -> str:
    d = domain_normalized(x)
    return rf"({valid_domain(d)} AND length(regexp_extract({d}, '[^.]*$', 0)) >= 2)"


def email_basic(x: str) -> str:
    return rf"coalesce(regexp_matches({strip(x)}, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}$'), false)"


def email_prefix(x: str) -> str:
    return rf"coalesce(regexp_matches({x}, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}'), false)"


def email_strict(x: str) -> str:
    e = f"lower({strip(x)})"
    local, domain = f"split_part({e}, '@', 1)", f"split_part({e}, '@', 2)"
    return (
        f"({email_basic(x)} AND length({local}) <= 64 AND NOT starts_with({local}, '.') "
        f"AND NOT ends_with({local}, '.') AND NOT contains({local}, '..') AND {valid_domain_strict(domain)})"
    )


def email_domain(x: str) -> str:
    return f"CASE WHEN {email_strict(x)} THEN lower(split_part({x}, '@', 2)) END"


TOKEN = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"


def tokens(x: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({x}, '{TOKEN}'), lambda t: lower(t)))"


def strict_tokens(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda t: {email_strict('t')})"


def methods(x: str) -> str:
    return f"coalesce({x}, '[]')"


def done(x: str, method: str) -> str:
    return f"contains(lower({methods(x)}), '\"{method}\"')"


REAL_WEBSITE = "website IS NOT NULL AND website <> '' AND website NOT ILIKE '%n/a%' AND lower(website) <> 'n'"


def _mentions(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def flags(name: str, website: str) -> dict[str, str]:
    text = f"lower(concat({name}, ' ', coalesce({website}, '')))"
    return {
        "technical": _mentions(text, TECHNICAL_WORDS),
        "support": _mentions(text, SUPPORT_WORDS),
        "large": _mentions(text, LARGE_WORDS),
    }


def static_rows(companies: str, minimum: float, k: int, choice: str, ordinal: str, confidence: str = "p.confidence") -> str:
    """Companies times patterns, filtered, ranked, cut to k."""
    domain = domain_static("c.website")
    return f"""
SELECT company_id, email, confidence, description, category, pattern, domain, rn - 1 AS seq FROM (
  SELECT c.id AS company_id, concat(p.pattern, '@', {domain}) AS email, {confidence} AS confidence, p.description,
    p.category, p.pattern, {domain} AS domain,
    row_number() OVER (PARTITION BY c.id ORDER BY {confidence} DESC, {ordinal}) AS rn
  FROM {companies} c, patterns p
  WHERE c.website <> '' AND {valid_domain(domain)} AND {confidence} >= {minimum} AND {choice}) t
WHERE rn <= {k}"""


def smart_choice() -> str:
    f = flags("c.name", "c.website")
    return (
        "(p.category IN ('general', 'business') "
        f"OR (p.category = 'technical' AND {f['technical']}) OR (p.category = 'support' AND {f['support']}) "
        f"OR (p.category IN ('hr', 'marketing') AND {f['large']}))"
    )


def _values() -> str:
    rows = ", ".join(
        f"({i}, {pos}, '{name}', CAST({conf} AS DOUBLE), '{cat}', '{text}')"
        for i, (pos, name, conf, cat, text) in enumerate(PATTERN_ROWS, 1)
    )
    return f"SELECT * FROM (VALUES {rows}) v(ord, position, pattern, confidence, category, description)"


def first_wins(source: str, order: str) -> str:
    """One row per (company_id, stored address)."""
    return f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT * REPLACE ({strip('lower(email)')} AS email),
    row_number() OVER (PARTITION BY company_id, {strip('lower(email)')} ORDER BY {order}) AS rn
  FROM {source}) t WHERE rn = 1"""


def listing_name() -> str:
    lab, child = strip("label"), strip("child")
    part = "regexp_extract(href, '/maps/place/([^/]*)', 1)"
    url = strip(f"url_decode(replace({part}, '+', ' '))")
    pick = (
        f"CASE WHEN lower(label) <> 'results' AND length({lab}) > 1 AND lower({lab}) <> 'results' THEN {lab} "
        f"WHEN length({url}) > 1 AND lower({url}) <> 'results' THEN {url} "
        f"WHEN {child} <> '' AND lower({child}) <> 'results' THEN {child} END"
    )
    cleaned = clean_text(f"({pick})")
    return f"CASE WHEN {cleaned} <> 'N/A' AND lower({cleaned}) <> 'results' AND length({cleaned}) > 1 THEN {cleaned} END"


def _head(x: str) -> str:
    s = strip(x)
    return (
        f"WHEN length({s}) BETWEEN 2 AND 100 AND lower({s}) <> 'results' AND NOT starts_with({s}, 'Results') THEN {s}"
    )


def detail_name() -> str:
    short = strip("replace(page_title, ' - Maps', '')")
    return (
        f"CASE {_head('head_1')} {_head('head_2')} "
        f"WHEN contains(page_title, ' - Maps') AND {short} <> '' AND lower({short}) <> 'results' THEN {short} "
        "WHEN fallback <> '' AND lower(fallback) <> 'results' THEN fallback ELSE 'Unknown Business' END"
    )


def _one_of(fields: list[str], test: str) -> str:
    whens = " ".join(f"WHEN {test.format(x=x)} THEN {strip(x)}" for x in fields)
    return f"CASE {whens} ELSE 'N/A' END"


def detail_address() -> str:
    test = "(contains({x}, 'St') OR contains({x}, 'Ave') OR contains({x}, 'Rd') OR contains({x}, 'Australia'))"
    return _one_of(["address_1", "address_2"], test)


def detail_website() -> str:
    return _one_of(["website_1", "website_2"], "contains({x}, '.') AND NOT starts_with({x}, 'javascript:')")


def detail_phone() -> str:
    has = r"regexp_matches({x}, '[+\p{{Nd}}]')"
    number = "replace(phone_link, 'tel:', '')"
    return (
        f"CASE WHEN {has.format(x='phone_text')} THEN {strip('phone_text')} "
        f"WHEN starts_with(phone_link, 'tel:') THEN {strip(number)} "
        f"WHEN {has.format(x='phone_last')} THEN {strip('phone_last')} ELSE 'N/A' END"
    )


def detail_rating() -> str:
    return _one_of(["rating_1", "rating_2"], "contains({x}, '.') AND length({x}) <= 5")


def review_count() -> str:
    def got(x: str) -> str:
        return rf"nullif(regexp_extract({x}, '(\p{{Nd}}+)[{WS}]*review', 1), '')"

    return f"coalesce({got('reviews_label')}, {got('reviews_text')}, 'N/A')"


def review_count_fixed() -> str:
    def got(x: str) -> str:
        return rf"nullif(regexp_extract({x}, '(\p{{Nd}}+([.,]\p{{Nd}}{{3}})*)[{WS}]*review', 1), '')"

    return f"CAST(replace(replace(coalesce({got('reviews_label')}, {got('reviews_text')}), ',', ''), '.', '') AS BIGINT)"


def detail_category() -> str:
    return _one_of(["category_1", "category_2"], "length({x}) BETWEEN 1 AND 99")


def guess_email(domain: str) -> str:
    cleaned = domain_static(domain)
    return (
        f"CASE WHEN {valid_domain(cleaned)} THEN concat('info@', {cleaned}) "
        rf"WHEN contains({domain}, '.') THEN concat('info@', regexp_replace(lower({domain}), '^www\.', '')) "
        "ELSE 'N/A' END"
    )


def reply_field(path: str, kind: str = "VARCHAR") -> str:
    text = f"json_extract_string(CASE WHEN reply <> '' THEN reply END, '$.{path}')"
    return text if kind == "VARCHAR" else f"CAST({text} AS {kind})"


CHECK_PATHS = {
    "mx_accepts_mail": "mx.accepts_mail",
    "is_disposable": "misc.is_disposable",
    "is_role_account": "misc.is_role_account",
    "is_valid_syntax": "syntax.is_valid_syntax",
    "can_connect_smtp": "smtp.can_connect_smtp",
    "is_deliverable": "smtp.is_deliverable",
    "is_catch_all": "smtp.is_catch_all",
    "has_full_inbox": "smtp.has_full_inbox",
    "is_disabled": "smtp.is_disabled",
}
_FLAGS = ", ".join(f"{reply_field(path, 'BOOLEAN')} AS {name}" for name, path in CHECK_PATHS.items())

HELPERS = {
    "patterns": _values(),
    "flat": f"""
SELECT id, company_id, email, {reply_field('is_reachable')} AS is_reachable,
  CASE WHEN reply <> '' AND {reply_field('error')} IS NULL
    THEN concat('["', array_to_string(CAST(json_extract(reply, '$.mx.records') AS VARCHAR[]), '", "'), '"]')
    END AS records,
  {_FLAGS}, CASE WHEN reply = '' THEN 'no_response' ELSE {reply_field('error')} END AS check_error,
  (reply = '' OR {reply_field('error')} IS NOT NULL) AS is_error
FROM replies""",
    "result_tokens": f"""
SELECT DISTINCT company_id, email FROM (
  SELECT company_id, unnest({tokens('body')}) AS email FROM result_json
  UNION ALL SELECT company_id, lower(unnest(CAST(json_extract(body, '$.emails') AS VARCHAR[]))) FROM result_json
  UNION ALL SELECT company_id, lower(json_extract_string(body, '$.email')) FROM result_json
  UNION ALL SELECT company_id, lower(unnest(json_extract_string(body, '$.people[*].email'))) FROM result_json) t
WHERE {email_basic('email')}""",
    "odd_tokens": f"""
SELECT DISTINCT company_id, email FROM (
  SELECT company_id, unnest({tokens('body')}) AS email FROM result_json_odd WHERE doc_id % 4 <> 3) t
WHERE {email_basic('email')}""",
    "page_keys": f"""
SELECT *, concat(host, regexp_extract(address, '^[^:]+://[^/?#]*(.*)', 1)) AS key FROM (
  SELECT *, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^(https?://[^/]+)$', '\\1/') AS address FROM page_hosts) t
WHERE host IS NOT NULL""",
    "site_roots": """
SELECT host, key FROM (SELECT host, key, row_number() OVER (PARTITION BY host
  ORDER BY len(string_split(key, '/')), length(key), key, url) AS rn FROM page_keys) t WHERE rn = 1""",
    "site_links": f"""
SELECT DISTINCT host, concat(host, regexp_extract(src, '^[^:]+://[^/?#]*(.*)', 1)) AS src,
  concat(host, regexp_extract(regexp_replace(dst, '^(https?://[^/]+)$', '\\1/'), '^[^:]+://[^/?#]*(.*)', 1)) AS dst FROM links""",
    "site_reached": """
SELECT host, key, row_number() OVER (PARTITION BY host ORDER BY depth, key) AS place FROM (
  SELECT host, key, 1 AS depth FROM site_roots
  UNION ALL SELECT DISTINCT r.host, l.dst, 2 FROM site_roots r JOIN site_links l ON l.host = r.host AND l.src = r.key
  WHERE l.dst <> r.key) t""",
    "page_hosts": f"SELECT page_id, url, html, {domain_strict('url')} AS host FROM pages",
    "site_addresses": f"""
SELECT DISTINCT host, email FROM (SELECT host, unnest({strict_tokens('html')}) AS email FROM page_hosts) t""",
    "company_domains": f"""
SELECT id AS company_id, {domain_strict('website')} AS domain FROM companies
WHERE website <> '' AND {domain_strict('website')} IS NOT NULL""",
    "static_found": static_rows("companies", 0.7, 8, smart_choice(), "p.ord"),
    "harvest_found": """
SELECT d.company_id, t.email, d.domain FROM company_domains d JOIN result_tokens t USING (company_id)""",
    "site_found": """
SELECT d.company_id, a.email, d.domain FROM company_domains d JOIN site_addresses a ON d.domain = a.host""",
    "site_stored": "SELECT company_id, lower(trim(email)) AS email FROM site_found WHERE company_id % 3 = 0",
    "all_found": """
SELECT company_id, 'static' AS method, 0 AS method_ord, seq, email, confidence FROM static_found
UNION ALL SELECT company_id, 'harvester', 1, 0, email, 0.8 FROM harvest_found
UNION ALL SELECT company_id, 'scraper', 2, 0, email, 0.9 FROM site_found""",
    "existing_rows": f"""
SELECT id AS company_id, place - 1 AS place, {strip('lower(item)')} AS email FROM (
  SELECT id, unnest(string_split(existing_emails, ',')) AS item,
    unnest(range(1, 1 + len(string_split(existing_emails, ',')))) AS place FROM companies) t
WHERE contains(item, '@')""",
    "bulk_queue": f"SELECT * FROM companies WHERE {REAL_WEBSITE} AND NOT {done('email_methods_completed', 'static')}",
    "bulk_found": """
SELECT company_id, email, 'static' AS source, confidence, seq FROM static_found
WHERE company_id IN (SELECT id FROM bulk_queue)
UNION ALL
SELECT e.company_id, e.email, 'existing', 0.95, e.place + 1000000 FROM existing_rows e
WHERE e.company_id IN (SELECT id FROM bulk_queue) AND NOT EXISTS (
  SELECT 1 FROM static_found s WHERE s.company_id = e.company_id AND lower(s.email) = lower(e.email))""",
    "links": r"""
SELECT DISTINCT host, regexp_replace(url, '[?#].*$', '') AS src,
  regexp_replace(concat(regexp_extract(url, '^[^:]+://[^/?#]*', 0), href), '[?#].*$', '') AS dst
FROM (SELECT host, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM page_hosts) t
WHERE starts_with(href, '/') AND NOT starts_with(href, '//')""",
    "record": f"""
SELECT id, search_query, {clean_text(detail_name())} AS name, {clean_text(detail_address())} AS address,
  {clean_phone(detail_phone())} AS phone, {clean_website(detail_website())} AS website,
  {clean_text(detail_rating())} AS rating, {clean_text(review_count())} AS review_count,
  {clean_text(detail_category())} AS category FROM details""",
    "named_listings": f"SELECT *, {listing_name()} AS name FROM listings",
    "accepted": """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY search_query, name ORDER BY arrival) AS rn
  FROM named_listings WHERE name IS NOT NULL) t
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM stored_companies s
  WHERE s.name = t.name AND s.search_query = t.search_query)""",
}

_ALL = {**VIEWS, **HELPERS}


def complete(body: str) -> str:
    """Put the needed views and helpers in front of a query."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for table in re.finditer(r"\b(?:FROM|JOIN|,)\s+(\w+)", text):
            name = table.group(1)
            if name in _ALL and name not in needed:
                visit(_ALL[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({_ALL[n]})" for n in needed)
    return f"WITH {ctes}\n{body}"

