"""One entry per operator: the Spark query and the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom import schema
from contactloom.functions import domains as D
from contactloom.functions import emails as E
from contactloom.functions import patterns as P
from contactloom.functions import text as X
from contactloom.operators import checks, links, listing, queues, rank, report_state, reports, store
from contactloom.operators.finders import HarvestFinder, Registry, SiteFinder, StaticFinder
from contactloom.operators.guarded import GuardedChecker, GuardedFinder
from contactloom.plans import check as check_plans
from contactloom.plans import discover as discover_plans
from contactloom.plans import find as find_plans
from contactloom.session import new_path, written
from contactloom.sources import results, sinks, tables
from contactloom.streaming import jobs, leases

from . import sqltext as S
from .views import read

AS_OF = "2024-06-01 00:00:00"
STAMP = f"TIMESTAMP '{AS_OF}'"
ARRIVAL = ["method_ord", "seq"]
TITLE_SUFFIX = " - Maps"
METHODS = ["static", "harvester", "scraper"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = S.complete(sql)
        return fn

    return register


def tracked_companies(spark: SparkSession, sf: str) -> DataFrame:
    """Companies in the table layout: methods as lists."""
    raw = read(spark, sf, "companies").withColumn(
        "email_methods_completed", queues.method_list(F.col("email_methods_completed"))
    )
    raw = raw.withColumn("email_methods_used", F.col("email_methods_completed"))
    return schema.conform(raw, schema.COMPANIES).withColumnRenamed("existing_emails", "existing")


def finder_registry(spark: SparkSession, sf: str) -> Registry:
    return Registry(
        StaticFinder(),
        HarvestFinder(read(spark, sf, "result_json")),
        SiteFinder(read(spark, sf, "pages")),
    )


# Sources and sinks


@query(
    "scan_companies_mapped",
    "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS website FROM customer",
)
def _(spark, sf):
    names = {"id": "c_custkey", "name": "c_name", "website": "c_mktsegment"}
    return tables.map_companies(read(spark, sf, "customer"), names)


@query("company_by_id", "SELECT * FROM companies_big WHERE id = 42")
def _(spark, sf):
    return tables.by_id(read(spark, sf, "companies_big"), 42)


def _raw_details(spark, sf) -> DataFrame:
    d = read(spark, sf, "details")
    return d.select(
        "id",
        "search_query",
        listing.detail_name(
            [F.col("head_1"), F.col("head_2")], F.col("page_title"), F.col("fallback"), TITLE_SUFFIX
        ).alias("name"),
        listing.detail_address([F.col("address_1"), F.col("address_2")]).alias("address"),
        listing.detail_phone(
            [("text", F.col("phone_text")), ("link", F.col("phone_link")), ("text", F.col("phone_last"))]
        ).alias("phone"),
        listing.detail_website([F.col("website_1"), F.col("website_2")]).alias("website"),
        listing.detail_rating([F.col("rating_1"), F.col("rating_2")]).alias("rating"),
        listing.review_count([F.col("reviews_label"), F.col("reviews_text")]).alias("review_count"),
        listing.detail_category([F.col("category_1"), F.col("category_2")]).alias("category"),
    )


def _records(spark, sf) -> DataFrame:
    return listing.company_record(_raw_details(spark, sf))


RECORD_EMAIL = (
    f"CASE WHEN website <> 'N/A' THEN {S.clean_email(S.guess_email(S.domain_naive('website')))} ELSE 'N/A' END"
)


@query(
    "append_companies",
    f"SELECT name, address, phone, website, {RECORD_EMAIL} AS email, search_query FROM record",
)
def _(spark, sf):
    path = new_path(spark, "companies")
    sinks.append_companies(_records(spark, sf), path)
    return sinks.read_table(spark, path, schema.COMPANIES).select(*schema.COMPANY_INSERT)


@query(
    "insert_new_emails",
    f"""SELECT company_id, email, source, confidence, found_at AS created_at
FROM ({S.first_wins('candidates', 'method_ord, seq')}) f
WHERE NOT EXISTS (SELECT 1 FROM stored_emails s WHERE s.company_id = f.company_id AND s.email = f.email)""",
)
def _(spark, sf):
    path = new_path(spark, "emails")
    stored = schema.conform(read(spark, sf, "stored_emails"), schema.EMAILS)
    stored.write.parquet(path)
    added = sinks.insert_new_emails(read(spark, sf, "candidates"), path, ARRIVAL)
    return added.select("company_id", "email", "source", "confidence", "created_at")


def _null_columns() -> str:
    kinds = {"boolean": "BOOLEAN", "string": "VARCHAR"}
    present = {"id", "company_id", "email", "source", "confidence", "created_at", "checked_at", "is_reachable", "check_error"}
    return ", ".join(
        f"CAST(NULL AS {kinds[f.dataType.simpleString()]}) AS {f.name}"
        for f in schema.EMAILS.fields
        if f.name not in present
    )


@query("conform_schema", f"SELECT *, {_null_columns()} FROM emails")
def _(spark, sf):
    return schema.conform(read(spark, sf, "emails"), schema.EMAILS)


@query("emails_from_result_json", "SELECT company_id, email FROM result_tokens")
def _(spark, sf):
    return results.emails_from_results(read(spark, sf, "result_json"), ["company_id"])


@query(
    "emails_from_lines",
    f"""SELECT DISTINCT lower({S.strip('line')}) AS email FROM (
  SELECT unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT email FROM candidates) t
WHERE {S.email_basic('line')}""",
)
def _(spark, sf):
    lines = read(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    raw = read(spark, sf, "candidates").select(F.col("email").alias("line"))
    return results.emails_from_lines(lines.unionByName(raw))


@query("parse_existing_emails", "SELECT company_id, email, count(*) AS n FROM existing_rows GROUP BY ALL")
def _(spark, sf):
    rows = results.existing_emails(read(spark, sf, "companies"), "existing_emails")
    return rows.groupBy("company_id", "email").agg(F.count(F.lit(1)).alias("n"))


@query("scan_pages", "SELECT page_id, url, html FROM pages")
def _(spark, sf):
    return tables.pages(read(spark, sf, "pages"))


@query(
    "expand_queries",
    """SELECT id, replace(template, '${country}', n_name) AS query FROM templates, nation
WHERE contains(template, '${country}')
UNION ALL SELECT id, replace(template, '${state}', r_name) FROM templates, region
WHERE contains(template, '${state}') AND NOT contains(template, '${country}')
UNION ALL SELECT id, template FROM templates WHERE NOT contains(template, '${')""",
)
def _(spark, sf):
    countries = tables.settings_values(read(spark, sf, "nation"), "n_name")
    states = tables.settings_values(read(spark, sf, "region"), "r_name")
    return tables.expand_queries(read(spark, sf, "templates"), countries, states).select("id", "query")


# Queues and gates


@query("work_queue_bulk", "SELECT id, name, website FROM bulk_queue")
def _(spark, sf):
    return queues.bulk_queue(tracked_companies(spark, sf), "static").select("id", "name", "website")


@query(
    "needs_method",
    f"""SELECT id, name, website FROM companies
WHERE website <> '' AND NOT {S.done('email_methods_completed', 'scraper')}""",
)
def _(spark, sf):
    return queues.needing_method(tracked_companies(spark, sf), "scraper")


@query(
    "needs_any_method",
    "\nUNION ALL ".join(
        f"""SELECT id, name, website, '{m}' AS needed_method FROM companies
WHERE website <> '' AND NOT {S.done('email_methods_completed', m)}"""
        for m in METHODS
    ),
)
def _(spark, sf):
    return queues.needing_any_method(tracked_companies(spark, sf), METHODS)


@query("unchecked_emails", "SELECT id, company_id, email, source, created_at FROM emails WHERE checked_at IS NULL")
def _(spark, sf):
    return queues.unchecked(read(spark, sf, "emails")).select("id", "company_id", "email", "source", "created_at")


@query("company_emails", "SELECT * FROM emails WHERE company_id = 8")
def _(spark, sf):
    return queues.of_company(read(spark, sf, "emails"), 8)


@query(
    "valid_companies",
    f"SELECT id, website FROM companies WHERE website <> '' AND {S.valid_domain(S.domain_static('website'))}",
)
def _(spark, sf):
    return queues.with_valid_domain(read(spark, sf, "companies")).select("id", "website")


@query(
    "domain_policy",
    f"""SELECT * FROM (
  SELECT id, 'skip' AS mode, {S.domain_strict('website')} AS domain FROM companies
  UNION ALL SELECT id, 'keep', nullif(coalesce({S.domain_strict('website')}, website), '') FROM companies
  UNION ALL SELECT id, 'raw', nullif({S.domain_record('website')}, '') FROM companies) t
WHERE domain IS NOT NULL""",
)
def _(spark, sf):
    c = read(spark, sf, "companies").select("id", "website")
    modes = {"skip": (True, True), "keep": (True, False), "raw": (False, True)}
    parts = [queues.with_domain(c, *m).select("id", F.lit(k).alias("mode"), "domain") for k, m in modes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "selected_methods",
    """SELECT company_id, 'harvester' AS method, email FROM harvest_found
UNION ALL SELECT company_id, 'static', email FROM static_found""",
)
def _(spark, sf):
    registry = finder_registry(spark, sf)
    registry.add(SiteFinder(read(spark, sf, "pages"), enabled=False))
    wanted = ["harvester", "unknown", "static", "scraper"]
    found = find_plans.find_emails(tracked_companies(spark, sf), registry, AS_OF, wanted)
    return found.select("company_id", "method", "email")


def _static(spark, sf, finder: StaticFinder, view: str = "companies_big") -> DataFrame:
    found = finder.find(read(spark, sf, view), AS_OF)
    return found.select("company_id", "seq", "email", "confidence", "source_details")


def _static_sql(*args, **kwargs) -> str:
    rows = S.static_rows("companies_big", *args, **kwargs)
    return f"""SELECT company_id, seq, email, confidence, concat('Static pattern: ', description) AS source_details
FROM ({rows}) s"""


@query(
    "patterns_by_category",
    _static_sql(
        0.0, 26, "p.category IN ('support', 'hr')", "CASE p.category WHEN 'support' THEN 0 ELSE 1 END, p.ord"
    ),
)
def _(spark, sf):
    finder = StaticFinder(0.0, 26, smart=False, categories=("support", "nope", "hr"))
    return _static(spark, sf, finder)


@query("patterns_by_confidence", _static_sql(0.6, 26, "true", "p.position"))
def _(spark, sf):
    return _static(spark, sf, StaticFinder(0.6, 26, smart=False))


@query(
    "patterns_by_name",
    _static_sql(
        0.5, 10, "p.pattern IN ('hr', 'careers', 'info')", "CASE p.pattern WHEN 'careers' THEN 0 ELSE 1 END"
    ),
)
def _(spark, sf):
    return _static(spark, sf, StaticFinder(0.5, 10, smart=False, names=("careers", "nope", "hr", "info")))


OVERRIDES = {"team": 0.99, "it": 0.9, "info": 0.2}
OVERRIDE_SQL = "CASE p.pattern WHEN 'team' THEN 0.99 WHEN 'it' THEN 0.9 WHEN 'info' THEN 0.2 ELSE p.confidence END"


@query(
    "pattern_overrides",
    _static_sql(0.7, 8, S.smart_choice(), "p.ord", f"CAST({OVERRIDE_SQL} AS DOUBLE)"),
)
def _(spark, sf):
    return _static(spark, sf, StaticFinder(confidences=OVERRIDES))


@query(
    "configured_patterns",
    _static_sql(
        0.5, 3, "p.pattern IN ('team', 'info', 'sales', 'it')", "p.ord", f"CAST({OVERRIDE_SQL} AS DOUBLE)"
    ),
)
def _(spark, sf):
    finder = StaticFinder(
        0.5, 3, smart=False, names=("team", "info", "sales", "it"), categories=("legal",), confidences=OVERRIDES
    )
    return _static(spark, sf, finder)


@query(
    "emails_in_domain",
    f"SELECT seq, email FROM candidates WHERE {S.email_domain('email')} = 'u8.example.com'",
)
def _(spark, sf):
    found = store.in_domain(read(spark, sf, "candidates"), "https://www.U8.example.com:80/x")
    return found.select("seq", "email")


# Joins


@query(
    "new_companies",
    """SELECT id, name, search_query FROM (
  SELECT *, row_number() OVER (PARTITION BY search_query, title ORDER BY arrival) AS rn, title AS name FROM listings) t
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM stored_companies s
  WHERE s.name = t.name AND s.search_query = t.search_query)""",
)
def _(spark, sf):
    named = read(spark, sf, "listings").withColumn("name", F.col("title"))
    fresh = store.new_companies(named, read(spark, sf, "stored_companies"), ["arrival"])
    return fresh.select("id", "name", "search_query")


@query(
    "merge_existing_emails",
    """SELECT company_id, email, 'static' AS source, confidence FROM static_found
UNION ALL SELECT company_id, email, 'existing', 0.95 FROM existing_rows e WHERE NOT EXISTS (
  SELECT 1 FROM static_found s WHERE s.company_id = e.company_id AND s.email = e.email)""",
)
def _(spark, sf):
    c = tracked_companies(spark, sf)
    found = StaticFinder().find(c, AS_OF)
    merged = store.merge_existing(found, results.existing_emails(c), "static", 0, AS_OF)
    return merged.select("company_id", "email", "source", "confidence")


@query(
    "match_replies",
    """SELECT e.id, e.company_id, e.email, r.reply FROM emails e
JOIN replies r ON r.company_id = e.company_id AND r.email = e.email""",
)
def _(spark, sf):
    replies = read(spark, sf, "replies").withColumn("email", F.upper("email"))
    matched = store.match_replies(read(spark, sf, "emails"), replies, ["reply"])
    return matched.select("id", "company_id", "email", "reply")


@query(
    "emails_semi_domains",
    f"""SELECT company_id, email FROM result_tokens
WHERE {S.email_domain('email')} IN (SELECT {S.domain_normalized('target')} FROM target_domains)""",
)
def _(spark, sf):
    found = written(results.emails_from_results(read(spark, sf, "result_json"), ["company_id"]), "found")
    return store.in_domains(found, read(spark, sf, "target_domains"))


@query(
    "orphan_emails",
    f"""SELECT id, company_id, email FROM emails WHERE company_id NOT IN (
  SELECT id FROM companies WHERE website <> '' AND {S.valid_domain(S.domain_static('website'))})""",
)
def _(spark, sf):
    kept = queues.with_valid_domain(read(spark, sf, "companies"))
    return store.orphans(read(spark, sf, "emails"), kept).select("id", "company_id", "email")


FLAG_LIST = ", ".join(f"f.{c}" for c in schema.CHECK_FLAGS)
SNAPSHOT_COLUMNS = [
    "company_id", "email", "source", "confidence", "created_at", "is_reachable", "records", *schema.CHECK_FLAGS,
    "check_error", "checked_at",
]


@query(
    "apply_check_results",
    f"""SELECT e.company_id, e.email, e.source, e.confidence, e.created_at,
  CASE WHEN f.id IS NOT NULL AND NOT f.is_error THEN f.is_reachable ELSE e.is_reachable END AS is_reachable,
  f.records, {FLAG_LIST},
  CASE WHEN f.is_error THEN f.check_error ELSE e.check_error END AS check_error,
  CASE WHEN f.id IS NOT NULL THEN {STAMP} ELSE e.checked_at END AS checked_at
FROM emails e LEFT JOIN flat f ON f.id = e.id""",
)
def _(spark, sf):
    emails = schema.conform(read(spark, sf, "emails"), schema.EMAILS)
    flat = checks.flatten_replies(read(spark, sf, "replies"))
    return store.apply_check_results(emails, flat, AS_OF).select(*SNAPSHOT_COLUMNS)


def _tracking_sql(runs: str) -> str:
    return f"""WITH old_methods AS (
  SELECT id, coalesce(CAST(json(email_methods_completed) AS VARCHAR[]), []) AS old FROM companies),
per_method AS (SELECT company_id, method, min(run_no) AS first_used, min(run_no) FILTER (completed) AS first_done
  FROM ({runs}) r GROUP BY ALL),
new_methods AS (SELECT p.company_id,
  coalesce(string_agg(method, ',' ORDER BY first_used) FILTER (NOT contains(o.old, method)), '') AS used,
  coalesce(string_agg(method, ',' ORDER BY first_done)
    FILTER (first_done IS NOT NULL AND NOT contains(o.old, method)), '') AS done
  FROM per_method p JOIN old_methods o ON o.id = p.company_id GROUP BY ALL)
SELECT c.id,
  concat(array_to_string(o.old, ','), CASE WHEN len(o.old) > 0 AND u.used <> '' THEN ',' ELSE '' END, u.used) AS used,
  concat(array_to_string(o.old, ','), CASE WHEN len(o.old) > 0 AND u.done <> '' THEN ',' ELSE '' END, u.done)
    AS completed,
  CASE WHEN u.company_id IS NOT NULL THEN {STAMP} END AS last_email_scan
FROM companies c JOIN old_methods o ON o.id = c.id LEFT JOIN new_methods u ON u.company_id = c.id"""


def _tracking(companies: DataFrame) -> DataFrame:
    return companies.select(
        "id",
        F.array_join("email_methods_used", ",").alias("used"),
        F.array_join("email_methods_completed", ",").alias("completed"),
        "last_email_scan",
    )


@query("update_methods", f"SELECT * FROM ({_tracking_sql('SELECT * FROM runs')}) t")
def _(spark, sf):
    updated = store.update_methods(tracked_companies(spark, sf), read(spark, sf, "runs"), AS_OF)
    return _tracking(updated)


# Finders


@query("static_emails", _static_sql(0.7, 8, S.smart_choice(), "p.ord"))
def _(spark, sf):
    return _static(spark, sf, StaticFinder())


@query(
    "company_categories",
    "SELECT id, concat('general,business', CASE WHEN {technical} THEN ',technical' ELSE '' END, "
    "CASE WHEN {support} THEN ',support' ELSE '' END, CASE WHEN {large} THEN ',hr,marketing' ELSE '' END) "
    "AS categories FROM companies_big".format(**S.flags("name", "website")),
)
def _(spark, sf):
    technical, support, large = P.category_flags(F.col("name"), F.col("website"))
    extra = [F.when(technical, "technical"), F.when(support, "support"), F.when(large, "hr,marketing")]
    return read(spark, sf, "companies_big").select(
        "id", F.concat_ws(",", F.lit("general,business"), *extra).alias("categories")
    )


@query("guess_email", f"SELECT id, {S.guess_email(S.domain_naive('website'))} AS email FROM companies")
def _(spark, sf):
    guess = listing.guess_email(D.domain_naive(F.col("website")))
    return read(spark, sf, "companies").select("id", guess.alias("email"))


@query("harvested_emails", "SELECT company_id, email, domain, 0.8::DOUBLE AS confidence FROM harvest_found")
def _(spark, sf):
    found = HarvestFinder(read(spark, sf, "result_json")).find(tracked_companies(spark, sf), AS_OF)
    return found.select("company_id", "email", F.col("metadata")["domain"].alias("domain"), "confidence")


@query("site_emails", "SELECT company_id, email, domain, 0.9::DOUBLE AS confidence FROM site_found")
def _(spark, sf):
    found = SiteFinder(read(spark, sf, "pages")).find(tracked_companies(spark, sf), AS_OF)
    return found.select("company_id", "email", F.col("metadata")["domain"].alias("domain"), "confidence")


@query(
    "site_pages_in_scope",
    f"""SELECT * FROM (WITH home AS (SELECT DISTINCT {S.domain_strict('website')} AS host,
    regexp_replace(website, '[?#].*$', '') AS url FROM companies
  WHERE {S.domain_strict('website')} IS NOT NULL)
SELECT host, url, 1 AS depth FROM home
UNION ALL SELECT DISTINCT l.host, l.dst, 2 FROM links l JOIN home h ON h.host = l.host AND h.url = l.src
WHERE NOT EXISTS (SELECT 1 FROM home g WHERE g.host = l.host AND g.url = l.dst)) t""",
)
def _(spark, sf):
    seeds = read(spark, sf, "companies").select(F.col("website").alias("url"))
    return links.pages_in_scope(seeds, read(spark, sf, "pages"), depth=2)


@query("page_links", "SELECT host, src, dst FROM links")
def _(spark, sf):
    return links.page_links(read(spark, sf, "pages"))


@query("find_emails", "SELECT company_id, method, method_ord, email, confidence::DOUBLE AS confidence FROM all_found")
def _(spark, sf):
    found = find_plans.find_emails(tracked_companies(spark, sf), finder_registry(spark, sf), AS_OF)
    return found.select("company_id", "method", "method_ord", "email", "confidence")


WORKFLOW_SNAPSHOT = f"""
SELECT company_id, email, source, confidence, is_reachable, check_error FROM stored_emails
UNION ALL
SELECT company_id, email, method, confidence, NULL, NULL FROM ({S.first_wins('all_found', 'method_ord, seq')}) f
WHERE NOT EXISTS (SELECT 1 FROM stored_emails s WHERE s.company_id = f.company_id AND s.email = f.email)"""


@query(
    "complete_workflow",
    f"""SELECT w.company_id, w.email, w.source, CAST(w.confidence AS DOUBLE) AS confidence,
  CASE WHEN f.id IS NOT NULL AND NOT f.is_error THEN f.is_reachable ELSE w.is_reachable END AS is_reachable,
  CASE WHEN f.is_error THEN f.check_error ELSE w.check_error END AS check_error
FROM ({WORKFLOW_SNAPSHOT}) w LEFT JOIN (
  SELECT * FROM flat WHERE (company_id, email) IN (SELECT (company_id, lower(email)) FROM all_found)) f
ON f.company_id = w.company_id AND f.email = w.email""",
)
def _(spark, sf):
    done = find_plans.complete_workflow(
        tracked_companies(spark, sf),
        read(spark, sf, "stored_emails"),
        finder_registry(spark, sf),
        AS_OF,
        replies=read(spark, sf, "replies"),
    )
    return done.emails.select("company_id", "email", "source", "confidence", "is_reachable", "check_error")


@query(
    "workflow_tracking",
    "SELECT * FROM ("
    + _tracking_sql("SELECT company_id, method, true AS completed, method_ord AS run_no FROM all_found")
    + ") t",
)
def _(spark, sf):
    done = find_plans.complete_workflow(
        tracked_companies(spark, sf), read(spark, sf, "stored_emails"), finder_registry(spark, sf), AS_OF
    )
    return _tracking(done.companies)


@query(
    "check_pipeline",
    f"""SELECT e.company_id, e.email, e.source, e.confidence, e.created_at,
  CASE WHEN f.id IS NOT NULL AND NOT f.is_error THEN f.is_reachable ELSE e.is_reachable END AS is_reachable,
  f.records, {FLAG_LIST},
  CASE WHEN f.is_error THEN f.check_error ELSE e.check_error END AS check_error,
  CASE WHEN f.id IS NOT NULL THEN {STAMP} ELSE e.checked_at END AS checked_at
FROM emails e LEFT JOIN flat f ON f.id = e.id AND e.checked_at IS NULL AND e.source = 'scraper'""",
)
def _(spark, sf):
    emails = schema.conform(read(spark, sf, "emails"), schema.EMAILS)
    snapshot = check_plans.check_pipeline(emails, read(spark, sf, "replies"), AS_OF, source="scraper")
    return snapshot.select(*SNAPSHOT_COLUMNS)


@query(
    "bulk_find",
    f"""SELECT company_id, email, source, CAST(confidence AS DOUBLE) AS confidence
FROM ({S.first_wins('bulk_found', 'seq')}) f
WHERE NOT EXISTS (SELECT 1 FROM stored_emails s WHERE s.company_id = f.company_id AND s.email = f.email)""",
)
def _(spark, sf):
    done = find_plans.bulk_find(
        tracked_companies(spark, sf), read(spark, sf, "stored_emails"), StaticFinder(), AS_OF
    )
    return done.added.select("company_id", "email", "source", "confidence")


@query(
    "bulk_tracking",
    "SELECT * FROM ("
    + _tracking_sql("SELECT id AS company_id, 'static' AS method, true AS completed, 0 AS run_no FROM bulk_queue")
    + ") t",
)
def _(spark, sf):
    done = find_plans.bulk_find(
        tracked_companies(spark, sf), read(spark, sf, "stored_emails"), StaticFinder(), AS_OF
    )
    return _tracking(done.companies)


# Listing fields


@query("listing_name", f"SELECT id, {S.listing_name()} AS name FROM listings")
def _(spark, sf):
    name = listing.listing_name(F.col("label"), F.col("href"), F.col("child"))
    return read(spark, sf, "listings").select("id", name.alias("name"))


def _detail(name: str, column: Callable[[], object], sql: str) -> None:
    @query(name, f"SELECT id, {sql} AS value FROM details")
    def _(spark, sf):
        return read(spark, sf, "details").select("id", column().alias("value"))


_detail(
    "detail_name",
    lambda: listing.detail_name(
        [F.col("head_1"), F.col("head_2")], F.col("page_title"), F.col("fallback"), TITLE_SUFFIX
    ),
    S.detail_name(),
)
_detail("detail_address", lambda: listing.detail_address([F.col("address_1"), F.col("address_2")]), S.detail_address())
_detail("detail_website", lambda: listing.detail_website([F.col("website_1"), F.col("website_2")]), S.detail_website())
_detail(
    "detail_phone",
    lambda: listing.detail_phone(
        [("text", F.col("phone_text")), ("link", F.col("phone_link")), ("text", F.col("phone_last"))]
    ),
    S.detail_phone(),
)
_detail("detail_rating", lambda: listing.detail_rating([F.col("rating_1"), F.col("rating_2")]), S.detail_rating())
_detail(
    "detail_reviews",
    lambda: listing.review_count([F.col("reviews_label"), F.col("reviews_text")]),
    S.review_count(),
)
_detail(
    "detail_reviews_fixed",
    lambda: listing.review_count_fixed([F.col("reviews_label"), F.col("reviews_text")]),
    S.review_count_fixed(),
)
_detail(
    "detail_category", lambda: listing.detail_category([F.col("category_1"), F.col("category_2")]), S.detail_category()
)


@query("company_record", f"SELECT *, {RECORD_EMAIL} AS email FROM record")
def _(spark, sf):
    return _records(spark, sf)


@query(
    "cap_per_query",
    """SELECT id, name, search_query FROM (
  SELECT *, row_number() OVER (PARTITION BY search_query ORDER BY arrival) AS pos FROM accepted) t WHERE pos <= 5""",
)
def _(spark, sf):
    name = listing.listing_name(F.col("label"), F.col("href"), F.col("child"))
    named = read(spark, sf, "listings").withColumn("name", name)
    stored = read(spark, sf, "stored_companies")
    return listing.accepted_per_query(named, stored, 5, ["arrival"]).select("id", "name", "search_query")


@query(
    "discover_companies",
    f"""SELECT coalesce(r.name, {S.clean_text('a.name')}) AS name, coalesce(r.address, 'N/A') AS address,
  coalesce(r.phone, 'N/A') AS phone, coalesce(r.website, 'N/A') AS website,
  CASE WHEN r.id IS NULL THEN 'N/A' ELSE {RECORD_EMAIL.replace('website', 'r.website')} END AS email,
  a.search_query FROM (
  SELECT *, row_number() OVER (PARTITION BY search_query ORDER BY arrival) AS pos FROM accepted) a
LEFT JOIN record r ON r.id = a.id WHERE a.pos <= 20""",
)
def _(spark, sf):
    listings, stored = read(spark, sf, "listings"), read(spark, sf, "stored_companies")
    return discover_plans.discover(listings, _raw_details(spark, sf), stored, 20, ["arrival"])


# Scalars


@query("clean_text", f"SELECT doc_id, {S.clean_text('text')} AS value FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.clean_text(F.col("text")).alias("value"))


@query("clean_phone", f"SELECT doc_id, {S.clean_phone('text')} AS value FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.clean_phone(F.col("text")).alias("value"))


@query(
    "clean_email",
    f"""SELECT doc_id AS id, {S.clean_email('text')} AS value FROM documents
UNION ALL SELECT seq, {S.clean_email('email')} FROM candidates""",
)
def _(spark, sf):
    texts = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.clean_email(F.col("text")).alias("value"))
    raw = read(spark, sf, "candidates").select(F.col("seq").alias("id"), X.clean_email(F.col("email")).alias("value"))
    return texts.unionByName(raw)


@query("clean_website", f"SELECT id, {S.clean_website('website')} AS value FROM companies")
def _(spark, sf):
    return read(spark, sf, "companies").select("id", X.clean_website(F.col("website")).alias("value"))


WEBSITES = """(SELECT id, website FROM companies UNION ALL SELECT id, website FROM companies_big
UNION ALL SELECT seq, trim(email) FROM candidates UNION ALL SELECT page_id, upper(url) FROM pages) w"""


def _websites(spark, sf) -> DataFrame:
    parts = [
        read(spark, sf, "companies").select("id", "website"),
        read(spark, sf, "companies_big").select("id", "website"),
        read(spark, sf, "candidates").select(F.col("seq").alias("id"), F.trim("email").alias("website")),
        read(spark, sf, "pages").select(F.col("page_id").alias("id"), F.upper("url").alias("website")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _website_fn(name: str, column, sql: str) -> None:
    @query(name, f"SELECT id, website, {sql} AS value FROM {WEBSITES}")
    def _(spark, sf):
        return _websites(spark, sf).select("id", "website", column(F.col("website")).alias("value"))


_website_fn("domain_record", D.domain_record, S.domain_record("website"))
_website_fn("domain_static", D.domain_static, S.domain_static("website"))
_website_fn("domain_strict", D.domain_strict, S.domain_strict("website"))
_website_fn("domain_normalized", D.domain_normalized, S.domain_normalized("website"))
_website_fn("domain_naive", D.domain_naive, S.domain_naive("website"))
_website_fn(
    "valid_domain", lambda c: D.is_valid_domain(D.domain_static(c)), S.valid_domain(S.domain_static("website"))
)
_website_fn("valid_domain_strict", D.is_valid_domain_strict, f"coalesce({S.valid_domain_strict('website')}, false)")

ADDRESSES = """(SELECT company_id AS id, email FROM candidates UNION ALL
SELECT id, concat(email, '!!') FROM emails UNION ALL SELECT id, replace(email, '@', '@www.') FROM emails UNION ALL
SELECT id, concat('.', email) FROM emails UNION ALL SELECT id, replace(email, '@', '@-') FROM emails UNION ALL
SELECT doc_id, body FROM result_json UNION ALL SELECT id, website FROM companies) a"""


def _addresses(spark, sf) -> DataFrame:
    e = read(spark, sf, "emails")
    email = F.col("email")
    parts = [
        e.select("id", F.concat(email, F.lit("!!")).alias("email")),
        e.select("id", F.replace(email, F.lit("@"), F.lit("@www.")).alias("email")),
        e.select("id", F.concat(F.lit("."), email).alias("email")),
        e.select("id", F.replace(email, F.lit("@"), F.lit("@-")).alias("email")),
        read(spark, sf, "result_json").select(F.col("doc_id").alias("id"), F.col("body").alias("email")),
        read(spark, sf, "companies").select("id", F.col("website").alias("email")),
    ]
    result = read(spark, sf, "candidates").select(F.col("company_id").alias("id"), "email")
    for part in parts:
        result = result.unionByName(part)
    return result


@query(
    "email_validity",
    f"""SELECT id, email, {S.email_prefix('email')} AS prefix_ok, {S.email_basic('email')} AS basic_ok,
  coalesce({S.email_strict('email')}, false) AS strict_ok FROM {ADDRESSES}""",
)
def _(spark, sf):
    c = F.col("email")
    return _addresses(spark, sf).select(
        "id",
        "email",
        E.is_email_prefix(c).alias("prefix_ok"),
        E.is_email_basic(c).alias("basic_ok"),
        E.is_email_strict(c).alias("strict_ok"),
    )


@query("email_domain", f"SELECT id, email, {S.email_domain('email')} AS domain FROM {ADDRESSES}")
def _(spark, sf):
    return _addresses(spark, sf).select("id", "email", E.email_domain(F.col("email")).alias("domain"))


TEXTS = """(SELECT doc_id AS id, 'document' AS kind, text FROM documents UNION ALL
SELECT page_id, 'page', html FROM pages UNION ALL SELECT conv_id * 1000 + turn, 'turn', text FROM conversations
UNION ALL SELECT doc_id, 'result', body FROM result_json) t"""


def _texts(spark, sf) -> DataFrame:
    kinds = [
        (read(spark, sf, "documents"), "doc_id", "document", "text"),
        (read(spark, sf, "pages"), "page_id", "page", "html"),
        (read(spark, sf, "conversations"), "conv_id * 1000 + turn", "turn", "text"),
        (read(spark, sf, "result_json"), "doc_id", "result", "body"),
    ]
    parts = [
        df.select(F.expr(key).alias("id"), F.lit(kind).alias("kind"), F.col(text).alias("text"))
        for df, key, kind, text in kinds
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "extract_emails",
    f"SELECT id, kind, unnest({S.strict_tokens('text')}) AS email FROM {TEXTS}",
)
def _(spark, sf):
    return _texts(spark, sf).select("id", "kind", F.explode(E.extract_emails(F.col("text"))).alias("email"))


@query(
    "emails_to_json",
    f"""SELECT id, kind, CASE WHEN len({S.strict_tokens('text')}) = 0 THEN '[]'
  ELSE concat('["', array_to_string(list_sort({S.strict_tokens('text')}), '", "'), '"]') END AS value FROM {TEXTS}""",
)
def _(spark, sf):
    found = E.emails_to_json(E.extract_emails(F.col("text")))
    return _texts(spark, sf).select("id", "kind", found.alias("value"))


@query(
    "emails_from_json",
    f"""SELECT doc_id, array_to_string(list_sort(list_filter(CAST(json_extract(body, '$.emails') AS VARCHAR[]),
  lambda t: {S.email_strict('t')})), ',') AS value FROM result_json""",
)
def _(spark, sf):
    listed = F.get_json_object("body", "$.emails")
    return read(spark, sf, "result_json").select(
        "doc_id", F.array_join(F.array_sort(E.emails_from_json(listed)), ",").alias("value")
    )


@query(
    "emails_display",
    f"""SELECT id, kind, CASE WHEN n = 0 THEN 'No emails' WHEN n <= 1 THEN array_to_string(found, ', ')
  ELSE concat(found[1], ' ... and ', n - 1, ' more') END AS value FROM (
  SELECT id, kind, list_sort({S.strict_tokens('text')}) AS found, len({S.strict_tokens('text')}) AS n FROM {TEXTS}) d""",
)
def _(spark, sf):
    shown = X.display_list(E.extract_emails(F.col("text")), 1)
    return _texts(spark, sf).select("id", "kind", shown.alias("value"))


@query(
    "safe_name",
    r"""SELECT id, website, coalesce(nullif(regexp_replace(regexp_replace(website, '[<>:"/\\|?*]', '_', 'g'),
  '^[ .]+|[ .]+$', '', 'g'), ''), 'unnamed') AS value FROM """
    + WEBSITES,
)
def _(spark, sf):
    return _websites(spark, sf).select("id", "website", X.safe_name(F.col("website")).alias("value"))


@query(
    "strip_ansi",
    "SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) t "
    "WHERE line <> ''",
)
def _(spark, sf):
    lines = read(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    coloured = F.concat(F.lit("\x1b[1;32m"), F.col("line"), F.lit("\x1b[0m\x1bM"))
    return lines.select("doc_id", X.strip_ansi(coloured).alias("line")).filter("line <> ''")


# Checks


@query("flatten_replies", "SELECT * FROM flat")
def _(spark, sf):
    return checks.flatten_replies(read(spark, sf, "replies")).drop("reply")


@query(
    "reply_error_code",
    """SELECT id, CASE outcome WHEN 'ok' THEN NULL WHEN 'http_error' THEN concat('http_error_', status)
  WHEN 'exception' THEN concat('exception_', detail) ELSE outcome END AS code FROM reply_log""",
)
def _(spark, sf):
    code = checks.failure_code(F.col("outcome"), F.col("status"), F.col("detail"))
    return read(spark, sf, "reply_log").select("id", code.alias("code"))


@query(
    "check_batches",
    """SELECT id, CAST(floor((row_number() OVER (ORDER BY created_at, id) - 1) / 200) AS BIGINT) AS batch_no
FROM emails WHERE checked_at IS NULL""",
)
def _(spark, sf):
    open_ = read(spark, sf, "emails").filter(F.col("checked_at").isNull()).select("id", "created_at")
    return rank.batches(open_, ["created_at", "id"], 200).select("id", "batch_no")


@query(
    "check_budget",
    "SELECT id, email FROM emails WHERE checked_at IS NULL ORDER BY created_at, id LIMIT 100",
)
def _(spark, sf):
    return queues.budget(read(spark, sf, "emails"), 100).select("id", "email")


# Reports


@query(
    "email_stats",
    """SELECT 'total_emails' AS metric, count(*) AS count FROM emails
UNION ALL SELECT 'checked_emails', count(checked_at) FROM emails
UNION ALL SELECT 'unchecked_emails', count(*) - count(checked_at) FROM emails
UNION ALL SELECT 'companies_with_emails', count(DISTINCT company_id) FROM emails
UNION ALL SELECT concat('source:', source), count(*) FROM emails GROUP BY source""",
)
def _(spark, sf):
    return reports.email_stats(read(spark, sf, "emails"))


@query("emails_by_source", "SELECT source, count(*) AS n FROM emails GROUP BY source")
def _(spark, sf):
    return reports.by_source(read(spark, sf, "emails"))


@query(
    "check_stats",
    """SELECT source, count(*) AS total_emails, count(checked_at) AS checked_emails,
  count(*) - count(checked_at) AS unchecked_emails, count(check_error) AS error_emails
FROM emails GROUP BY ROLLUP (source)""",
)
def _(spark, sf):
    return reports.check_stats(read(spark, sf, "emails"))


@query("companies_with_emails", "SELECT count(DISTINCT company_id) AS n_companies FROM emails")
def _(spark, sf):
    return reports.companies_with_emails(read(spark, sf, "emails"))


@query(
    "metric_report",
    """SELECT 'Total Companies' AS metric, count(*) AS count FROM companies
UNION ALL SELECT 'Companies with Websites', count(*) FROM companies WHERE website <> '' AND website <> 'N/A'
UNION ALL SELECT 'Total Emails', count(*) FROM emails
UNION ALL SELECT 'Static Emails', count(*) FROM emails WHERE source = 'static'
UNION ALL SELECT 'Harvester Emails', count(*) FROM emails WHERE source = 'harvester'
UNION ALL SELECT 'Scraper Emails', count(*) FROM emails WHERE source = 'scraper'
UNION ALL SELECT 'Checked Emails', count(*) FROM emails WHERE is_reachable IS NOT NULL""",
)
def _(spark, sf):
    return reports.metric_report(read(spark, sf, "companies"), read(spark, sf, "emails"))


@query(
    "emails_by_domain",
    f"SELECT DISTINCT lower(split_part(email, '@', 2)) AS domain, email FROM bench_candidates WHERE {S.email_strict('email')}",
)
def _(spark, sf):
    return store.domain_members(read(spark, sf, "bench_candidates"))


FOUND_SIZES = """
SELECT d.domain, count(DISTINCT f.email) AS n_emails FROM (SELECT DISTINCT domain FROM company_domains) d
LEFT JOIN site_found f ON f.domain = d.domain GROUP BY d.domain"""


def _found_sizes(spark, sf) -> DataFrame:
    c = tracked_companies(spark, sf)
    processed = queues.with_domain(c.filter(queues.has_website(F.col("website"))))
    found = SiteFinder(read(spark, sf, "pages")).find(c, AS_OF)
    return reports.found_per_domain(processed, found.select(F.col("metadata")["domain"].alias("domain"), "email"))


@query(
    "domain_summary",
    f"""SELECT count(*) AS total_domains, count(*) FILTER (n_emails > 0) AS domains_with_emails,
  CAST(sum(n_emails) AS BIGINT) AS total_emails, round(count(*) FILTER (n_emails > 0) * 100.0 / count(*), 1)::DOUBLE
    AS success_rate FROM ({FOUND_SIZES}) s""",
)
def _(spark, sf):
    return reports.domain_summary(_found_sizes(spark, sf))


@query(
    "top_domains",
    f"""SELECT lower(split_part(email, '@', 2)) AS domain, count(DISTINCT email) AS n_emails FROM bench_candidates
WHERE {S.email_strict('email')} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _(spark, sf):
    return reports.top_domains(reports.domain_sizes(read(spark, sf, "bench_candidates")))


@query(
    "workflow_counters",
    """SELECT c.id AS company_id, count(c2.email) AS emails_found, count(DISTINCT c2.source) AS methods_with_emails,
  'static,harvester,scraper' AS methods_used
FROM companies c LEFT JOIN candidates c2 ON c2.company_id = c.id GROUP BY c.id""",
)
def _(spark, sf):
    found = read(spark, sf, "candidates").withColumnRenamed("source", "method")
    return reports.workflow_counters(read(spark, sf, "companies"), found, METHODS)


@query(
    "workflow_totals",
    """SELECT (SELECT count(*) FROM companies) AS companies_processed,
  (SELECT count(*) FROM all_found) AS total_emails_found,
  (SELECT count(*) FROM all_found WHERE (company_id, lower(email)) IN (
    SELECT (company_id, email) FROM flat WHERE NOT is_error)) AS total_emails_checked""",
)
def _(spark, sf):
    done = find_plans.complete_workflow(
        tracked_companies(spark, sf),
        read(spark, sf, "stored_emails"),
        finder_registry(spark, sf),
        AS_OF,
        replies=read(spark, sf, "replies"),
    )
    return done.totals


@query(
    "run_counts",
    f"""SELECT f.company_id, count(*) FILTER (f.source <> 'existing') AS n_found,
  count(*) FILTER (f.source = 'existing') AS n_existing, coalesce(any_value(a.n), 0) AS n_stored
FROM bulk_found f LEFT JOIN (
  SELECT company_id, count(*) AS n FROM ({S.first_wins('bulk_found', 'seq')}) u
  WHERE NOT EXISTS (SELECT 1 FROM stored_emails s WHERE s.company_id = u.company_id AND s.email = u.email)
  GROUP BY company_id) a ON a.company_id = f.company_id
GROUP BY f.company_id""",
)
def _(spark, sf):
    done = find_plans.bulk_find(
        tracked_companies(spark, sf), read(spark, sf, "stored_emails"), StaticFinder(), AS_OF
    )
    return done.counts


@query("companies_by_query", "SELECT search_query, count(*) AS n FROM companies GROUP BY search_query")
def _(spark, sf):
    return reports.by_query(read(spark, sf, "companies"))


# Dedup, caps, paging


@query(
    "dedupe_first",
    f"""SELECT company_id, email, source, confidence, seq FROM ({S.first_wins('candidates', 'method_ord, seq')}) d""",
)
def _(spark, sf):
    kept = store.dedupe_first(read(spark, sf, "candidates"), ARRIVAL)
    return kept.select("company_id", "email", "source", "confidence", "seq")


@query(
    "dedupe_best",
    f"""SELECT company_id, email, source, confidence, seq
FROM ({S.first_wins('candidates', 'confidence DESC, method_ord, seq')}) d""",
)
def _(spark, sf):
    kept = store.dedupe_first(read(spark, sf, "candidates"), ARRIVAL, keep="best")
    return kept.select("company_id", "email", "source", "confidence", "seq")


@query(
    "dedupe_first_large",
    f"SELECT company_id, email, seq FROM ({S.first_wins('bench_candidates', 'seq')}) d",
)
def _(spark, sf):
    return store.dedupe_first(read(spark, sf, "bench_candidates"), ["seq"]).select("company_id", "email", "seq")


@query(
    "cap_per_group",
    """SELECT source, seq, pos FROM (SELECT source, seq, row_number() OVER (PARTITION BY source ORDER BY found_at, seq)
  AS pos FROM candidates) t WHERE pos <= 100""",
)
def _(spark, sf):
    c = read(spark, sf, "candidates").select("source", "seq", "found_at")
    return rank.top_n_per_group(c, ["source"], ["found_at", "seq"], 100, "pos").select("source", "seq", "pos")


@query(
    "cap_per_group_large",
    """SELECT source, seq, pos FROM (SELECT source, seq, row_number() OVER (PARTITION BY source ORDER BY found_at, seq)
  AS pos FROM candidates) t WHERE pos <= 2000""",
)
def _(spark, sf):
    c = read(spark, sf, "candidates").select("source", "seq", "found_at")
    return rank.top_n_per_group(c, ["source"], ["found_at", "seq"], 2000, "pos").select("source", "seq", "pos")


@query(
    "cap_per_group_desc",
    """SELECT source, seq, pos FROM (SELECT source, seq, row_number() OVER (PARTITION BY source
  ORDER BY found_at DESC, seq DESC) AS pos FROM candidates) t WHERE pos <= 1500""",
)
def _(spark, sf):
    c = read(spark, sf, "candidates").select("source", "seq", "found_at")
    order = [F.desc("found_at"), F.desc("seq")]
    return rank.top_n_per_group(c, ["source"], order, 1500, "pos").select("source", "seq", "pos")


@query("page_companies", "SELECT id, name, website FROM companies_big ORDER BY id LIMIT 50 OFFSET 100")
def _(spark, sf):
    return rank.capped_first(read(spark, sf, "companies_big"), ["id"], 50, 100)


@query(
    "runs_to_expire",
    r"""SELECT path, run_name FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, path) AS pos FROM manifest
  WHERE regexp_matches(run_name, '^\d{4}-\d{2}-\d{2}_\d{6}$')
  AND try_strptime(run_name, '%Y-%m-%d_%H%M%S') IS NOT NULL) t WHERE pos > 30""",
)
def _(spark, sf):
    return reports.runs_to_expire(read(spark, sf, "manifest"), 30).select("path", "run_name")


@query(
    "union_emails",
    "SELECT email FROM candidates UNION SELECT email FROM emails UNION SELECT email FROM bench_candidates",
)
def _(spark, sf):
    names = ("candidates", "emails", "bench_candidates")
    return store.union_emails(*[read(spark, sf, n) for n in names])


# Streams


@query(
    "stream_enrich",
    f"SELECT company_id, email, source, confidence FROM (SELECT *, 'static' AS source FROM "
    f"({S.first_wins('static_found', 'seq')}) f) g",
)
def _(spark, sf):
    arriving = new_path(spark, "arriving-companies")
    companies = read(spark, sf, "companies").select("id", "name", "website")
    companies.write.parquet(arriving)
    target = new_path(spark, "enriched")
    stream = jobs.file_stream(spark, arriving, companies.schema)
    jobs.enrich_into(stream, target, new_path(spark, "progress"), AS_OF)
    return jobs.store_contents(spark, target).select("company_id", "email", "source", "confidence")


@query("stream_dedupe", f"SELECT DISTINCT company_id, {S.strip('lower(email)')} AS email FROM candidates")
def _(spark, sf):
    arriving = new_path(spark, "arriving-found")
    found = read(spark, sf, "candidates")
    # Several files, so several micro-batches repeat pairs of earlier ones.
    found.repartition(3, "source").write.parquet(arriving)
    target = new_path(spark, "deduped")
    stream = jobs.file_stream(spark, arriving, found.schema, most_files=1)
    jobs.dedupe_into(stream, target, new_path(spark, "progress"), ARRIVAL)
    return jobs.store_contents(spark, target).select("company_id", "email")


@query("stream_pending", "SELECT company_id, email, source FROM emails WHERE checked_at IS NULL")
def _(spark, sf):
    arriving = new_path(spark, "arriving-emails")
    emails = read(spark, sf, "emails")
    emails.write.parquet(arriving)
    target = new_path(spark, "pending")
    stream = jobs.file_stream(spark, arriving, emails.schema)
    jobs.poll_into(stream, target, new_path(spark, "progress"))
    return jobs.store_contents(spark, target).select("company_id", "email", "source")


@query(
    "stream_pending_again",
    "SELECT company_id, email, source, 2 AS attempts FROM emails WHERE checked_at IS NULL AND id % 3 = 1",
)
def _(spark, sf):
    """Three rounds: all open addresses, none while they are leased, and after the lease those no check closed."""
    arriving = new_path(spark, "arriving-emails")
    emails = schema.conform(read(spark, sf, "emails"), schema.EMAILS)
    target, progress, rounds = new_path(spark, "leases"), new_path(spark, "progress"), []

    def poll(now: str) -> None:
        stream = jobs.file_stream(spark, arriving, emails.schema)
        leases.poll_with_leases(stream, target, progress, lambda: now, 3600, lambda handed, _: rounds.append(handed), buckets=4)

    emails.write.parquet(arriving)
    poll("2024-06-01 00:00:00")
    emails.limit(0).coalesce(1).write.mode("append").parquet(arriving)
    poll("2024-06-01 00:59:59")
    closed = emails.filter("checked_at IS NULL AND id % 3 <> 1").withColumn("checked_at", schema.instant(AS_OF))
    closed.write.mode("append").parquet(arriving)
    poll("2024-06-01 01:00:00")
    return rounds[-1].select("company_id", "email", "source", "attempts")


# A table that is changed without being rewritten

CHANGED = f"""SELECT e.company_id, e.email, e.source, e.confidence, e.created_at,
  CASE WHEN f.id IS NOT NULL AND NOT f.is_error THEN f.is_reachable ELSE e.is_reachable END AS is_reachable,
  f.records, {FLAG_LIST},
  CASE WHEN f.is_error THEN f.check_error ELSE e.check_error END AS check_error,
  CASE WHEN f.id IS NOT NULL THEN {STAMP} ELSE e.checked_at END AS checked_at
FROM emails e LEFT JOIN flat f ON f.id = e.id AND f.id % 50 IN (7, 8)"""


@query("update_delta", CHANGED)
def _(spark, sf):
    table = sinks.email_table(spark, new_path(spark, "delta-emails"), 8)
    table.insert(schema.conform(read(spark, sf, "emails"), schema.EMAILS))
    flat = checks.flatten_replies(read(spark, sf, "replies"))
    sinks.save_check_results(table, flat.filter("id % 50 = 7"), AS_OF, "checks", 0)
    table.compact(["0", "1"])
    sinks.save_check_results(table, flat.filter("id % 50 IN (7, 8)"), AS_OF, "checks", 1)
    sinks.save_check_results(table, flat, AS_OF, "checks", 1)  # a replay
    return table.rows().select(*SNAPSHOT_COLUMNS)


@query("update_methods_delta", f"SELECT * FROM ({_tracking_sql('SELECT * FROM runs WHERE company_id % 10 = 3')}) t")
def _(spark, sf):
    table = sinks.company_table(spark, new_path(spark, "delta-companies"), 4)
    table.insert(tracked_companies(spark, sf))
    sinks.save_method_runs(table, read(spark, sf, "runs").filter("company_id % 10 = 3"), AS_OF)
    return _tracking(table.rows())


@query("insert_keyed", f"SELECT company_id, email, source FROM ({S.first_wins('candidates', 'method_ord, seq')}) t")
def _(spark, sf):
    """Three writers, of which the last one's batch arrives twice."""
    table = sinks.email_table(spark, new_path(spark, "keyed-emails"), 8)
    found = read(spark, sf, "candidates")
    for ordinal in (0, 1, 2, 2):
        sinks.insert_found(table, found.filter(F.col("method_ord") == ordinal), ARRIVAL, "finders", ordinal)
    return table.rows().select("company_id", "email", "source")


# Check runs in batches


BUDGETED = "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY created_at, id) AS no FROM emails WHERE checked_at IS NULL) q WHERE no <= 100"


@query(
    "check_pipeline_budget",
    f"""SELECT e.company_id, e.email, e.source, e.confidence, e.created_at,
  CASE WHEN f.id IS NOT NULL AND NOT f.is_error THEN f.is_reachable ELSE e.is_reachable END AS is_reachable,
  f.records, {FLAG_LIST},
  CASE WHEN f.is_error THEN f.check_error ELSE e.check_error END AS check_error,
  CASE WHEN f.id IS NOT NULL THEN {STAMP} ELSE e.checked_at END AS checked_at
FROM emails e LEFT JOIN ({BUDGETED}) b ON b.id = e.id LEFT JOIN flat f ON f.id = b.id""",
)
def _(spark, sf):
    emails = schema.conform(read(spark, sf, "emails"), schema.EMAILS)
    run = check_plans.check_run(emails, read(spark, sf, "replies"), AS_OF, batch_size=30, max_requests=100)
    return run.snapshot.select(*SNAPSHOT_COLUMNS)


@query(
    "check_run_batches",
    """SELECT (no - 1) // 40 AS batch_no, count(*) AS n_queued, count(f.id) AS n_answered,
  count(*) FILTER (f.is_error) AS n_errors
FROM (SELECT id, row_number() OVER (ORDER BY created_at, id) AS no FROM emails WHERE checked_at IS NULL) b
LEFT JOIN flat f ON f.id = b.id AND b.id % 5 <> 0 GROUP BY ALL""",
)
def _(spark, sf):
    emails = schema.conform(read(spark, sf, "emails"), schema.EMAILS)
    replies = read(spark, sf, "replies").filter("id % 5 <> 0")
    return check_plans.check_run(emails, replies, AS_OF, batch_size=40).batches


@query(
    "guarded_checker",
    """SELECT company_id, email, CASE WHEN id % 11 <> 0 THEN 'safe' END AS is_reachable,
  CASE WHEN id % 11 = 0 THEN concat('ValueError: no answer for ', email) END AS check_error, id % 11 = 0 AS is_error
FROM emails WHERE checked_at IS NULL""",
)
def _(spark, sf):
    def answer(frame):
        for email, reply in zip(frame["email"], frame["reply"]):
            if reply is None:
                raise ValueError(f"no answer for {email}")
        return frame[["company_id", "email"]].assign(is_reachable="safe")

    open_ = read(spark, sf, "emails").filter("checked_at IS NULL")
    replies = open_.select("company_id", "email", F.when(F.col("id") % 11 != 0, F.lit("ok")).alias("reply"))
    done = GuardedChecker("user", answer).check(open_, replies)
    return done.select("company_id", "email", "is_reachable", "check_error", "is_error")


# Finders of users, odd documents, bounded site visits


@query(
    "guarded_finder",
    """SELECT id AS company_id, CASE WHEN id % 7 <> 0 THEN concat('sales@c', id, '.example.com') END AS email,
  CASE WHEN id % 7 = 0 THEN concat('ValueError: company ', id) END AS error
FROM companies_big""",
)
def _(spark, sf):
    def find(frame):
        if (frame["id"] % 7 == 0).any():
            raise ValueError(f"company {frame['id'].iloc[0]}")
        return frame.assign(company_id=frame["id"], email=[f"sales@c{i}.example.com" for i in frame["id"]], confidence=0.5)

    companies = read(spark, sf, "companies_big")
    finder = GuardedFinder("user", find)
    found = finder.find(companies, AS_OF, 0).select("company_id", "email", F.lit(None).cast("string").alias("error"))
    return found.unionByName(finder.errors(companies).select("company_id", F.lit(None).cast("string").alias("email"), "error"))


@query("emails_from_odd_json", "SELECT company_id, email FROM odd_tokens")
def _(spark, sf):
    return results.emails_from_results(read(spark, sf, "result_json_odd"), ["company_id"])


def _site_sql(reached: str) -> str:
    return f"""SELECT DISTINCT d.company_id, a.email, d.domain FROM company_domains d JOIN (
  SELECT k.host, unnest({S.strict_tokens('k.html')}) AS email FROM page_keys k JOIN {reached} r ON r.host = k.host AND r.key = k.key
) a ON d.domain = a.host"""


def _site(spark, sf, **limits) -> DataFrame:
    found = SiteFinder(read(spark, sf, "pages"), **limits).find(tracked_companies(spark, sf), AS_OF)
    return found.select("company_id", "email", F.col("metadata")["domain"].alias("domain"))


@query("site_emails_depth1", _site_sql("site_roots"))
def _(spark, sf):
    return _site(spark, sf, depth=1)


@query("site_emails_capped", _site_sql("(SELECT * FROM site_reached WHERE place <= 4)"))
def _(spark, sf):
    return _site(spark, sf, depth=2, limit_urls=4)


# Bulk runs of the other methods


def _bulk_sql(method: str, found: str, confidence: str) -> str:
    return f"""SELECT * FROM (WITH queue AS (SELECT * FROM companies WHERE {S.REAL_WEBSITE} AND NOT {S.done('email_methods_completed', method)}),
own AS (SELECT company_id, email FROM {found} WHERE company_id IN (SELECT id FROM queue)),
every AS (SELECT company_id, email, '{method}' AS source, {confidence}::DOUBLE AS confidence, 0 AS seq FROM own
UNION ALL SELECT e.company_id, e.email, 'existing', 0.95, e.place + 1000000 FROM existing_rows e
WHERE e.company_id IN (SELECT id FROM queue) AND NOT EXISTS (
  SELECT 1 FROM own s WHERE s.company_id = e.company_id AND lower(s.email) = lower(e.email)))
SELECT company_id, email, source, confidence FROM ({S.first_wins('every', 'seq')}) f
WHERE NOT EXISTS (SELECT 1 FROM stored_emails s WHERE s.company_id = f.company_id AND s.email = f.email)) t"""


@query("bulk_find_harvester", _bulk_sql("harvester", "harvest_found", "0.8"))
def _(spark, sf):
    finder = HarvestFinder(read(spark, sf, "result_json"))
    done = find_plans.bulk_find(tracked_companies(spark, sf), read(spark, sf, "stored_emails"), finder, AS_OF)
    return done.added.select("company_id", "email", "source", "confidence")


@query("bulk_find_site", _bulk_sql("scraper", "site_found", "0.9"))
def _(spark, sf):
    finder = SiteFinder(read(spark, sf, "pages"))
    done = find_plans.bulk_find(tracked_companies(spark, sf), read(spark, sf, "stored_emails"), finder, AS_OF)
    return done.added.select("company_id", "email", "source", "confidence")


@query(
    "bulk_find_mapped",
    f"""SELECT company_id, email, 'static' AS source, confidence FROM ({S.first_wins(
        '(' + S.static_rows('(SELECT * FROM companies_big WHERE id % 4 <> 1)', 0.7, 8, S.smart_choice(), 'p.ord') + ') m', 'seq')}) f
WHERE NOT EXISTS (SELECT 1 FROM stored_emails s WHERE s.company_id = f.company_id AND s.email = f.email)""",
)
def _(spark, sf):
    big = read(spark, sf, "companies_big").select(
        F.col("id").alias("nr"), F.col("name").alias("firm"), F.col("website").alias("site"),
        F.when(F.col("id") % 4 == 1, '["static"]').alias("done"),
    )
    names = {"id": "nr", "name": "firm", "website": "site", "email_methods_completed": "done"}
    mapped = tables.map_companies(big, names, tracking=True)
    done = find_plans.bulk_find(mapped, read(spark, sf, "stored_emails"), StaticFinder(), AS_OF)
    return done.added.select("company_id", "email", "source", "confidence")


# Shared hosts and carried reports without their rows


@query(
    "site_shared_counts",
    """SELECT f.company_id, count(*) AS n FROM (SELECT DISTINCT company_id, lower(trim(email)) AS email FROM site_found) f
WHERE NOT EXISTS (SELECT 1 FROM site_stored s WHERE s.company_id = f.company_id AND s.email = f.email) GROUP BY ALL""",
)
def _(spark, sf):
    """What a site run would add to a store that holds a part of it, per company, before any row is made."""
    shared = SiteFinder(read(spark, sf, "pages")).shared(tracked_companies(spark, sf))
    stored = shared.expand().filter("company_id % 3 = 0").select("company_id", "email")
    return shared.without(stored).counts()


@query(
    "report_state",
    """SELECT CAST(created_at AS DATE) AS day, source, count(*) AS n_emails, count(checked_at) AS n_checked,
  count(*) FILTER (is_reachable = 'safe') AS n_reachable, count(check_error) AS n_errors FROM emails GROUP BY ALL""",
)
def _(spark, sf):
    """Days are added one after the other; half of the checks come later, as changes."""
    emails = schema.conform(read(spark, sf, "emails"), schema.EMAILS)
    late = F.col("id") % 2 == 0
    early = emails.withColumns(
        {c: F.when(~late, F.col(c)).alias(c) for c in ("checked_at", "is_reachable", "check_error")}
    )
    even = F.dayofyear("created_at") % 2 == 0
    state = report_state.merged(report_state.email_state(early.filter(even)), report_state.email_state(early.filter(~even)))
    state = written(state, "report-state")
    changed = report_state.change_state(early.filter(late), emails.filter(late))
    return report_state.merged(state, changed).select(*report_state.KEY, *report_state.COUNTS)
