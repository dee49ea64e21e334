"""Same-site links of archived pages and the pages a bounded site visit reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domains import domain_strict
from ..session import new_path, written
from .rank import top_n_per_group

# A link as pages write it: any case, blanks around the sign, either quote or none.
HREF = r"""(?i)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def page_address(url: Column, ignore_queries: bool = True) -> Column:
    """URL without fragment (and query), with at least ``/`` as path."""
    cut = F.regexp_replace(url, r"(?s)[?#].*\z" if ignore_queries else r"(?s)#.*\z", "")
    return F.regexp_replace(cut, r"^(https?://[^/]+)\z", "$1/")


def site_key(url: Column) -> Column:
    """Host and the rest of an address: one key for every scheme, port, host case and ``www.``."""
    return F.concat(domain_strict(url), F.regexp_extract(url, r"(?s)^[^:]+://[^/?#]*(.*)", 1))


def _without_dot_segments(path: Column) -> Column:
    """``.`` and ``..`` steps resolved; ``path`` starts with a slash."""
    steps = F.split(F.substring(path, 2, 1 << 30), "/")
    trailing = path.rlike(r"/\.{1,2}\z")
    empty = F.array().cast("array<string>")

    def step(done: Column, s: Column) -> Column:
        back = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(s == "..", back).when(s == ".", done).otherwise(F.concat(done, F.array(s)))

    joined = F.array_join(F.aggregate(steps, empty, step), "/")
    resolved = F.concat(F.lit("/"), joined, F.when(trailing & (joined != ""), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"/\.{1,2}(?:/|\z)"), resolved).otherwise(path)


def _base_parts(url: Column) -> Column:
    """What relative links build on: scheme, site, page without query, folder."""
    plain = F.regexp_replace(url, r"(?s)[?#].*\z", "")
    folder = F.coalesce(F.nullif(F.regexp_extract(plain, r"^[^:]+://[^/]*(/.*/|/)", 1), F.lit("")), F.lit("/"))
    return F.struct(
        F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1).alias("scheme"),
        F.regexp_extract(url, r"^[^:]+://[^/?#]*", 0).alias("site"),
        plain.alias("plain"),
        folder.alias("folder"),
    )


def resolve(base: Column, href: Column) -> Column:
    """An href as seen from a page (its ``_base_parts``): absolute, NULL when it is no web link."""
    path = F.regexp_extract(href, r"^[^?#]*", 0)
    rest = F.regexp_extract(href, r"(?s)[?#].*", 0)
    full_site = F.regexp_extract(href, r"^[^:]+://[^/?#]*", 0)
    full_path = F.regexp_extract(href, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    return (
        F.when(href.startswith("/") & ~href.startswith("//"), F.concat(base["site"], _without_dot_segments(path), rest))
        .when(href.rlike(r"^(?i:https?)://"), F.concat(full_site, _without_dot_segments(full_path), rest))
        .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), F.lit(None))
        .when(href.startswith("//"), F.concat(base["scheme"], F.lit(":"), href))
        .when(path == "", F.concat(base["plain"], rest))
        .otherwise(F.concat(base["site"], _without_dot_segments(F.concat(base["folder"], path)), rest))
    )


def page_links(pages: DataFrame, ignore_queries: bool = True) -> DataFrame:
    """Distinct (host, src, dst) links between pages of one host.

    Links are resolved and filtered inside the page's row; only those of the
    same site become rows.
    """
    based = pages.select(
        domain_strict(F.col("url")).alias("host"),
        page_address(F.col("url"), ignore_queries).alias("src"),
        _base_parts(F.col("url")).alias("base"),
        F.regexp_extract_all("html", F.lit(HREF), F.lit(1)).alias("hrefs"),
    )

    def target(href: Column) -> Column:
        bare = F.regexp_replace(href, r"""^["']|["']\z""", "")
        decoded = F.replace(bare, F.lit("&amp;"), F.lit("&"))
        return page_address(resolve(F.col("base"), decoded), ignore_queries)

    same_site = F.filter(
        F.transform(F.array_distinct("hrefs"), target), lambda t: domain_strict(t) == F.col("host")
    )
    return based.select("host", "src", F.explode(F.array_distinct(same_site)).alias("dst")).distinct()


def pages_in_scope(
    seeds: DataFrame,
    pages: DataFrame,
    depth: int = -1,
    limit_urls: int | None = None,
    ignore_queries: bool = True,
    by_site_key: bool = False,
) -> DataFrame:
    """(host, url, depth) reached from the home pages in ``seeds.url``.

    With ``by_site_key`` the addresses are site keys, so a link meets a page
    archived under another scheme or with ``www.``.

    Depth 1 is the home page, 2 adds what it links to, -1 follows links until
    nothing new appears. Every hop is written as one partition of a table, and
    all hops before are read back as that table: plans do not grow with depth,
    and a lost executor costs one hop. A cap keeps the nearest URLs of a host:
    each hop takes what is left of the host's budget, in order of address, and
    hosts without any are walked no further.
    """
    spark = pages.sparkSession
    root = new_path(spark, "scope")
    layout = "host string, url string, depth int"

    def keep(step: DataFrame, depth: int) -> DataFrame:
        path = f"{root}/depth={depth}"
        step.write.parquet(path)
        return spark.read.schema("host string, url string").parquet(path)

    def name(address: Column) -> Column:
        return site_key(address) if by_site_key else address

    home = seeds.select(
        domain_strict(F.col("url")).alias("host"), name(page_address(F.col("url"), ignore_queries)).alias("url")
    )
    home = home.filter(F.col("host").isNotNull()).distinct()
    level = keep(top_n_per_group(home, ["host"], ["url"], limit_urls) if limit_urls else home, 1)
    if depth != 1:
        links = page_links(pages, ignore_queries)
        named = links.select("host", name(F.col("src")).alias("src"), name(F.col("dst")).alias("dst"))
        edges = written(named.distinct() if by_site_key else links, "links")
    hop = 1
    while (depth < 0 or hop < depth) and not level.isEmpty():
        hop += 1
        visited = spark.read.schema(layout).parquet(root).select("host", "url")
        if limit_urls:
            spent = visited.groupBy("host").agg(F.count(F.lit(1)).alias("_spent")).filter(F.col("_spent") < limit_urls)
            level = level.join(spent, "host", "left_semi")
        step = (
            level.join(edges.withColumnRenamed("src", "url"), ["host", "url"])
            .select("host", F.col("dst").alias("url"))
            .distinct()
            .join(visited, ["host", "url"], "left_anti")
        )
        if limit_urls:
            ranked = top_n_per_group(step, ["host"], ["url"], limit_urls, "_rank").join(spent, "host")
            step = ranked.filter(F.col("_rank") <= limit_urls - F.col("_spent")).select("host", "url")
        level = keep(step, hop)
    return spark.read.schema(layout).parquet(root)
