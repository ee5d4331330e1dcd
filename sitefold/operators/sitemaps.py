"""Sitemaps (S6, R4-R7): parse stored sitemap documents, expand indexes depth first, assemble seeds.

Expansion is a fixed number of joins (nesting levels 0..3) between discovered sitemap urls and the
``sitemap_docs`` table; every document carries its position path (array<int>), whose order is the
depth-first document order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefold.functions import urls as U
from sitefold.functions.plan import materialize
from sitefold.functions.text import py_strip

# --- fixed values -----------------------------------------------------------------------------
MAX_SITEMAP_DEPTH = 3
XML_SCHEMA = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>"
# ----------------------------------------------------------------------------------------------

# first element name after the prolog, comments and declarations
ROOT_TAG_RE = "^(?:\\s++|<\\?[^>]*\\?>|<!--.*?-->|<![^>]*>)*<([A-Za-z_][^\\s/>]*)"


def parse_sitemap_docs(docs: DataFrame) -> DataFrame:
    """(sitemap_url, is_index, locs): ``locs`` are the stripped non-null <loc> values of the
    document's <sitemap> children (index) or <url> children (any other root), in order.
    Non-200 replies and malformed XML yield no row."""
    ok = docs.filter(F.col("status") == 200).select("sitemap_url", "xml")
    # namespace prefixes are dropped from tag names so prefixed roots parse like default ones
    plain = F.regexp_replace(F.col("xml"), "<(/?)[A-Za-z_][\\w.-]*:", "<$1")
    df = ok.select("sitemap_url", plain.alias("xml"))
    root = F.regexp_replace(F.regexp_extract(F.col("xml"), "(?s)" + ROOT_TAG_RE, 1), "^.*:", "")
    df = df.select("sitemap_url", root.alias("root"), F.from_xml(F.col("xml"), XML_SCHEMA, {"mode": "PERMISSIVE"}).alias("p"))
    is_index = F.col("root") == "sitemapindex"
    items = F.when(is_index, F.col("p.sitemap")).otherwise(F.col("p.url"))
    locs = F.transform(F.filter(items, lambda x: x["loc"].isNotNull()), lambda x: py_strip(x["loc"]))
    parsed = df.select("sitemap_url", is_index.alias("is_index"), locs.alias("locs"), F.col("root"))
    return parsed.filter(F.col("locs").isNotNull() & (F.col("root") != "")).drop("root")


def sitemap_urls(directives: DataFrame, docs: DataFrame, limits: DataFrame) -> DataFrame:
    """Page urls per site from its robots sitemap directives, depth first, indexes nested up
    to level 3, the first ``max_pages`` of the site's row in ``limits`` kept (null: all).

    A url's number is the count of urls in the sitemap documents before its own plus its place
    there, so only the documents of a site are put in order, never its urls.
    ``directives``: (site, pos, sitemap_url).  Result: (site, seq, url) with seq = 0, 1, ...
    """
    parsed = materialize(parse_sitemap_docs(docs))
    level = directives.select("site", F.array(F.col("pos").cast("int")).alias("path"), "sitemap_url")
    found = []
    for _ in range(MAX_SITEMAP_DEPTH + 1):
        hit = level.join(parsed, "sitemap_url")
        found.append(hit.filter(~F.col("is_index")).select("site", "path", "locs"))
        level = hit.filter(F.col("is_index")).select("site", "path", F.posexplode("locs").alias("i", "sitemap_url"))
        level = level.select("site", F.concat("path", F.array(F.col("i").cast("int"))).alias("path"), "sitemap_url")
    lists = found[0]
    for more in found[1:]:
        lists = lists.unionByName(more)
    lists = materialize(lists)  # read twice, and the joins of all levels are in it
    before = Window.partitionBy("site").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    starts = lists.select("site", "path", F.size("locs").cast("long").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    lists = lists.join(starts.select("site", "path", "start"), ["site", "path"]).join(limits.select("site", F.col("max_pages").alias("_lim")), "site")
    urls = lists.filter(F.col("_lim").isNull() | (F.col("start") < F.col("_lim"))).select("site", "_lim", "start", F.posexplode("locs").alias("i", "url"))
    urls = urls.withColumn("seq", F.col("start") + F.col("i")).filter(F.col("_lim").isNull() | (F.col("seq") < F.col("_lim")))
    return urls.select("site", F.col("seq").cast("int").alias("seq"), "url")


def site_seeds(jobs: DataFrame, directives: DataFrame, docs: DataFrame) -> DataFrame:
    """Crawl seeds per job: site_seeds(site, root_url, pos, url, depth, sitemap_seeded).

    Sites whose robots names a sitemap: its urls (shared limit ``max_pages``), the raw root first
    when no seed normalizes to the root, cut to ``max_pages``; the mode depends on the directives
    alone, so a broken sitemap seeds only the root.  Other sites: the normalized root.
    """
    jobs = U.add_url_parts(jobs.select("site", "root_url", "max_pages"), "root_url", "r")
    jobs = U.drop_url_parts(U.add_normalized(jobs, "r", "norm_root"), "r")
    directives = materialize(directives)
    seeded_sites = directives.select("site").distinct()
    sm = sitemap_urls(directives.join(jobs.select("site"), "site", "left_semi"), docs, jobs)
    sm = U.add_url_parts(sm, "url", "s")
    sm = U.drop_url_parts(U.add_normalized(sm, "s", "norm"), "s")
    sm = materialize(sm.join(jobs, "site").select("site", "seq", "url", "norm"))
    in_list = sm.join(jobs.select("site", "norm_root"), "site").filter(F.col("norm") == F.col("norm_root")).select("site", F.lit(True).alias("listed")).distinct()
    seeded = jobs.join(seeded_sites, "site", "left_semi").join(in_list, "site", "left").withColumn("shift", F.when(F.col("listed"), 0).otherwise(1))
    # a root that no sitemap lists comes first, the urls behind it
    root_rows = seeded.filter(F.col("shift") == 1).select("site", "root_url", "max_pages", F.lit(0).alias("pos"), F.col("root_url").alias("url"))
    both = sm.join(seeded.select("site", "root_url", "max_pages", "shift"), "site") \
        .select("site", "root_url", "max_pages", (F.col("seq") + F.col("shift")).alias("pos"), "url").unionByName(root_rows)
    both = both.filter(F.col("max_pages").isNull() | (F.col("pos") < F.col("max_pages")))
    sitemap_seeds = both.select("site", "root_url", F.col("pos").cast("int").alias("pos"), "url",
                                F.lit(0).alias("depth"), F.lit(True).alias("sitemap_seeded"))
    bfs = jobs.join(seeded_sites, "site", "left_anti").select(
        "site", "root_url", F.lit(0).alias("pos"), F.col("norm_root").alias("url"), F.lit(0).alias("depth"),
        F.lit(False).alias("sitemap_seeded"))
    return materialize(sitemap_seeds.unionByName(bfs))
