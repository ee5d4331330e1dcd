"""Inputs the test tables lack, derived from ``pages`` by fixed rules.

Everything here is a deterministic function of the given tables, so its size grows with them and
the DuckDB oracle can rebuild the same rows.  The live-fetch parts of the reference (robots.txt,
sitemaps, HTTP attempts, link graph) are replaced by these stored tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitefold.functions import urls as U
from sitefold.functions.plan import chunked_row_number, materialize
from sitefold.sources.tables import read_table, table_path

# --- fixed values -----------------------------------------------------------------------------
# Our crawler's user agent (a parameter of every robots operator; this is only the default).
DEFAULT_AGENT = "sitefold/1.0"
AGENT_TOKEN = "sitefold"
RETRY_AFTER_DATE = "Wed, 21 Oct 2015 07:28:00 GMT"
OFFSITE_HOST = "offsite.example.com"
SITEMAP_CHUNK = 1000
MENU_POS = 1 << 20  # a menu's links come after those of the page
# ----------------------------------------------------------------------------------------------


_BUILT: dict = {}


def _stamp(spark: SparkSession, path: str) -> tuple:
    """Size and time of the files of a table: a changed input is another table."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in at.getFileSystem(conf).listStatus(at)))


def _once(fn):
    """Derived tables stand in for stored tables: each is written once per session and state of the
    input files, then read."""

    def wrapper(spark: SparkSession, sf_dir: str, *args, **kwargs):
        key = (spark.sparkContext.applicationId, fn.__name__, _stamp(spark, table_path(sf_dir, "pages")), args, tuple(sorted(kwargs.items())))
        if key not in _BUILT:
            _BUILT[key] = fn(spark, sf_dir, *args, **kwargs)
        return _BUILT[key]

    wrapper.__name__, wrapper.__doc__ = fn.__name__, fn.__doc__
    return wrapper


@_once
def ranked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with site and normalized url, one row per (site, norm_url) (lowest page_id), ranked
    ``n`` = 1, 2, ... by page_id within the site."""
    df = U.add_url_parts(read_table(spark, sf_dir, "pages", ["page_id", "url"]), "url", "u")
    df = U.add_normalized(df.withColumn("site", U.site_of("u")), "u", "norm_url")
    # lowest page_id per (site, normalized url): a partial aggregation, so a url repeated across
    # many rows is combined map-side
    df = U.drop_url_parts(df, "u").groupBy("site", "norm_url").agg(F.min("page_id").alias("page_id"), F.min_by("url", "page_id").alias("url"))
    return materialize(chunked_row_number(df.select("page_id", "url", "site", "norm_url"), ["site"], "page_id", "n"))


@_once
def robots_table(spark: SparkSession, sf_dir: str, agent_token: str = AGENT_TOKEN) -> DataFrame:
    """robots(site, status, text): one of four texts per host, chosen by length(host) % 4."""
    sites = ranked_pages(spark, sf_dir).select("site").distinct()
    k = F.length("site") % 4
    sm = F.concat(F.lit("https://"), F.col("site"), F.lit("/sitemap_index.xml"))
    text1 = F.lit("User-agent: *\nDisallow: /de/\n")
    text2 = F.concat(
        F.lit(f"# rules for {agent_token}\nUser-agent: {agent_token}\nDisallow: /fr/\nCrawl-delay: 2\n\n"
              "User-agent: *\nDisallow: /\n\nSitemap: "), sm, F.lit("\n"))
    text3 = F.concat(
        F.lit("User-agent: *\nAllow: /en/\nDisallow: /en\nDisallow: /es/\nDisallow:\n\nsitemap: "), sm,
        F.lit("\nSitemap: https://"), F.col("site"), F.lit("/missing.xml\n"))
    return materialize(sites.select(
        "site",
        F.when(k == 0, F.lit(404)).otherwise(F.lit(200)).cast("int").alias("status"),
        F.when(k == 1, text1).when(k == 2, text2).when(k == 3, text3).alias("text"),
    ))


def _xml_escape(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@_once
def sitemap_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sitemap_docs(sitemap_url, status, xml): for hosts whose robots names a sitemap, an index of
    sub-indexes of child sitemaps; child ``c`` = 2 * floor((n-1)/1000) + n % 2 lists its pages in
    rank order, so no urlset exceeds 500 urls and no sub-index 1000 children.  ``missing.xml`` has
    no row (not found)."""
    robots = robots_table(spark, sf_dir).filter(F.length("site") % 4 >= 2).select("site")
    pages = ranked_pages(spark, sf_dir).join(robots, "site", "left_semi")
    pages = pages.withColumn("c", (F.floor((F.col("n") - 1) / SITEMAP_CHUNK) * 2 + F.col("n") % 2).cast("long"))
    child_url = F.concat(F.lit("https://"), F.col("site"), F.lit("/sitemap-"), F.col("c").cast("string"), F.lit(".xml"))
    children = pages.groupBy("site", "c").agg(F.sort_array(F.collect_list(F.struct("n", "url"))).alias("u"))
    children = children.select(
        "site", "c", child_url.alias("sitemap_url"),
        F.concat(
            F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
            F.array_join(F.transform("u", lambda x: F.concat(F.lit("<url><loc>"), _xml_escape(x["url"]), F.lit("</loc></url>"))), ""),
            F.lit("</urlset>"),
        ).alias("xml"),
    )
    def index_doc(entries: str):
        return F.concat(
            F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
            F.array_join(F.transform(entries, lambda x: F.concat(F.lit("<sitemap><loc>"), x["u"], F.lit("</loc></sitemap>"))), ""),
            F.lit("</sitemapindex>"),
        )

    # two index levels: sub-index g lists children g*1000 .. g*1000+999, the top index lists the
    # sub-indexes; every document stays small and the depth-first order is child order
    subs = children.withColumn("g", F.floor(F.col("c") / SITEMAP_CHUNK).cast("long")).groupBy("site", "g").agg(
        F.sort_array(F.collect_list(F.struct(F.col("c").alias("k"), F.col("sitemap_url").alias("u")))).alias("s"))
    subs = subs.withColumn("sub_url", F.concat(F.lit("https://"), F.col("site"), F.lit("/sitemap-index-"), F.col("g").cast("string"), F.lit(".xml")))
    sub_docs = subs.select(F.col("sub_url").alias("sitemap_url"), index_doc("s").alias("xml"))
    top = subs.groupBy("site").agg(F.sort_array(F.collect_list(F.struct(F.col("g").alias("k"), F.col("sub_url").alias("u")))).alias("s"))
    top_docs = top.select(F.concat(F.lit("https://"), F.col("site"), F.lit("/sitemap_index.xml")).alias("sitemap_url"), index_doc("s").alias("xml"))
    out = children.select("sitemap_url", "xml").unionByName(sub_docs).unionByName(top_docs)
    return materialize(out.select("sitemap_url", F.lit(200).cast("int").alias("status"), "xml"))


def fetch_attempts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fetch_attempts(norm_url, attempt, status, content_type, retry_after, error_kind, error_text,
    body): three stored attempts per page; code = (page_id * 7 + attempt) % 11 picks the reply.
    ``body`` is the id of the page whose html was the reply."""
    pages = ranked_pages(spark, sf_dir)
    df = pages.select("norm_url", "page_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("attempt"))
    code = (F.col("page_id") * 7 + F.col("attempt")) % 11
    pid = F.col("page_id")
    status = (F.when(code <= 6, 200).when(code == 7, 404).when(code == 8, 429).when(code == 9, 503)
              .when((code == 10) & (pid % 2 == 0), 304))
    ctype = (F.when((code == 0) & (pid % 13 == 0), F.lit(None).cast("string"))
             .when(code <= 5, F.lit("text/html; charset=utf-8")).when(code == 6, F.lit("application/pdf")))
    retry_after = F.when(code == 8, F.when(pid % 3 == 0, F.lit("2")).when(pid % 3 == 2, F.lit(RETRY_AFTER_DATE)))
    kind = F.when(code == 10, F.when(pid % 2 == 0, F.lit(None)).when(pid % 4 == 1, F.lit("timeout")).otherwise(F.lit("other")))
    error_text = F.when(kind == "timeout", F.lit("read timed out")).when(kind == "other", F.lit("connection reset by peer"))
    return df.select(
        "norm_url", F.col("attempt").cast("int").alias("attempt"), status.cast("int").alias("status"),
        ctype.alias("content_type"), retry_after.alias("retry_after"), kind.alias("error_kind"), error_text.alias("error_text"),
        F.when((status == 200) & (code <= 5), pid).alias("body"),
    )


@_once
def edges_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(site, src_norm, pos, dst_url, dst_norm): page n of a host links to n*2, n*2+1 and n-1
    (when they exist), every fifth page also off-site, every sixth page also to a .pdf."""
    pages = ranked_pages(spark, sf_dir).select("site", "n", "url", "norm_url")
    targets = pages.select(
        "site", "n", "norm_url",
        F.explode(F.array(
            F.struct(F.lit(0).alias("pos"), (F.col("n") * 2).alias("t")),
            F.struct(F.lit(1).alias("pos"), (F.col("n") * 2 + 1).alias("t")),
            F.struct(F.lit(2).alias("pos"), (F.col("n") - 1).alias("t")),
        )).alias("e"),
    ).select("site", F.col("norm_url").alias("src_norm"), F.col("e.pos").alias("pos"), F.col("e.t").alias("t"))
    dst = pages.select("site", F.col("n").alias("t"), F.col("url").alias("dst_url"), F.col("norm_url").alias("dst_norm"))
    inner = targets.join(dst, ["site", "t"]).drop("t")
    extra = pages.select(
        "site", F.col("norm_url").alias("src_norm"),
        F.explode(F.array(
            F.when(F.col("n") % 5 == 0, F.struct(F.lit(3).alias("pos"),
                                                 F.concat(F.lit(f"https://{OFFSITE_HOST}/p"), F.col("n").cast("string")).alias("u"))),
            F.when(F.col("n") % 6 == 0, F.struct(F.lit(4).alias("pos"),
                                                 F.concat(F.lit("https://"), F.col("site"), F.lit("/files/"), F.col("n").cast("string"), F.lit(".pdf")).alias("u"))),
        )).alias("e"),
    ).filter(F.col("e").isNotNull()).select("site", "src_norm", F.col("e.pos").alias("pos"), F.col("e.u").alias("dst_url"))
    extra = U.add_url_parts(extra, "dst_url", "d")
    extra = U.drop_url_parts(U.add_normalized(extra, "d", "dst_norm"), "d")
    return materialize(inner.unionByName(extra).select("site", "src_norm", F.col("pos").cast("int").alias("pos"), "dst_url", "dst_norm"))


def link_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """link_pages(page_id, url, html): for each ranked page a menu, html with an anchor for each of its
    ``edges`` (five at most), so that there are pages whose extracted links lead to other pages."""
    anchor = F.concat(F.lit('<a href="'), F.replace(F.col("dst_url"), F.lit("&"), F.lit("&amp;")), F.lit('">'), F.col("pos").cast("string"), F.lit("</a>"))
    menus = edges_table(spark, sf_dir).groupBy("site", F.col("src_norm").alias("norm_url")).agg(
        F.sort_array(F.collect_list(F.struct("pos", anchor.alias("a")))).alias("m"))
    html = F.concat(F.lit("<nav>"), F.array_join(F.transform("m", lambda x: x["a"]), ""), F.lit("</nav>"))
    return ranked_pages(spark, sf_dir).join(menus, ["site", "norm_url"]).select("page_id", "url", html.alias("html"))


def crawl_jobs_table(spark: SparkSession, sf_dir: str, max_pages: int | None = 50, max_depth: int = 3) -> DataFrame:
    """crawl_jobs(site, root_url, max_pages, max_depth): one crawl per host from its first page."""
    first = ranked_pages(spark, sf_dir).filter(F.col("n") == 1)
    return first.select("site", F.col("url").alias("root_url"), F.lit(max_pages).cast("int").alias("max_pages"),
                        F.lit(max_depth).cast("int").alias("max_depth"))
