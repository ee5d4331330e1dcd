"""Page metadata (E0-E5) and link extraction (E6) over a pages snapshot.

Both are map-only projections over the parquet scan: no shuffle, and the large ``html`` column is
read by these two operators only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.functions import urls as U
from sitefold.functions.html import add_html_fields, anchor_hrefs, clean_html
from sitefold.functions.plan import fenced_filter
from sitefold.functions.text import py_strip

META_COLUMNS = ["site", "page_ord", "url", "norm_url", "path_prefix", "title", "description", "h1", "depth",
                "has_description"]


def page_meta(pages: DataFrame, order_col: str = "page_id", depth_col: str | None = None) -> DataFrame:
    """One metadata row per page.

    ``pages`` needs ``url`` and ``html``; ``order_col`` becomes ``page_ord`` (crawl order) and
    ``depth_col`` the crawl depth (0 when absent).  Description = meta description, else (only
    when an h1 exists) the first paragraph after the h1 start, cut to 200 characters, when that
    paragraph has text.
    """
    depth = F.col(depth_col).cast("int") if depth_col else F.lit(0)
    df = pages.select(F.col(order_col).cast("long").alias("page_ord"), "url", "html", depth.alias("depth"))
    df = U.add_url_parts(df, "url", "u")
    df = df.withColumns({"site": U.site_of("u"), "path_prefix": U.path_prefix_of("u")})
    df = U.add_normalized(df, "u", "norm_url")
    df = add_html_fields(df, "html")
    fallback = F.when(F.col("h1").isNotNull() & (F.col("para") != ""), F.col("para"))
    df = df.withColumn("description", F.coalesce(F.col("meta_description"), fallback))
    df = df.withColumn("has_description", F.col("description").isNotNull())
    return df.select(*META_COLUMNS)


def page_links(pages: DataFrame, order_col: str = "page_id") -> DataFrame:
    """Every ``<a href>`` of every page in document order: trimmed, empty / '#' / 'mailto:' /
    'javascript:' dropped, resolved against the page url, fragment stripped, crawlable only.
    Not deduplicated; other domains kept.

    Columns: site, src_ord, src_url, src_norm, pos, href, url, norm_url, dst_site.
    """
    df = pages.select(F.col(order_col).cast("long").alias("src_ord"), F.col("url").alias("src_url"), "html")
    df = df.select("src_ord", "src_url", anchor_hrefs(clean_html(F.col("html"))).alias("hrefs"))
    df = df.select("src_ord", "src_url", F.posexplode("hrefs").alias("pos", "raw_href"))
    df = df.withColumn("href", py_strip(F.col("raw_href")))
    h = F.col("href")
    df = df.filter((h != "") & ~h.startswith("#") & ~h.startswith("mailto:") & ~h.startswith("javascript:"))
    df = U.add_resolved(df, "src_url", "href", "resolved")
    df = U.add_url_parts(df, "resolved", "r")
    df = df.withColumn("url", U.without_fragment("r"))
    df = fenced_filter(df, U.crawlable("r"))
    df = U.drop_url_parts(df, "r")
    df = U.add_url_parts(df, "url", "d")
    df = U.add_url_parts(df, "src_url", "s")
    df = U.add_normalized(U.add_normalized(df, "s", "src_norm"), "d", "norm_url")
    out = df.select(
        U.site_of("s").alias("site"), "src_ord", "src_url", "src_norm",
        F.col("pos").cast("int").alias("pos"), "href", "url", "norm_url", U.site_of("d").alias("dst_site"),
    )
    return out
