"""Registered queries over ``pages``: URLs, metadata, links, titles, sections, documents.

Each query takes (spark, sf_dir) and returns a DataFrame whose column names match the DuckDB oracle
in ``site_oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.functions import urls as U
from sitefold.operators.documents import default_sites, document_parts, root_pages, site_documents, site_sections
from sitefold.operators.pages import page_links, page_meta
from sitefold.operators.titles import site_suffixes, site_title
from sitefold.sources.tables import read_table


def _pages(spark: SparkSession, sf_dir: str, with_html: bool = True) -> DataFrame:
    return read_table(spark, sf_dir, "pages", ["page_id", "url", "html"] if with_html else ["page_id", "url"])


def varied_meta(meta: DataFrame) -> DataFrame:
    """Derived variant of the real metadata that exercises what the snapshot lacks:
    ' | <site>' appended to the title where page_ord % 5 < 3, no description where page_ord % 7 = 0."""
    with_suffix = F.col("page_ord") % 5 < 3
    no_desc = F.col("page_ord") % 7 == 0
    return meta.withColumns({
        "title": F.when(with_suffix & F.col("title").isNotNull(), F.concat(F.col("title"), F.lit(" | "), F.col("site")))
        .otherwise(F.col("title")),
        "description": F.when(no_desc, F.lit(None).cast("string")).otherwise(F.col("description")),
    }).withColumn("has_description", F.col("description").isNotNull())


def q_url_normalize(spark, sf_dir):
    df = U.add_url_parts(_pages(spark, sf_dir, False), "url", "u")
    df = U.add_normalized(df, "u", "norm_url")
    return df.select("page_id", "url", "norm_url", U.without_fragment("u").alias("no_fragment"))


def q_url_parts(spark, sf_dir):
    df = U.add_url_parts(_pages(spark, sf_dir, False), "url", "u")
    return df.select(
        "page_id", *[F.col(f"u_{x}").alias(x) for x in U.PARTS],
        U.site_of("u").alias("site"), U.path_prefix_of("u").alias("path_prefix"), U.hostname_of("u").alias("hostname"),
    )


def q_url_crawlable(spark, sf_dir):
    """U2 + U4 over every href target: crawlable and same-domain flags per link."""
    pages = _pages(spark, sf_dir)
    from sitefold.functions.html import anchor_hrefs, clean_html

    df = pages.select("page_id", "url", F.posexplode(anchor_hrefs(clean_html(F.col("html")))).alias("pos", "href"))
    df = U.add_resolved(df, "url", "href", "target")
    df = U.add_url_parts(U.add_url_parts(df, "target", "t"), "url", "s")
    return df.select("page_id", F.col("pos").cast("int").alias("pos"), "target", U.crawlable("t").alias("crawlable"),
                     (U.site_of("t") == U.site_of("s")).alias("same_domain"))


def q_url_resolve(spark, sf_dir):
    """U5 over every raw href of the corpus against its page url."""
    pages = _pages(spark, sf_dir)
    from sitefold.functions.html import anchor_hrefs, clean_html

    df = pages.select("page_id", "url", F.posexplode(anchor_hrefs(clean_html(F.col("html")))).alias("pos", "href"))
    df = U.add_resolved(df, "url", "href", "resolved")
    return df.select("page_id", F.col("pos").cast("int").alias("pos"), "href", "resolved")


def q_page_metadata(spark, sf_dir):
    return page_meta(_pages(spark, sf_dir))


def q_page_links(spark, sf_dir):
    return page_links(_pages(spark, sf_dir))


def q_links_per_site(spark, sf_dir):
    links = page_links(_pages(spark, sf_dir))
    return links.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_links"),
        F.count_if(F.col("dst_site") == F.col("site")).alias("n_internal"),
        F.count_distinct("norm_url").alias("n_targets"),
    )


def q_site_suffix(spark, sf_dir):
    return site_suffixes(page_meta(_pages(spark, sf_dir)))


def q_site_suffix_varied(spark, sf_dir):
    return site_suffixes(varied_meta(page_meta(_pages(spark, sf_dir))))


def q_site_titles(spark, sf_dir):
    """T5-T6 per site on the varied metadata: root page choice and site title."""
    meta = varied_meta(page_meta(_pages(spark, sf_dir)))
    sites = U.add_url_parts(default_sites(meta), "root_url", "r")
    sites = U.add_normalized(sites, "r", "norm_root").select("site", "root_url", "norm_root", F.col("r_netloc").alias("root_netloc"))
    out = sites.join(site_suffixes(meta).select("site", "suffix"), "site").join(root_pages(meta, sites), "site")
    return out.select("site", "root_url", "suffix",
                      site_title(F.col("root.title"), F.col("root.h1"), F.col("root_netloc"), F.col("suffix")).alias("site_title"))


def q_site_sections(spark, sf_dir):
    return site_sections(varied_meta(page_meta(_pages(spark, sf_dir))))


def q_site_documents(spark, sf_dir):
    return site_documents(page_meta(_pages(spark, sf_dir)))


def q_site_documents_varied(spark, sf_dir):
    return site_documents(varied_meta(page_meta(_pages(spark, sf_dir))))


def q_site_document_parts(spark, sf_dir):
    """The documents as ordered parts, with the number of lines of each."""
    parts = document_parts(varied_meta(page_meta(_pages(spark, sf_dir))))
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: x.startswith("- [")))
    return parts.select("site", "page_count", "part_no", "text", lines.cast("long").alias("listed"))


QUERIES = {
    "url_normalize": q_url_normalize,
    "url_parts": q_url_parts,
    "url_crawlable": q_url_crawlable,
    "url_resolve": q_url_resolve,
    "page_metadata": q_page_metadata,
    "page_links": q_page_links,
    "links_per_site": q_links_per_site,
    "site_suffix": q_site_suffix,
    "site_suffix_varied": q_site_suffix_varied,
    "site_titles": q_site_titles,
    "site_sections": q_site_sections,
    "site_document_parts": q_site_document_parts,
    "site_documents": q_site_documents,
    "site_documents_varied": q_site_documents_varied,
}
