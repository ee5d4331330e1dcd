"""Site document generation (G0-G9): pages of a site -> one Markdown index.

No step holds a site as a list.  Suffix vote, root page and section starts are aggregations with
map-side combine; the list lines of all sites are range partitioned by (site, section order, title,
page order), numbered by a prefix sum over the partitions' counts, and assembled in parts of at most
``PART_LINES`` lines.  ``document_parts`` returns the parts; ``site_documents`` joins a site's parts
into one value, which is the size of the document itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefold.functions import urls as U
from sitefold.functions.plan import fenced_filter, materialize
from sitefold.functions.text import py_rstrip
from sitefold.operators.titles import display_title, site_suffixes, site_title

# --- fixed values -----------------------------------------------------------------------------
DEFAULT_SECTION = "Pages"
UNDESCRIBED_SECTION = "Optional"
EMPTY_SITE_LINE = "> No pages were successfully crawled."
# ----------------------------------------------------------------------------------------------

#: List lines of one part of a document.
PART_LINES = 1000


def section_name(prefix: Column) -> Column:
    """Path prefix -> heading: '-'/'_' to spaces, words capitalized, single spaces; '' -> Pages."""
    words = F.regexp_replace(F.trim(F.regexp_replace(prefix, "[-_\\s]+", " ")), " +", " ")
    return F.when(words == "", F.lit(DEFAULT_SECTION)).otherwise(F.initcap(words))


def default_sites(meta: DataFrame) -> DataFrame:
    """Site list of a snapshot: every site with its root ``https://<site>/``."""
    return meta.select("site").distinct().withColumn("root_url", F.concat(F.lit("https://"), F.col("site"), F.lit("/")))


def _with_root(sites: DataFrame) -> DataFrame:
    """(site, root_url, norm_root, root_netloc)."""
    df = U.add_normalized(U.add_url_parts(sites.select("site", "root_url"), "root_url", "r"), "r", "norm_root")
    return df.select("site", "root_url", "norm_root", F.col("r_netloc").alias("root_netloc"))


def site_sections(meta: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """One row per listed page with its section, display title and rendered line.

    Columns: site, page_ord, url, section, undescribed, display_title, line.
    """
    roots = _with_root(sites if sites is not None else default_sites(meta))
    suffix = site_suffixes(meta).select("site", "suffix")
    pages = meta.join(roots.select("site", "norm_root"), "site").join(suffix, "site")
    listed = fenced_filter(pages, F.col("norm_url") != F.col("norm_root"))
    dt = display_title(F.col("title"), F.col("h1"), F.col("url"), F.col("suffix"))
    listed = listed.withColumn("display_title", dt)
    shown = F.when(F.col("display_title") != "", F.col("display_title")).otherwise(F.col("url"))
    desc = F.col("description")
    line = F.concat(F.lit("- ["), shown, F.lit("]("), F.col("url"), F.lit(")"),
                    F.when(desc.isNotNull() & (desc != ""), F.concat(F.lit(": "), desc)).otherwise(F.lit("")))
    return listed.select(
        "site", "page_ord", "url",
        F.when(F.col("has_description"), section_name(F.col("path_prefix"))).otherwise(F.lit(UNDESCRIBED_SECTION)).alias("section"),
        (~F.col("has_description")).alias("undescribed"),
        "display_title",
        line.alias("line"),
    )


def root_pages(meta: DataFrame, roots: DataFrame) -> DataFrame:
    """T5 per site: its root page, else its first page, as struct ``root``; and its page count."""
    first = F.struct((F.col("norm_url") != F.col("norm_root")).alias("other"), "page_ord")
    return meta.join(roots.select("site", "norm_root"), "site").groupBy("site").agg(
        F.min_by(F.struct("title", "h1", "description"), first).alias("root"), F.count(F.lit(1)).alias("page_count"))


def _numbered(lines: DataFrame) -> DataFrame:
    """``lines`` with ``pos``, their number (from 0) in their site's order: range partitions, the
    rank inside a partition, plus the site's rows in the partitions before it."""
    keys = ["site", "undescribed", (F.col("section") != DEFAULT_SECTION), "section", "display_title", "page_ord"]
    dealt = materialize(lines.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()))
    rank = F.row_number().over(Window.partitionBy("site", "_p").orderBy(*keys[1:]))
    before = Window.partitionBy("site").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("site", "_p").agg(F.count(F.lit(1)).alias("n")).withColumn("_off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = dealt.withColumn("_rank", rank).join(counts.select("site", "_p", "_off"), ["site", "_p"])
    return ranked.withColumn("pos", F.col("_off") + F.col("_rank") - 1).drop("_p", "_rank", "_off")


def document_parts(meta: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """G0 in bounded pieces: (site, root_url, page_count, part_no, text).  Part 0 is the header;
    the texts of a site's parts, in order, are its document."""
    meta = materialize(meta)  # metadata rows, no html: extracted once for all that follows
    given = sites.select("site", "root_url") if sites is not None else default_sites(meta)
    roots = _with_root(given)
    lines = _numbered(site_sections(meta, given))
    # the first line of each section carries the heading
    starts = lines.groupBy("site", "undescribed", "section").agg(F.min("pos").alias("pos")).withColumn("_head", F.lit(True))
    lines = lines.join(starts.select("site", "pos", "_head"), ["site", "pos"], "left")
    heading = F.concat(F.when(F.col("pos") > 0, F.lit("\n")).otherwise(F.lit("")), F.lit("## "), F.col("section"), F.lit("\n\n"))
    piece = F.concat(F.when(F.col("_head"), heading).otherwise(F.lit("")), F.col("line"), F.lit("\n"))
    bodies = (lines.withColumn("piece", piece).groupBy("site", (F.floor(F.col("pos") / PART_LINES) + 1).alias("part_no"))
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("text")))

    facts = roots.join(root_pages(meta, roots), "site", "left").join(site_suffixes(meta).select("site", "suffix"), "site", "left")
    facts = facts.join(lines.groupBy("site").agg(F.max(F.floor(F.col("pos") / PART_LINES) + 1).alias("last")), "site", "left")
    root, desc = F.col("root"), F.col("root.description")
    title = site_title(root["title"], root["h1"], F.col("root_netloc"), F.coalesce("suffix", F.lit("")))
    header = F.concat(F.lit("# "), title, F.lit("\n\n"),
                      F.when(desc.isNotNull() & (desc != ""), F.concat(F.lit("> "), desc, F.lit("\n\n"))).otherwise(F.lit("")))
    empty = F.concat(F.lit("# "), F.col("root_netloc"), F.lit("\n\n" + EMPTY_SITE_LINE))
    facts = facts.select("site", "root_url", F.coalesce("page_count", F.lit(0)).cast("long").alias("page_count"), F.coalesce("last", F.lit(0)).alias("last"),
                         F.when(F.col("page_count") > 0, header).otherwise(empty).alias("header"))
    heads = facts.select("site", "root_url", "page_count", "last", F.lit(0).cast("long").alias("part_no"), F.col("header").alias("text"))
    rest = bodies.join(facts.select("site", "root_url", "page_count", "last"), "site").select(heads.columns)
    # the document ends in one line end
    closed = F.when(F.col("part_no") == F.col("last"), F.concat(py_rstrip(F.col("text")), F.lit("\n"))).otherwise(F.col("text"))
    return heads.unionByName(rest).select("site", "root_url", "page_count", "part_no", closed.alias("text"))


def joined_parts(parts: DataFrame) -> DataFrame:
    """One row per site from its parts: (site, root_url, page_count, llms_txt)."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("part_no", "text"))), lambda x: x["text"])
    return parts.groupBy("site", "root_url").agg(F.max("page_count").alias("page_count"), F.array_join(ordered, "").alias("llms_txt"))


def site_documents(meta: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """One ``llms.txt`` document per site, over all its pages.

    ``meta`` is the page metadata (E0) with ``page_ord`` as crawl order; ``sites`` (site, root_url)
    lists the sites to emit, including sites with no page (G9); by default every site of ``meta``
    with root ``https://<site>/``.  Columns: site, root_url, page_count, llms_txt.
    """
    return joined_parts(document_parts(meta, sites))
