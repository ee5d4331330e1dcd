"""Title analytics.

The dominant suffix is a two-level aggregation keyed by site: candidate counts per
(site, suffix) with a partial (map-side) count, then the best candidate per site as a ``max`` over
a struct, so a huge site never lands in one task as a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.functions.plan import fenced_filter
from sitefold.functions.text import py_strip

# --- fixed values -----------------------------------------------------------------------------
# Separators that may start a site-wide title suffix, in the order they are tried.
SEPARATORS = [" | ", " - ", " – ", " — ", " · ", " • "]
# ----------------------------------------------------------------------------------------------


def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def site_suffixes(meta: DataFrame) -> DataFrame:
    """(site, suffix, n_titles) for every site that has a page; suffix '' when none.

    Candidates: for each non-empty title and each separator, the text from the separator's first
    occurrence (not at position 0) to the end.  The most frequent candidate wins, ties to the one
    seen first (page order, then separator order); it is kept only when it occurs in more than
    half of the titles, and only when the site has at least two titles.
    """
    titled = fenced_filter(meta, _nonempty(F.col("title"))).select("site", "page_ord", "title")
    seps = F.array(*[F.struct(F.lit(i).alias("sep_no"), F.lit(s).alias("sep")) for i, s in enumerate(SEPARATORS)])
    cands = (
        titled.select("site", "page_ord", "title", F.explode(seps).alias("s"))
        .withColumn("idx", F.instr(F.col("title"), F.col("s.sep")))
        .filter(F.col("idx") > 1)
        .select("site", "page_ord", F.col("s.sep_no").alias("sep_no"),
                F.expr("substring(title, idx)").alias("suffix"))
    )
    counted = cands.groupBy("site", "suffix").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("page_ord", "sep_no")).alias("first"),
    )
    best = counted.groupBy("site").agg(
        F.max(F.struct(F.col("n"), -F.col("first.page_ord"), -F.col("first.sep_no"), F.col("suffix"))).alias("b")
    ).select("site", F.col("b.n").alias("best_n"), F.col("b.suffix").alias("best_suffix"))
    n_titles = titled.groupBy("site").agg(F.count(F.lit(1)).alias("n_titles"))
    sites = meta.select("site").distinct()
    return (
        sites.join(n_titles, "site", "left").join(best, "site", "left")
        .select(
            "site",
            F.when((F.coalesce(F.col("n_titles"), F.lit(0)) >= 2) & (F.col("best_n") * 2 > F.col("n_titles")),
                   F.col("best_suffix")).otherwise(F.lit("")).alias("suffix"),
            F.coalesce(F.col("n_titles"), F.lit(0)).alias("n_titles"),
        )
    )


def without_suffix(title: Column, suffix: Column) -> Column:
    """Strip the suffix when the title ends with it, then strip whitespace."""
    stripped = py_strip(F.substring(title, F.lit(1), F.length(title) - F.length(suffix)))
    return F.when((suffix != "") & title.endswith(suffix), stripped).otherwise(title)


def display_title(title: Column, h1: Column, url: Column, suffix: Column) -> Column:
    """T4: cleaned title when the title is non-empty (may become ''), else a non-empty h1, else url."""
    return F.when(_nonempty(title), without_suffix(title, suffix)).when(_nonempty(h1), h1).otherwise(url)


def site_title(root_title: Column, root_h1: Column, root_netloc: Column, suffix: Column) -> Column:
    """Cleaned root title if non-empty, else root h1, else the raw netloc of the root url."""
    cleaned = F.when(_nonempty(root_title), without_suffix(root_title, suffix))
    return F.when(_nonempty(cleaned), cleaned).when(_nonempty(root_h1), root_h1).otherwise(root_netloc)
