"""Uncapped crawl over extracted links (C1, C2, C4, C6 on E6's links) by url numbers and bitmaps.

1. Every url that is a seed or the target of a link gets a dense number, from 1 on: distinct
   (site, normalized url) rows range partitioned and numbered by a prefix sum over the partitions'
   counts.  Neighbouring numbers are neighbouring urls, so a bitmap of 32,768 of them is 4 KB for
   (almost always) one site.
2. Links become (source, position, target, code), numbers only; the guards (same domain, crawlable,
   robots, fetch) are decided once per spelling, into the code.
3. A level keeps the first link to each url in queue order -- order of the parent, position in it --
   and drops the urls whose bit is set in ``visited``, a table of bitmaps that is joined once.  What
   stays is numbered in queue order, which writes it, and its bits are or-ed into ``visited``.

The order decides which spelling of a url is tested, as with one worker's queue.  Sites seeded by
their sitemap aren't expanded.  At most ``max_depth + 1`` levels run; a level's state is in the
checkpoint folder.  Null urls are no seeds and no targets; seeds and links repeated under one
position give one row; a site without seeds has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.functions import urls as U
from sitefold.functions.plan import materialize, range_numbered
from sitefold.operators.crawl import MISSING_REASON, ROBOTS_REASON
from sitefold.operators.robots import robots_decisions

#: What the guards say about a link's target.
DROPPED, DISALLOWED, FETCHED, FAILED = range(4)


def url_numbers(urls: DataFrame) -> DataFrame:
    """Distinct (site, norm_url) with ``uid`` = 1, 2, ... in that order."""
    numbered = range_numbered(urls.select("site", "norm_url").distinct(), ["site", "norm_url"], "uid")
    return numbered.select("site", "norm_url", (F.col("uid") + 1).alias("uid"))


def bitmaps(ids: DataFrame, column: str) -> DataFrame:
    """(bucket, bits): the numbers in ``column`` as bitmaps of 32,768 bits."""
    return ids.groupBy(F.bitmap_bucket_number(column).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("bits"))


def has_bit(bits: str, column: str) -> Column:
    """Whether the bitmap holds the number (null for a null bitmap)."""
    at = F.bitmap_bit_position(column)
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte.cast("long"), (at % 8).cast("int")) == 1


def link_reach(seeds: DataFrame, links: DataFrame, outcomes: DataFrame, rules: DataFrame | None, agent: str, max_depth: int = 3) -> DataFrame:
    """Every url the crawl takes from its queue and does not drop: site, norm_url, depth, outcome, reason.

    seeds:    (site, pos, url, sitemap_seeded), at depth 0
    links:    (site, src_norm, pos, url) of the stored pages, same-domain or not
    outcomes: (norm_url, ok, error)
    rules:    robots rules or None
    """
    seeds = materialize(seeds.filter(F.col("url").isNotNull()).select("site", F.col("pos").cast("long").alias("lp"), "url", "sitemap_seeded"))
    listed = seeds.groupBy("site").agg(F.max("sitemap_seeded").alias("listed")).filter("listed").select("site")
    links = links.filter(F.col("url").isNotNull()).select("site", "src_norm", F.col("pos").cast("long").alias("lp"), "url")
    links = materialize(links.join(listed, "site", "left_anti"))

    # the guards, once per spelling
    spelt = U.add_url_parts(seeds.select("site", "url").unionByName(links.select("site", "url")).distinct(), "url", "c")
    spelt = spelt.withColumn("_in", (U.site_of("c") == F.col("site")) & U.crawlable("c"))
    spelt = U.drop_url_parts(U.add_normalized(spelt, "c", "norm_url"), "c")
    spelt = robots_decisions(spelt, rules, agent, url="url") if rules is not None else spelt.withColumn("allowed", F.lit(True))
    spelt = materialize(spelt.select("site", "url", "norm_url", "_in", "allowed"))
    urls = materialize(url_numbers(spelt).join(outcomes.select("norm_url", "ok", "error"), "norm_url", "left"))
    code = (F.when(~F.col("_in"), DROPPED).when(~F.col("allowed"), DISALLOWED).when(F.col("ok"), FETCHED).otherwise(FAILED))
    targets = materialize(spelt.join(urls, ["site", "norm_url"]).select("site", "url", F.col("uid").alias("dst"), code.alias("code")))
    sources = urls.filter("ok").select("site", F.col("norm_url").alias("src_norm"), F.col("uid").alias("src"))
    graph = links.join(targets, ["site", "url"]).join(sources, ["site", "src_norm"]).select("src", "lp", "dst", "code")
    graph = materialize(graph.filter(F.col("code") != DROPPED))

    found = seeds.join(targets, ["site", "url"]).select(F.lit(0).cast("long").alias("parent"), "lp", "dst", "code")
    visited, levels = None, []
    for depth in range(max_depth + 1):
        first = found.groupBy("dst").agg(F.min(F.struct("parent", "lp", "code")).alias("f"))
        if visited is not None:
            first = first.withColumn("bucket", F.bitmap_bucket_number("dst")).join(visited, "bucket", "left")
            first = first.filter(~F.coalesce(has_bit("bits", "dst"), F.lit(False)))
        level = range_numbered(first.select("dst", "f.*"), ["parent", "lp", "dst"], "ord")
        levels.append(level.select("dst", "code", F.lit(depth).alias("depth")))
        expand = level.filter(F.col("code") == FETCHED).select(F.col("dst").alias("src"), F.col("ord").alias("parent"))
        if depth == max_depth or expand.isEmpty():
            break
        bits = bitmaps(level, "dst")
        if visited is not None:
            bits = bits.unionByName(visited).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        visited = materialize(bits)
        found = expand.join(graph, "src").select("parent", "lp", "dst", "code")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    named = out.filter(F.col("code") != DROPPED).join(urls, out["dst"] == urls["uid"])
    outcome = F.when(F.col("code") == FETCHED, "ok").otherwise("skipped")
    reason = F.when(F.col("code") == DISALLOWED, ROBOTS_REASON).when(F.col("code") == FAILED, F.coalesce("error", F.lit(MISSING_REASON)))
    return named.select("site", "norm_url", "depth", outcome.alias("outcome"), reason.alias("reason"))
