"""Crawl dataflow over stored pages.

The reference drains a FIFO queue with one worker per job; here every site's queue is processed a
level at a time, all sites in one DataFrame, with order defined as one FIFO worker would see it:
``page_ord`` = (depth, parent order, link position).  Per level:

* dedup by normalized url: first in queue order, and not visited in earlier levels (C2);
* guards in order: same domain and crawlable drop silently, robots and fetch write a skip row (C4);
* page cap: an item is processed while fewer than ``max_pages`` pages succeeded before it (C3),
  a running sum in queue order; skipped items use no budget;
* next frontier: links of this level's pages when not sitemap-seeded and depth < max_depth (C1).

The driver loop runs at most ``max_depth + 1`` levels; each level's state is checkpointed into the
cluster's checkpoint folder so lineage stays flat.  ``isEmpty`` on the frontier is the only action
per level.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefold.functions import urls as U
from sitefold.functions.plan import chunked_row_number, chunked_running_sum
from sitefold.operators.robots import robots_decisions
from sitefold.session import checkpoint_dir

# --- fixed values -----------------------------------------------------------------------------
ROBOTS_REASON = "disallowed by robots.txt"
MISSING_REASON = "HTTP 404"
ORD_SCALE = 1 << 40  # page_ord = depth * ORD_SCALE + rank within the level
# ----------------------------------------------------------------------------------------------


def _checkpoint(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _annotate(df: DataFrame, rules: DataFrame | None, agent: str) -> DataFrame:
    """Add norm_url and the guard flags of ``url``: _netsite (same-domain key), _crawlable and
    robots ``allowed`` -- computed once per seed / link, never inside the level loop."""
    df = U.add_url_parts(df, "url", "c")
    df = df.withColumns({"_netsite": U.site_of("c"), "_crawlable": U.crawlable("c")})
    df = U.drop_url_parts(U.add_normalized(df, "c", "norm_url"), "c")
    if rules is not None:
        return robots_decisions(df, rules, agent, url="url")
    return df.withColumn("allowed", F.lit(True))


class CrawlRun(NamedTuple):
    """What a crawl leaves behind.

    result:  (site, url, norm_url, depth, page_ord, outcome, reason, root_failed)
    levels:  counts per site and level
    visited: (site, norm_url, page_ord, ok, expands): every url that was taken from the queue and not
             dropped there as visited or beyond the cap
    links:   (site, src_norm, lp, norm_url): same-domain links of the stored pages
    """

    result: DataFrame
    levels: DataFrame
    visited: DataFrame
    links: DataFrame


def crawl(jobs: DataFrame, seeds: DataFrame, edges: DataFrame, outcomes: DataFrame, rules: DataFrame | None,
          agent: str) -> tuple[DataFrame, DataFrame]:
    """``crawl_run``'s result and levels."""
    return crawl_run(jobs, seeds, edges, outcomes, rules, agent)[:2]


def crawl_run(jobs: DataFrame, seeds: DataFrame, edges: DataFrame, outcomes: DataFrame, rules: DataFrame | None,
              agent: str) -> CrawlRun:
    """Run the crawl for every job at once.

    jobs:     (site, root_url, max_pages, max_depth); ``max_pages`` null means no cap
    seeds:    (site, pos, url, depth, sitemap_seeded) from ``site_seeds``
    edges:    (site, src_norm, pos, dst_url) link graph of stored pages
    outcomes: (norm_url, ok, error) from ``fetch_outcomes``
    rules:    robots rules (``robots_rules``) or None

    The result's outcome is 'ok' or 'skipped'.
    """
    spark = jobs.sparkSession
    jobs = U.add_url_parts(jobs.select("site", "root_url", "max_pages", "max_depth"), "root_url", "r")
    jobs = U.drop_url_parts(U.add_normalized(jobs, "r", "norm_root"), "r")
    mode = seeds.groupBy("site").agg(F.max("sitemap_seeded").alias("sitemap_seeded"))
    jobs = _checkpoint(jobs.join(mode, "site", "left").fillna({"sitemap_seeded": False}))
    deepest = jobs.agg(F.max("max_depth")).first()[0]
    limit = (deepest or 0) + 1
    # everything the loop reads is prepared and materialized once
    outcomes = _checkpoint(outcomes.select("norm_url", F.col("ok").alias("_ok"), F.col("error").alias("_err")))
    link_cols = ["site", "src_norm", "lp", "url", "norm_url", "_netsite", "_crawlable", "allowed"]
    links_x = _checkpoint(_annotate(edges.select("site", "src_norm", F.col("pos").alias("lp"), F.col("dst_url").alias("url")),
                                    rules, agent).select(*link_cols))
    cols = ["site", "url", "norm_url", "depth", "qord", "_netsite", "_crawlable", "allowed"]
    frontier = _checkpoint(_annotate(seeds.select("site", "url", F.col("depth").cast("int").alias("depth"),
                                                  F.col("pos").cast("long").alias("qord")), rules, agent).select(*cols))

    visited = spark.createDataFrame([], "site string, norm_url string")
    crawled = spark.createDataFrame([], "site string, n long")
    out: list[DataFrame] = []
    levels: list[DataFrame] = []
    taken: list[DataFrame] = []
    for _ in range(limit):
        # first occurrence per normalized url: a partial aggregation, so a url linked from many
        # pages is combined map-side
        attrs = [c for c in cols if c not in ("site", "norm_url", "qord")]
        first = frontier.groupBy("site", "norm_url").agg(
            F.min("qord").alias("qord"), F.min_by(F.struct(*attrs), F.col("qord")).alias("_a"))
        f = first.select("site", "norm_url", "qord", *[F.col("_a")[c].alias(c) for c in attrs])
        f = f.join(visited, ["site", "norm_url"], "left_anti")
        c0 = crawled.groupBy("site").agg(F.sum("n").alias("c0"))
        f = f.join(jobs, "site").join(c0, "site", "left").fillna({"c0": 0})
        f = f.join(outcomes, "norm_url", "left")
        guard = (F.col("_netsite") == F.col("site")) & F.col("_crawlable")
        fetched = F.coalesce(F.col("_ok"), F.lit(False))
        f = f.withColumns({
            "outcome": F.when(~guard, F.lit(None)).when(~F.col("allowed"), F.lit("skipped"))
            .when(fetched, F.lit("ok")).otherwise(F.lit("skipped")),
            "reason": F.when(~guard, F.lit(None)).when(~F.col("allowed"), F.lit(ROBOTS_REASON))
            .when(fetched, F.lit(None)).otherwise(F.coalesce(F.col("_err"), F.lit(MISSING_REASON))),
        })
        # successes before this item in queue order (the cap test, and the root-failure rule: "no page
        # crawled yet"): a running sum per site computed in parallel chunks
        f = f.withColumn("_okflag", F.when(F.col("outcome") == "ok", 1).otherwise(0))
        f = chunked_running_sum(f, ["site"], "qord", "_okflag", "ok_before", chunk_width=1 << 16, inclusive=False)
        f = f.withColumn("_before", F.col("c0") + F.col("ok_before")).drop("_okflag", "ok_before")
        processed = f.filter(F.col("max_pages").isNull() | (F.col("_before") < F.col("max_pages")))
        level = _checkpoint(processed.select(
            "site", "url", "norm_url", "depth", "qord", "outcome", "reason", "_before", "norm_root", "sitemap_seeded", "max_depth"))
        grows = (F.col("outcome") == "ok") & ~F.col("sitemap_seeded") & (F.col("depth") < F.col("max_depth"))
        taken.append(level.select("site", "norm_url", (F.col("depth").cast("long") * ORD_SCALE + F.col("qord")).alias("page_ord"),
                                  F.coalesce(F.col("outcome") == "ok", F.lit(False)).alias("ok"), F.coalesce(grows, F.lit(False)).alias("expands")))
        out.append(level.filter(F.col("outcome").isNotNull()).select(
            "site", "url", "norm_url", "depth", (F.col("depth").cast("long") * ORD_SCALE + F.col("qord")).alias("page_ord"),
            "outcome", "reason",
            ((F.col("norm_url") == F.col("norm_root")) & (F.col("outcome") == "skipped") & (F.col("_before") == 0)
             & (F.col("reason") != ROBOTS_REASON)).alias("root_failed")))
        ok = level.filter(F.col("outcome") == "ok")
        visited = visited.unionByName(level.select("site", "norm_url"))
        crawled = crawled.unionByName(ok.groupBy("site").agg(F.count(F.lit(1)).alias("n")))
        expand = ok.filter(~F.col("sitemap_seeded") & (F.col("depth") < F.col("max_depth")))
        links = expand.select("site", F.col("norm_url").alias("src_norm"), F.col("qord").alias("pq"), "depth") \
            .join(links_x, ["site", "src_norm"])
        # enqueue only same-domain links not visited yet (the same test runs again at dequeue)
        links = links.filter(F.col("_netsite") == F.col("site")).join(visited, ["site", "norm_url"], "left_anti")
        # queue order of the next level: (parent order, link position), ranked in parallel chunks
        nxt = links.withColumns({"depth": F.col("depth") + 1, "_o": F.col("pq") * F.lit(1 << 22) + F.col("lp")})
        nxt = chunked_row_number(nxt, ["site"], "_o", "qord", chunk_width=1 << 32).drop("_o")
        # the next frontier stays a plan over checkpointed inputs (this level, the link table and
        # the visited levels), so lineage is flat without writing it; the next level's job builds it
        frontier = nxt.select(*cols)
        levels.append(level.groupBy("site", "depth").agg(
            F.count(F.lit(1)).alias("processed"), F.count_if(F.col("outcome") == "ok").alias("crawled"))
            .join(frontier.groupBy("site").agg(F.count(F.lit(1)).alias("enqueued_next")), "site", "left")
            .fillna({"enqueued_next": 0}))
        if expand.isEmpty():
            break
    inside = links_x.filter(F.col("_netsite") == F.col("site")).select("site", "src_norm", "lp", "norm_url")
    return CrawlRun(_all(out), _all(levels), _all(taken), inside)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def queue_timeline(run: CrawlRun, seeds: DataFrame) -> DataFrame:
    """C12, C13 as one worker sees its live queue: per crawled page, in the order of the queue, the
    pages crawled so far, the urls it put into the queue, the queue's length after that and the known
    urls (crawled + queue) if it put any.

    A page puts a link into the queue unless the link was visited before the page was taken; a url
    may so lie in the queue several times, and the later ones are taken out without effect.  An item's
    number in the queue is the number of items put before it: the seeds, the links of earlier pages (a
    chunked running sum over the pages) and the earlier links of its own page.  What has been taken
    when a page is done is its own number and one.

    Columns: site, page_ord, crawled, enqueued, queue_size, total_known.
    """
    pages = _checkpoint(run.visited)
    parents = pages.filter("expands").select("site", F.col("norm_url").alias("src_norm"), F.col("page_ord").alias("parent"))
    first = pages.select("site", "norm_url", F.col("page_ord").alias("seen_at"))
    puts = run.links.join(parents, ["site", "src_norm"]).join(first, ["site", "norm_url"], "left")
    puts = _checkpoint(puts.filter(F.col("seen_at").isNull() | (F.col("seen_at") > F.col("parent"))).select("site", "parent", "lp", "norm_url", "seen_at"))
    n_seeds = seeds.groupBy("site").agg(F.count(F.lit(1)).alias("n_seeds"))
    per_page = puts.groupBy("site", F.col("parent").alias("page_ord")).agg(F.count(F.lit(1)).alias("enqueued"))
    ok = pages.filter("ok").select("site", "norm_url", "page_ord").join(per_page, ["site", "page_ord"], "left").fillna({"enqueued": 0})
    ok = chunked_running_sum(ok.withColumn("one", F.lit(1)), ["site"], "page_ord", "one", "crawled")
    ok = _checkpoint(chunked_running_sum(ok, ["site"], "page_ord", "enqueued", "put_upto").join(n_seeds, "site"))
    # the number of each crawled url: its place among the seeds, or that of the first link that put it
    rank = F.row_number().over(Window.partitionBy("site", "parent").orderBy("lp")) - 1  # links of one page
    before = ok.select("site", F.col("page_ord").alias("parent"), (F.col("n_seeds") + F.col("put_upto") - F.col("enqueued")).alias("put_before"))
    numbers = puts.withColumn("rank", rank).join(before, ["site", "parent"]).groupBy("site", "norm_url").agg(
        F.min(F.col("put_before") + F.col("rank")).alias("number"))
    out = ok.join(numbers, ["site", "norm_url"], "left").withColumn(
        "number", F.when(F.col("page_ord") < ORD_SCALE, F.col("page_ord")).otherwise(F.col("number")))
    queue = F.col("n_seeds") + F.col("put_upto") - F.col("number") - 1
    return out.select("site", "page_ord", "crawled", F.col("enqueued").cast("long").alias("enqueued"), queue.cast("long").alias("queue_size"),
                      F.when(F.col("enqueued") > 0, F.col("crawled") + queue).cast("long").alias("total_known"))


def live_counters(run: CrawlRun, seeds: DataFrame) -> DataFrame:
    """Per site the counters as they stand at the end: ``queue_size`` after the last crawled page, and
    ``total_known`` at the last time a url was put into the queue (the seeds at first)."""
    timeline = queue_timeline(run, seeds)
    ends = timeline.groupBy("site").agg(F.max_by("queue_size", "page_ord").alias("queue_size"),
                                        F.max_by("total_known", F.when(F.col("enqueued") > 0, F.col("page_ord"))).alias("last_known"))
    known = seeds.groupBy("site").agg(F.count(F.lit(1)).alias("n_seeds"))
    return known.join(ends, "site", "left").select("site", F.coalesce("queue_size", F.lit(0)).cast("long").alias("queue_size"),
                                                   F.coalesce("last_known", "n_seeds").cast("long").alias("total_known"))


def crawl_summary(jobs: DataFrame, seeds: DataFrame, result: DataFrame, levels: DataFrame, compat: bool = False,
                  counters: DataFrame | None = None) -> DataFrame:
    """C5, C10-C13 per job: pages crawled / skipped, sitemap mode, known urls, progress, error.

    sitemap mode: total_known = seed count, progress = min(crawled / known * 100, 99) while running
    and 100 at the end; BFS: total_known as the live queue gives it (``counters``, see ``live_counters``;
    without it crawled + the last enqueued frontier size, the level-wise counterpart).  A root that
    fails before any page succeeded sets ``Could not reach <url>: <error>``; the job status is then
    'error' (the reference reports it as done; ``compat`` keeps that).
    """
    mode = seeds.groupBy("site").agg(F.max("sitemap_seeded").alias("sitemap_seeded"), F.count(F.lit(1)).alias("n_seeds"))
    counts = result.groupBy("site").agg(
        F.count_if(F.col("outcome") == "ok").alias("pages_crawled"),
        F.count_if(F.col("outcome") == "skipped").alias("pages_skipped"),
        F.min_by(F.concat(F.lit("Could not reach "), F.col("url"), F.lit(": "), F.col("reason")),
                 F.when(F.col("root_failed"), F.col("page_ord"))).alias("error"),
    )
    last = levels.groupBy("site").agg(F.max_by("enqueued_next", "depth").alias("queue_last"))
    out = jobs.select("site", "root_url").join(mode, "site", "left").join(counts, "site", "left").join(last, "site", "left")
    out = out.fillna({"pages_crawled": 0, "pages_skipped": 0, "queue_last": 0, "n_seeds": 0, "sitemap_seeded": False})
    known, extra = F.when(F.col("sitemap_seeded"), F.col("n_seeds")).otherwise(F.col("pages_crawled") + F.col("queue_last")), []
    if counters is not None:
        live = counters.select("site", "queue_size", F.col("total_known").alias("_known"))
        out, known, extra = out.join(live, "site", "left"), F.coalesce("_known", F.lit(0)), [F.coalesce("queue_size", F.lit(0)).alias("queue_size")]
    return out.select(
        "site", "root_url", "sitemap_seeded", *extra,
        F.col("pages_crawled").cast("long").alias("pages_crawled"), F.col("pages_skipped").cast("long").alias("pages_skipped"),
        known.cast("long").alias("total_known"),
        (F.lit("done") if compat else F.when(F.col("error").isNotNull(), F.lit("error")).otherwise(F.lit("done"))).alias("status"),
        "error",
        F.lit(100.0).alias("progress_pct"),
    )


def level_progress(seeds: DataFrame, levels: DataFrame) -> DataFrame:
    """C12, C13 as a crawl goes: per job and level the pages so far, the queue, the known urls and
    the progress -- crawled of known, at most 99 % until the crawl ends, when a sitemap gave the
    urls; unknown (null) while links are followed."""
    mode = seeds.groupBy("site").agg(F.max("sitemap_seeded").alias("sitemap_seeded"), F.count(F.lit(1)).alias("n_seeds"))
    upto = Window.partitionBy("site").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each level
    df = levels.join(mode, "site").withColumn("pages_crawled", F.sum("crawled").over(upto))
    df = df.withColumn("total_known", F.when(F.col("sitemap_seeded"), F.col("n_seeds")).otherwise(F.col("pages_crawled") + F.col("enqueued_next")))
    pct = F.when(F.col("sitemap_seeded"), F.least(F.col("pages_crawled") / F.col("total_known") * 100, F.lit(99.0)))
    return df.select("site", "depth", F.col("processed").cast("long").alias("processed"), F.col("pages_crawled").cast("long").alias("pages_crawled"),
                     F.col("enqueued_next").cast("long").alias("queue_size"), F.col("total_known").cast("long").alias("total_known"),
                     pct.alias("progress_pct"))
