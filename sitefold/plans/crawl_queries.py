"""Registered queries for robots, sitemaps, the fetch log and the crawl (derived inputs, SURVEY 7.2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.functions import urls as U
from sitefold.functions.plan import fence, materialize
from sitefold.operators import crawl as C
from sitefold.operators import jobdetail as JD
from sitefold.operators.documents import document_parts, joined_parts
from sitefold.operators.fetchlog import fetch_outcomes
from sitefold.operators.linkcrawl import link_reach
from sitefold.operators.pages import META_COLUMNS, page_links, page_meta
from sitefold.operators.robots import robots_decisions, robots_rules, robots_sitemaps
from sitefold.operators.sitemaps import site_seeds, sitemap_urls
from sitefold.sources import derived as D
from sitefold.sources.tables import read_table

AGENT = D.DEFAULT_AGENT


def q_robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots_sitemaps(D.robots_table(spark, sf_dir))


def q_robots_rules(spark, sf_dir):
    return robots_rules(D.robots_table(spark, sf_dir))


def q_robots_decisions(spark, sf_dir):
    """R3 for every page url of the corpus against its host's robots rules."""
    pages = D.ranked_pages(spark, sf_dir).select("site", "page_id", "url")
    rules = robots_rules(D.robots_table(spark, sf_dir))
    return robots_decisions(pages, rules, AGENT).select("page_id", "site", "url", "allowed")


def q_sitemap_urls(spark, sf_dir):
    """R4-R6 without a limit: every url the sitemaps list."""
    directives = robots_sitemaps(D.robots_table(spark, sf_dir))
    return sitemap_urls(directives, D.sitemap_table(spark, sf_dir), D.crawl_jobs_table(spark, sf_dir, max_pages=None))


def _seeds(spark, sf_dir, jobs):
    directives = robots_sitemaps(D.robots_table(spark, sf_dir))
    return site_seeds(jobs, directives, D.sitemap_table(spark, sf_dir))


def q_site_seeds(spark, sf_dir):
    return _seeds(spark, sf_dir, D.crawl_jobs_table(spark, sf_dir))


def q_fetch_outcomes(spark, sf_dir):
    """C7, C8 per url, with the length of the html it got (read off the scan, by page)."""
    out = fetch_outcomes(D.fetch_attempts_table(spark, sf_dir))
    chars = read_table(spark, sf_dir, "pages", ["page_id", "html"]).select(F.col("page_id").alias("body"), F.length("html").cast("long").alias("html_chars"))
    return out.join(chars, "body", "left").select("norm_url", "ok", "error", "attempts_used", "html_chars")


def _crawl_run(spark, sf_dir, max_pages: int | None = 50, max_depth: int = 3):
    jobs = D.crawl_jobs_table(spark, sf_dir, max_pages=max_pages, max_depth=max_depth)
    seeds = _seeds(spark, sf_dir, jobs)
    outcomes = fetch_outcomes(D.fetch_attempts_table(spark, sf_dir)).select("norm_url", "ok", "error")
    rules = robots_rules(D.robots_table(spark, sf_dir))
    return jobs, seeds, C.crawl_run(jobs, seeds, D.edges_table(spark, sf_dir), outcomes, rules, AGENT)


def run_crawl(spark, sf_dir, max_pages: int | None = 50, max_depth: int = 3):
    """(jobs, seeds, result, levels) of the crawl."""
    jobs, seeds, run = _crawl_run(spark, sf_dir, max_pages, max_depth)
    return jobs, seeds, run.result, run.levels


def q_crawl_reach(spark, sf_dir):
    """C1-C6 without a page cap: every url the crawl reaches, its BFS depth and outcome."""
    run = _crawl_run(spark, sf_dir, max_pages=None)[2]
    return run.result.select("site", "norm_url", "depth", "outcome", "reason")


def q_crawl_links(spark, sf_dir):
    """C1, C2 on E6: the uncapped crawl over the links extracted from every page and from its menu."""
    own = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    # one extraction for both: the last bit of a source's number says whether it is a menu
    both = own.withColumn("menu", F.lit(0)).unionByName(D.link_pages(spark, sf_dir).withColumn("menu", F.lit(1)))
    # behind a fence, or Catalyst would write the extraction out for each side of the union
    links = page_links(fence(both.select((F.col("page_id") * 2 + F.col("menu")).alias("n"), "url", "html")), "n")
    links = links.select("site", "src_norm", (F.col("pos") + F.col("src_ord").bitwiseAND(1) * D.MENU_POS).alias("pos"), "url", F.shiftright("src_ord", 1).alias("page_id"))
    stored = D.ranked_pages(spark, sf_dir).select("page_id")  # of pages under one url, the one that was fetched
    links = materialize(links.join(stored, "page_id", "left_semi"))
    outcomes = fetch_outcomes(D.fetch_attempts_table(spark, sf_dir)).select("norm_url", "ok", "error")
    seeds = _seeds(spark, sf_dir, D.crawl_jobs_table(spark, sf_dir, max_pages=None))
    return link_reach(seeds, links, outcomes, robots_rules(D.robots_table(spark, sf_dir)), AGENT)


def q_crawl_skips(spark, sf_dir):
    """Skip log of the capped crawl (50 pages, depth 3)."""
    result = _crawl_run(spark, sf_dir)[2].result
    return result.filter(F.col("outcome") == "skipped").select("site", "url", "reason", "page_ord")


def q_crawl_progress(spark, sf_dir):
    """C10-C13 per job of the capped crawl, with the live queue's counters."""
    return _summary(*_crawl_run(spark, sf_dir))


def _summary(jobs, seeds, run):
    seeds = seeds.select("site", "sitemap_seeded")
    return C.crawl_summary(jobs, seeds, run.result, run.levels, counters=C.live_counters(run, seeds))


def q_crawl_timeline(spark, sf_dir):
    """C12, C13 per crawled page of the capped crawl: the live queue after each page."""
    _, seeds, run = _crawl_run(spark, sf_dir)
    return C.queue_timeline(run, seeds)


def q_crawl_level_progress(spark, sf_dir):
    """C12, C13 per job and level of the capped crawl."""
    _, seeds, run = _crawl_run(spark, sf_dir)
    return C.level_progress(seeds, run.levels)


def _crawl_parts(spark, sf_dir, jobs, result):
    """Documents of the crawled pages, in parts.  Metadata is extracted on the scan of ``pages``; what is
    joined to the crawl's rows are metadata rows, by page id."""
    body = fetch_outcomes(D.fetch_attempts_table(spark, sf_dir)).filter(F.col("ok")).select("norm_url", "body")
    ok = result.filter(F.col("outcome") == "ok").select("site", "url", "norm_url", "depth", "page_ord")
    ok = U.add_url_parts(ok.join(body, "norm_url"), "url", "u").withColumn("path_prefix", U.path_prefix_of("u"))
    found = page_meta(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))
    found = found.select(F.col("page_ord").alias("body"), "title", "description", "h1", "has_description")
    meta = U.drop_url_parts(ok, "u").join(found, "body").select(*META_COLUMNS)
    return document_parts(meta, jobs.select("site", "root_url"))


def _crawl_docs(spark, sf_dir, jobs, result):
    return joined_parts(_crawl_parts(spark, sf_dir, jobs, result))


def q_crawl_documents(spark, sf_dir):
    """The full flow: crawl (50 pages, depth 3) -> metadata of crawled pages -> one document per site."""
    jobs, _, run = _crawl_run(spark, sf_dir)
    return _crawl_docs(spark, sf_dir, jobs, run.result)


def q_crawl_job_detail(spark, sf_dir):
    """J4 + J12 over the crawl: per job the status and counters; the document and page count only
    for jobs that finished 'done'."""
    jobs, seeds, run = _crawl_run(spark, sf_dir)
    summary = _summary(jobs, seeds, run)
    docs = _crawl_docs(spark, sf_dir, jobs, run.result).select("site", "llms_txt")
    done = F.col("status") == "done"
    return summary.join(docs, "site", "left").select(
        "site", "status", "pages_crawled", "pages_skipped", "queue_size", "total_known", "sitemap_seeded", "progress_pct", "error",
        F.when(done, F.col("pages_crawled")).alias("page_count"), F.when(done, F.col("llms_txt")).alias("llms_txt"))


def _children(run):
    """Skipped urls and crawled pages of every job as numbered child rows."""
    rows = run.result.select("site", F.when(F.col("outcome") == "ok", "crawled").otherwise("skipped").alias("kind"), "page_ord", "url", "depth", "reason")
    return JD.child_pages(rows, "site", "kind", "page_ord").select("site", "kind", "page_no", "slot", "url", "depth", "reason")


def q_crawl_job_children(spark, sf_dir):
    """The child rows of every job: skipped urls with their reasons, crawled pages."""
    return _children(_crawl_run(spark, sf_dir)[2])


def q_crawl_job_manifest(spark, sf_dir):
    """J4 + J12: one bounded row per job: status, counters, and how many child rows, pages and document parts it has."""
    jobs, seeds, run = _crawl_run(spark, sf_dir)
    return JD.manifest(_summary(jobs, seeds, run), _children(run), _crawl_parts(spark, sf_dir, jobs, run.result).select("site", "text"),
                       "site", ("skipped", "crawled"))


QUERIES = {
    "robots_sitemaps": q_robots_sitemaps,
    "robots_rules": q_robots_rules,
    "robots_decisions": q_robots_decisions,
    "sitemap_urls": q_sitemap_urls,
    "site_seeds": q_site_seeds,
    "fetch_outcomes": q_fetch_outcomes,
    "crawl_reach": q_crawl_reach,
    "crawl_links": q_crawl_links,
    "crawl_skips": q_crawl_skips,
    "crawl_progress": q_crawl_progress,
    "crawl_level_progress": q_crawl_level_progress,
    "crawl_timeline": q_crawl_timeline,
    "crawl_documents": q_crawl_documents,
    "crawl_job_detail": q_crawl_job_detail,
    "crawl_job_children": q_crawl_job_children,
    "crawl_job_manifest": q_crawl_job_manifest,
}
