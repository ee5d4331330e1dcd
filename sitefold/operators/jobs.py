"""Job tables: state folding, listing, detail, metrics, top-k.

All are scans with filters, one global aggregation or a top-k; "now" is a parameter (``as_of``)
so results are reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = ("pending", "running")


def seconds_between(a: Column, b: Column) -> Column:
    """(a - b) in seconds with microsecond fractions, null when either is null.  Computed on the
    wall-clock values, independent of the session time zone (no DST shifts)."""
    return F.timestamp_diff("MICROSECOND", b, a) / F.lit(1_000_000.0)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 00:00:00 of a wall-clock timestamp, time-zone independent."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def _ts(as_of: str) -> Column:
    return F.to_timestamp_ntz(F.lit(as_of))


def job_states(jobs: DataFrame, as_of: str) -> DataFrame:
    """State of every job at ``as_of`` folded from its events (submitted -> running at
    start -> final status at completion) and whether a cancel would be accepted then (pending or
    running only).  Jobs submitted after ``as_of`` are not listed."""
    t = _ts(as_of)
    state = (F.when(F.col("completed_at").isNotNull() & (F.col("completed_at") <= t), F.col("status"))
             .when(F.col("started_at").isNotNull() & (F.col("started_at") <= t), F.lit("running"))
             .otherwise(F.lit("pending")))
    df = jobs.filter(F.col("submitted_at") <= t).withColumn("state", state)
    return df.select("job_id", "state", F.col("state").isin(*ACTIVE).alias("cancellable"))


def elapsed(as_of: str) -> Column:
    """coalesce(completed, now) - started, null when never started."""
    return F.when(F.col("started_at").isNotNull(),
                  seconds_between(F.coalesce(F.col("completed_at"), _ts(as_of)), F.col("started_at")))


def duration() -> Column:
    return F.when(F.col("completed_at").isNotNull() & F.col("started_at").isNotNull(),
                  seconds_between(F.col("completed_at"), F.col("started_at")))


def format_duration(seconds: Column) -> Column:
    """J14: '<60' -> one decimal + 's', else 'Xm Ys' (seconds rounded; 59.6 s rounds up into the
    next minute rather than printing '60s')."""
    whole = F.round(seconds).cast("long")
    return (F.when(seconds.isNull(), F.lit(None))
            .when(F.round(seconds, 1) < 60, F.concat(F.format_number(F.round(seconds, 1), 1), F.lit("s")))
            .otherwise(F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s"))))


def progress_pct() -> Column:
    """100 when the crawl came to its end (done or cancelled), unknown otherwise."""
    return F.when(F.col("status").isin("done", "cancelled"), F.lit(100.0))


def job_listing(jobs: DataFrame, batches: DataFrame, rollup: DataFrame, as_of: str, status: str | None = None) -> DataFrame:
    """Top-level jobs (no parent batch; batch parents included, with their status and
    pages from the roll-up J9) newest first, with progress, elapsed, is_batch, batch_url_count and
    the total count; optional status filter."""
    top = jobs.filter(F.col("parent_batch_id").isNull()).select(
        "job_id", "url", "status", "pages_crawled", "pages_skipped", "submitted_at", "started_at", "completed_at",
        F.lit(0).alias("batch_url_count"), progress_pct().alias("progress_pct"))
    parents = batches.join(rollup, "batch_id").select(
        (-F.col("batch_id")).alias("job_id"), F.col("batch_urls")[0].alias("url"), "status", "pages_crawled", "pages_skipped",
        "submitted_at", F.col("submitted_at").alias("started_at"), "completed_at", F.size("batch_urls").alias("batch_url_count"),
        F.lit(None).cast("double").alias("progress_pct"))
    rows = top.unionByName(parents)
    if status:
        rows = rows.filter(F.col("status") == status)
    # the total is one global count attached through a one-row broadcast (size known: 1 row)
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")).withColumn("_one", F.lit(1)))
    rows = rows.withColumn("_one", F.lit(1)).join(total, "_one")
    out = rows.select(
        "job_id", "url", "status", "pages_crawled", "pages_skipped", "progress_pct",
        duration().alias("duration_seconds"), elapsed(as_of).alias("elapsed_seconds"),
        format_duration(duration()).alias("duration_text"),
        (F.col("batch_url_count") > 0).alias("is_batch"), F.col("batch_url_count").cast("int").alias("batch_url_count"),
        "total", "submitted_at",
    )
    # newest first; a global sort is a range-partitioned parallel sort, not a single-task window
    return out.orderBy(F.col("submitted_at").desc(), F.col("job_id").desc())


def job_detail(jobs: DataFrame, as_of: str) -> DataFrame:
    """Per job: counters, progress, times; page_count only when done."""
    return jobs.select(
        "job_id", "status", "url", "pages_crawled", "pages_skipped", "max_pages", "max_depth", progress_pct().alias("progress_pct"),
        elapsed(as_of).alias("elapsed_seconds"), duration().alias("duration_seconds"),
        F.when(F.col("status") == "done", F.col("pages_crawled")).alias("page_count"), "error",
    )


def job_lookup(jobs: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """J4 by id: one row per wanted ``job_id``, ``found`` false for ids no job has."""
    detail = job_detail(jobs, as_of).withColumn("found", F.lit(True))
    return ids.select("job_id").join(detail, "job_id", "left").fillna({"found": False})


def job_metrics(jobs: DataFrame) -> DataFrame:
    """One row over all non-batch jobs (children included)."""
    s = F.col("status")
    return jobs.agg(
        F.count_if(s.isin(*ACTIVE)).alias("active_jobs"), F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(s == "done").alias("completed_jobs"), F.count_if(s == "error").alias("failed_jobs"),
        F.count_if(s == "cancelled").alias("cancelled_jobs"),
        F.coalesce(F.sum("pages_crawled"), F.lit(0)).cast("long").alias("total_pages_crawled"),
        F.coalesce(F.sum("pages_skipped"), F.lit(0)).cast("long").alias("total_pages_skipped"),
    )


def recent_jobs(jobs: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most recently submitted jobs (ties: higher job id first) -- a top-k, so
    Spark plans it as TakeOrderedAndProject (per-partition top-k, no full sort)."""
    return jobs.select("job_id", "url", "status", "pages_crawled", "pages_skipped", duration().alias("duration_seconds"),
                       "submitted_at").orderBy(F.col("submitted_at").desc(), F.col("job_id").desc()).limit(k)
