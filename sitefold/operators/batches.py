"""Batches: seed-list parsing (S1-S3), batch expansion against the job cache (J7), results and
roll-up (J8, J9, J15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.functions import urls as U
from sitefold.functions.plan import chunked_row_number, fence, materialize
from sitefold.functions.text import py_strip
from sitefold.operators.jobs import ACTIVE, epoch_micros, seconds_between
from sitefold.operators.requests import CHUNK_SECONDS, MAX_DEPTH_RANGE, MAX_PAGES_RANGE, TTL_SECONDS, asof_predecessor

SEED_SPLIT_RE = "[\\n,]+"


def parse_seed_lines(lines: DataFrame) -> DataFrame:
    """(source_no, line_no, line) text lines -> (source_no, line_no, pos, url): split on
    runs of newline / comma, stripped, only items starting 'http://' or 'https://' (case
    sensitive), in order."""
    items = lines.select("source_no", "line_no", F.posexplode(F.split(F.col("line"), SEED_SPLIT_RE, -1)).alias("pos", "raw"))
    items = items.withColumn("url", py_strip(F.col("raw")))
    return items.filter(F.col("url").startswith("http://") | F.col("url").startswith("https://")) \
        .select("source_no", "line_no", F.col("pos").cast("int").alias("pos"), "url")


def repaired_text(content: Column) -> Column:
    """UTF-8 bytes as text; every maximal part of a broken sequence becomes one U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def read_uploads(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(path, text) of the uploaded seed files at or under ``path``, scanned as bytes; an empty
    file has no row.  With ``packed`` the folder is a table of (path, content) rows, each a whole
    file: for uploads so many that files of their own would take longer to list and commit than to read."""
    if packed:
        files = spark.read.schema("path string, content binary").parquet(path).where(F.length("content") > 0)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", repaired_text(F.col("content")).alias("text"))


def text_lines(texts: DataFrame, source_no: int, *keep: str) -> DataFrame:
    """(``keep``, source_no, line_no, line) of whole texts, for ``parse_seed_lines``."""
    return texts.select(*keep, F.lit(source_no).alias("source_no"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")) \
        .withColumn("line_no", F.col("line_no").cast("long"))


def read_seed_sources(spark: SparkSession, file_path: str | None, form_text: str | None) -> DataFrame:
    """An uploaded seed file first (see ``read_uploads``), then the form text unless it is blank,
    as (source_no, line_no, line) rows for ``parse_seed_lines``."""
    out = spark.createDataFrame([], "source_no int, line_no long, line string")
    if file_path:
        out = out.unionByName(text_lines(read_uploads(spark, file_path), 0))
    if form_text is not None and form_text.strip():
        out = out.unionByName(text_lines(spark.createDataFrame([(form_text,)], "text string"), 1))
    return out


def ordered_distinct(urls: DataFrame) -> DataFrame:
    """S3: first occurrence of each raw url string in (source, line, position) order.  A partial
    aggregation per url (``min`` of the order key), so a url repeated everywhere is combined
    map-side instead of collected."""
    first = urls.groupBy("url").agg(F.min(F.struct("source_no", "line_no", "pos")).alias("o"))
    return first.select("url", F.col("o.source_no").alias("source_no"), F.col("o.line_no").alias("line_no"),
                        F.col("o.pos").alias("pos"))


def submitted_urls(uploads: DataFrame, forms: DataFrame) -> DataFrame:
    """S1-S3 for many submissions: (submission, pos, url), the distinct urls of each in the order of
    its file, then its form.  ``uploads`` and ``forms`` are (submission, text); a submission may have
    either, both or none.  A text is one request's; its items are counted map-side per url and
    numbered in parallel chunks."""
    def items(texts: DataFrame, source_no: int) -> DataFrame:
        parts = texts.select("submission", F.posexplode(F.split("text", SEED_SPLIT_RE, -1)).alias("i", "raw"))
        return parts.select("submission", py_strip(F.col("raw")).alias("url"), (F.col("i").cast("long") + source_no * (1 << 40)).alias("ord"))

    both = items(uploads, 0).unionByName(items(forms, 1))
    urls = both.filter(F.col("url").startswith("http://") | F.col("url").startswith("https://"))
    first = urls.groupBy("submission", "url").agg(F.min("ord").alias("ord"))
    out = chunked_row_number(first, ["submission"], "ord", "pos")
    return out.select("submission", (F.col("pos") - 1).alias("pos"), "url")


def batch_submissions(submissions: DataFrame, urls: DataFrame) -> DataFrame:
    """J1's batch form and S3's error, one outcome for each whole submission (submission, max_pages,
    max_depth): rejected when a limit is out of bounds (more than the most pages is no error: it is
    capped) or when it holds no url.  ``urls`` is ``submitted_urls``'s result.

    Columns: submission, outcome, reject_reason, url_count, url (the first), max_pages, max_depth.
    """
    lists = urls.groupBy("submission").agg(F.count(F.lit(1)).alias("url_count"), F.min_by("url", "pos").alias("url"))
    df = submissions.select("submission", F.when(F.col("max_pages").isNotNull(), F.least("max_pages", F.lit(MAX_PAGES_RANGE[1]))).alias("max_pages"), "max_depth")
    df = df.join(lists, "submission", "left").fillna({"url_count": 0})
    reason = (F.when(F.coalesce(F.col("max_pages"), F.lit(0)) < MAX_PAGES_RANGE[0], F.lit("max_pages out of range"))
              .when(~F.coalesce(F.col("max_depth").between(*MAX_DEPTH_RANGE), F.lit(False)), F.lit("max_depth out of range"))
              .when(F.col("url_count") == 0, F.lit("no valid urls")))
    return df.select("submission", F.when(reason.isNull(), F.lit("accepted")).otherwise(F.lit("rejected")).alias("outcome"),
                     reason.alias("reject_reason"), "url_count", "url", "max_pages", "max_depth")


def expand_submissions(submissions: DataFrame, urls: DataFrame, jobs: DataFrame, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    """J7 for the accepted submissions (as ``batch_expand``, ``batch_id`` being the submission);
    ``submissions`` also has submitted_at."""
    good = batch_submissions(submissions, urls).filter(F.col("outcome") == "accepted").select("submission")
    starts = submissions.join(good, "submission", "left_semi").select("submission", "submitted_at")
    items = urls.join(starts, "submission").select(F.col("submission").alias("batch_id"), "submitted_at", "pos", "url")
    return expand_items(items, jobs, ttl_seconds)


def _norm(df: DataFrame, url: str, out: str) -> DataFrame:
    df = U.add_url_parts(df, url, "z")
    return U.drop_url_parts(U.add_normalized(df, "z", out), "z")


def cached_action(at: Column, status: Column, completed_at: Column, ttl_seconds: float = TTL_SECONDS) -> Column:
    """J2 reuse rule for a job as it stood at ``at``: 'drop' while it is unfinished then (its final
    status came later or never), 'reuse' when it was done less than ``ttl`` seconds before; else null."""
    unfinished = completed_at.isNull() | (completed_at > at)
    fresh = (status == "done") & (seconds_between(at, completed_at) < ttl_seconds)
    return F.when(unfinished, F.lit("drop")).when(fresh, F.lit("reuse"))


def batch_expand(batches: DataFrame, jobs: DataFrame, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    """J7 over batches that hold their urls as arrays; see ``expand_items``."""
    return expand_items(batches.select("batch_id", "submitted_at", F.posexplode("batch_urls").alias("pos", "url")), jobs, ttl_seconds)


def expand_items(items: DataFrame, jobs: DataFrame, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    """One row per batch url (batch_id, submitted_at, pos, url) with the action taken at the batch start:

    * 'reuse' -- the latest job for the normalized url was done then, within the ttl;
    * 'drop' -- that job was pending / running then, or an earlier url of the same batch already
      spawned a child for this normalized url;
    * 'spawn' -- a new child job.

    Every job counts, children of other batches included; a batch's own children are submitted
    after it looked, so at one instant the order is: jobs, batch urls, children.  The lookup is an
    as-of join: a window inside (url, time chunk) with a carry through the per-chunk summary, so a
    url shared by many jobs and batches never pairs every item with every job.  ``items`` is read once.
    Columns: batch_id, pos, url, norm_url, action, reused_job_id.
    """
    items = items.select("batch_id", "submitted_at", F.col("pos").cast("int").alias("pos"), "url")
    items = materialize(_norm(fence(items), "url", "norm_url"))  # urls are split once, not for each use
    cache = fence(_norm(jobs.select("job_id", "url", "status", "submitted_at", "completed_at", "parent_batch_id"), "url", "c_norm"))
    none = F.lit(None).cast("long")
    turn = F.when(F.col("parent_batch_id").isNull(), F.lit(0)).otherwise(F.lit(2))
    rows = cache.select(F.col("c_norm").alias("key"), epoch_micros(F.col("submitted_at")).alias("t"),
                        F.struct(turn.alias("turn"), F.col("job_id").alias("id")).alias("s"), F.col("job_id").alias("rid"),
                        none.alias("batch_id"), F.lit(None).cast("int").alias("pos"), F.lit(True).alias("mark")).unionByName(
        items.select(F.col("norm_url").alias("key"), epoch_micros(F.col("submitted_at")).alias("t"),
                     F.struct(F.lit(1).alias("turn"), none.alias("id")).alias("s"), none.alias("rid"),
                     F.col("batch_id").cast("long").alias("batch_id"), "pos", F.lit(False).alias("mark")))
    latest = asof_predecessor(rows, CHUNK_SECONDS, ("batch_id", "pos", "mark")).filter(~F.col("mark")).drop("mark")
    looked = latest.join(cache.select(F.col("job_id").alias("prev"), F.col("status").alias("c_status"),
                                      F.col("completed_at").alias("c_completed_at")), "prev")
    items = items.join(looked, ["batch_id", "pos"], "left")
    first_in_batch = items.groupBy("batch_id", "norm_url").agg(F.min("pos").alias("first_pos"))
    items = items.join(first_in_batch, ["batch_id", "norm_url"])
    cached = F.when(F.col("prev").isNotNull(), cached_action(F.col("submitted_at"), F.col("c_status"), F.col("c_completed_at"), ttl_seconds))
    action = F.coalesce(cached, F.when(F.col("pos") != F.col("first_pos"), F.lit("drop")).otherwise(F.lit("spawn")))
    return items.select("batch_id", F.col("pos").cast("int").alias("pos"), "url", "norm_url", action.alias("action"),
                        F.when(action == "reuse", F.col("prev")).alias("reused_job_id"))


def batch_children(expanded: DataFrame, jobs: DataFrame) -> DataFrame:
    """Spawned urls with their child job: the batch's child for the normalized url (the first, if
    the table holds several)."""
    own = ("job_id", "status", "pages_crawled", "pages_skipped", "error", "started_at", "completed_at")
    kids = fence(_norm(fence(jobs.filter(F.col("parent_batch_id").isNotNull())), "url", "norm_url"))
    kids = kids.groupBy(F.col("parent_batch_id").alias("batch_id"), "norm_url").agg(F.min(F.struct(*own)).alias("k"))
    return expanded.filter(F.col("action") == "spawn").join(kids, ["batch_id", "norm_url"]).select("batch_id", "pos", "url", "k.*")


def batch_result_rows(batches: DataFrame, jobs: DataFrame, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    """The result rows of every batch: reused results, finished children, children in progress.
    Columns: batch_id, pos, url, job_id, status, page_count, error, finished."""
    exp = materialize(batch_expand(batches, jobs, ttl_seconds))
    kids = batch_children(exp, jobs)
    finished = ~F.col("status").isin(*ACTIVE)
    pages = F.when(finished & (F.col("status") != "done"), F.lit(None)).otherwise(F.col("pages_crawled"))
    kid_rows = kids.select("batch_id", "pos", "url", "job_id", "status", pages.alias("page_count"), "error", finished.alias("finished"))
    done = jobs.select(F.col("job_id").alias("reused_job_id"), F.col("pages_crawled").alias("page_count"))
    reused = exp.filter(F.col("action") == "reuse").join(done, "reused_job_id").select(
        "batch_id", "pos", "url", F.col("reused_job_id").alias("job_id"), F.lit("done").alias("status"), "page_count",
        F.lit(None).cast("string").alias("error"), F.lit(True).alias("finished"))
    return reused.unionByName(kid_rows)


def batch_results(batches: DataFrame, jobs: DataFrame, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    """J8, J15 per batch: url_count and counts of its result rows (errors count as completed)."""
    counts = batch_result_rows(batches, jobs, ttl_seconds).groupBy("batch_id").agg(
        F.count_if(F.col("finished")).alias("completed_count"),
        F.count_if(F.col("status") == "done").alias("done_count"),
        F.count_if(~F.col("finished")).alias("in_progress_count"),
        F.count(F.lit(1)).alias("result_rows"),
    )
    return batches.select("batch_id", F.size("batch_urls").alias("url_count")).join(counts, "batch_id", "left") \
        .fillna({"completed_count": 0, "done_count": 0, "in_progress_count": 0, "result_rows": 0})


def batch_rollup(batches: DataFrame, jobs: DataFrame, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    """J9 per batch: pages of the spawned children summed; status running while a child is active,
    else done, or cancelled when a cancel was requested (children are not cancelled); duration from
    the batch start to the last child completion."""
    kids = batch_children(batch_expand(batches, jobs, ttl_seconds), jobs)
    agg = kids.groupBy("batch_id").agg(
        F.sum("pages_crawled").cast("long").alias("pages_crawled"), F.sum("pages_skipped").cast("long").alias("pages_skipped"),
        F.count_if(F.col("status").isin(*ACTIVE)).alias("active_children"),
        F.max("completed_at").alias("last_completed"), F.count(F.lit(1)).alias("children"),
    )
    df = batches.join(agg, "batch_id", "left").fillna({"pages_crawled": 0, "pages_skipped": 0, "active_children": 0, "children": 0})
    status = (F.when(F.col("active_children") > 0, F.lit("running"))
              .when(F.col("cancel_requested"), F.lit("cancelled")).otherwise(F.lit("done")))
    done = F.col("active_children") == 0
    return df.select(
        "batch_id", status.alias("status"), "pages_crawled", "pages_skipped", F.col("children").cast("long").alias("children"),
        F.when(done, F.coalesce(seconds_between(F.col("last_completed"), F.col("submitted_at")), F.lit(0.0))).alias("duration_seconds"),
        F.when(done, F.coalesce("last_completed", "submitted_at")).alias("completed_at"),
    )
