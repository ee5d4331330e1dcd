"""Registered queries for requests, jobs, batches and seed lists (tables derived from orders,
lineitem, events and pages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitefold.functions.plan import materialize
from sitefold.operators import batches as B
from sitefold.operators import jobdetail as D
from sitefold.operators import joblog as L
from sitefold.operators import jobs as J
from sitefold.operators import requests as R
from sitefold.operators.documents import document_parts
from sitefold.sources import jobtables as T
from sitefold.sources.tables import read_table


def q_seed_list(spark, sf_dir):
    """Parsed, order-preserving distinct seed urls of the two sources."""
    return B.ordered_distinct(B.parse_seed_lines(T.seed_lines(spark, sf_dir)))


def q_batch_submissions(spark, sf_dir):
    """S1-S3 + J1: an outcome for every batch submission, read from its file and its form."""
    table, uploads, forms = T.submissions_table(spark, sf_dir)
    return B.batch_submissions(table, B.submitted_urls(uploads, forms))


def q_submission_expand(spark, sf_dir):
    """J7 fed by the accepted submissions."""
    table, uploads, forms = T.submissions_table(spark, sf_dir)
    return B.expand_submissions(table, materialize(B.submitted_urls(uploads, forms)), T.jobs_table(spark, sf_dir))


def q_request_validation(spark, sf_dir):
    out = R.validate_requests(T.requests_table(spark, sf_dir))
    return out.select("request_id", "url", "max_pages", "max_depth", "reject_reason", "accepted_url")


def q_request_dedup(spark, sf_dir):
    out = R.request_dedup(T.requests_table(spark, sf_dir))
    return out.select("request_id", "norm_url", "kept", "job_request_id")


def q_job_states(spark, sf_dir):
    return J.job_states(T.jobs_table(spark, sf_dir), T.AS_OF)


def q_job_event_states(spark, sf_dir):
    """States, times and durations folded from the event log."""
    return L.job_event_states(T.job_events_table(spark, sf_dir))


def q_job_cancels(spark, sf_dir):
    """What every cancel request of the event log met."""
    return L.cancel_outcomes(T.job_events_table(spark, sf_dir))


def q_job_listing(spark, sf_dir):
    jobs = T.jobs_table(spark, sf_dir)
    batches = T.batches_table(spark, sf_dir)
    return J.job_listing(jobs, batches, B.batch_rollup(batches, jobs), T.AS_OF)


def q_job_listing_done(spark, sf_dir):
    jobs = T.jobs_table(spark, sf_dir)
    batches = T.batches_table(spark, sf_dir)
    return J.job_listing(jobs, batches, B.batch_rollup(batches, jobs), T.AS_OF, status="done")


def q_job_detail(spark, sf_dir):
    return J.job_detail(T.jobs_table(spark, sf_dir), T.AS_OF)


def q_job_lookup(spark, sf_dir):
    """J4 by id for every key a line item or its successor names; successors may not exist."""
    ids = read_table(spark, sf_dir, "lineitem", ["l_orderkey"]).select(F.explode(F.array("l_orderkey", F.col("l_orderkey") + 1)).alias("job_id")).distinct()
    return J.job_lookup(T.jobs_table(spark, sf_dir), ids, T.AS_OF).select("job_id", "found", "status", "page_count", "error")


def q_job_metrics(spark, sf_dir):
    return J.job_metrics(T.jobs_table(spark, sf_dir))


def q_recent_jobs(spark, sf_dir):
    return J.recent_jobs(T.jobs_table(spark, sf_dir), 10)


def q_batch_expand(spark, sf_dir):
    jobs = T.jobs_table(spark, sf_dir)
    return B.batch_expand(T.batches_table(spark, sf_dir), jobs)


def q_batch_results(spark, sf_dir):
    jobs = T.jobs_table(spark, sf_dir)
    return B.batch_results(T.batches_table(spark, sf_dir), jobs)


def q_batch_result_rows(spark, sf_dir):
    return B.batch_result_rows(T.batches_table(spark, sf_dir), T.jobs_table(spark, sf_dir))


def job_document_parts(spark, sf_dir):
    """(job_id, root_url, page_count, part_no, text): the documents of the done jobs, in parts."""
    jobs = T.jobs_table(spark, sf_dir).where(F.col("status") == "done")
    sites = jobs.select(F.col("job_id").cast("string").alias("site"), F.col("url").alias("root_url"))
    parts = document_parts(T.job_pages_table(spark, sf_dir), sites)
    return parts.withColumn("job_id", F.col("site").cast("long")).drop("site")


def q_batch_result_documents(spark, sf_dir):
    """J8 whole: the result rows of every batch with the documents of the done jobs."""
    rows = B.batch_result_rows(T.batches_table(spark, sf_dir), T.jobs_table(spark, sf_dir))
    return D.with_documents(rows, job_document_parts(spark, sf_dir))


def q_batch_rollup(spark, sf_dir):
    jobs = T.jobs_table(spark, sf_dir)
    return B.batch_rollup(T.batches_table(spark, sf_dir), jobs)


QUERIES = {
    "seed_list": q_seed_list,
    "batch_submissions": q_batch_submissions,
    "submission_expand": q_submission_expand,
    "request_validation": q_request_validation,
    "request_dedup": q_request_dedup,
    "job_states": q_job_states,
    "job_event_states": q_job_event_states,
    "job_cancels": q_job_cancels,
    "job_listing": q_job_listing,
    "job_listing_done": q_job_listing_done,
    "job_detail": q_job_detail,
    "job_lookup": q_job_lookup,
    "job_metrics": q_job_metrics,
    "recent_jobs": q_recent_jobs,
    "batch_expand": q_batch_expand,
    "batch_results": q_batch_results,
    "batch_result_rows": q_batch_result_rows,
    "batch_result_documents": q_batch_result_documents,
    "batch_rollup": q_batch_rollup,
}
