"""Registered queries for sinks (K1-K3) and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitefold.functions.plan import materialize
from sitefold.operators.documents import document_parts, site_documents
from sitefold.operators.pages import page_meta
from sitefold.sources import sinks as K
from sitefold.sources.tables import read_table
from sitefold.streaming import streams as X


def q_site_files(spark, sf_dir):
    """K1, K3: write one document per hostname, read the files back whole."""
    parts = document_parts(page_meta(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])))
    path = K.scratch_path(spark, "site_files")
    K.write_site_files(parts, path)
    back = K.read_site_files(spark, path)
    return back.select("hostname", "llms_txt", F.length("llms_txt").cast("long").alias("chars"))


def q_site_archive(spark, sf_dir):
    """K2: every site's document submitted twice in one batch (https root, then the http
    spelling of the same host); the archive keeps the later one per hostname."""
    docs = materialize(site_documents(page_meta(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))))
    first = docs.select(F.lit(0).cast("long").alias("batch_id"), F.lit(0).alias("pos"), F.col("root_url").alias("url"), "llms_txt")
    second = docs.select(F.lit(0).cast("long").alias("batch_id"), F.lit(1).alias("pos"),
                         F.concat(F.lit("http://"), F.col("site"), F.lit("/")).alias("url"),
                         F.concat(F.col("llms_txt"), F.lit("<!-- again -->\n")).alias("llms_txt"))
    return K.archive_entries(first.unionByName(second))


def q_stream_dedup(spark, sf_dir):
    return X.stream_request_dedup(spark, sf_dir, lateness_seconds=86_400).select("request_id", "norm_url", "kept", "job_request_id")


def q_stream_metrics(spark, sf_dir):
    return X.stream_job_metrics(spark, sf_dir)


def q_stream_progress(spark, sf_dir):
    return X.stream_job_progress(spark, sf_dir)


def q_stream_results(spark, sf_dir):
    return X.stream_terminal_results(spark, sf_dir)


QUERIES = {
    "site_files": q_site_files,
    "site_archive": q_site_archive,
    "stream_dedup": q_stream_dedup,
    "stream_metrics": q_stream_metrics,
    "stream_progress": q_stream_progress,
    "stream_results": q_stream_results,
}
