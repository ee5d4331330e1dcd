"""sitefold: build one Markdown site index (``llms.txt``) per site from stored web pages, on Spark.

Layout
------
functions/   Column expressions (URL parsing, HTML text extraction, text helpers)
operators/   DataFrame -> DataFrame operators (metadata, titles, documents, robots,
             sitemaps, fetch log, crawl, requests, jobs, batches)
sources/     table readers, derived inputs, seed lists, sinks
plans/       registered queries and their DuckDB oracle SQL
streaming/   Structured Streaming forms of the request/job operators
"""

from sitefold.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
