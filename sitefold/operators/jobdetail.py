"""Details of jobs in tables of bounded rows (J4, J8, J12): what a job's detail holds as lists or as one
long text -- skipped urls, crawled pages, its document -- is kept as numbered child rows, and a manifest
row per job says how many there are.  Only a sink joins them into one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.functions.plan import chunked_row_number
from sitefold.operators.documents import joined_parts

#: Child rows of one page.
PAGE_ROWS = 1000


def child_pages(rows: DataFrame, key: str, kind: str, order: str) -> DataFrame:
    """``rows`` of (``key``, ``kind``, ``order``, ...) numbered per key and kind in the integer ``order``:
    ``page_no`` from 0, ``slot`` within the page."""
    numbered = chunked_row_number(rows, [key, kind], order, "number").withColumn("number", F.col("number") - 1)
    return numbered.withColumns({"page_no": F.floor(F.col("number") / PAGE_ROWS).cast("long"), "slot": (F.col("number") % PAGE_ROWS).cast("int")}).drop("number")


def manifest(jobs: DataFrame, children: DataFrame, parts: DataFrame, key: str, kinds: tuple[str, ...]) -> DataFrame:
    """``jobs`` (``key``, status, ...) with, for each kind, its number of rows and pages, and the number
    of its document's parts and characters -- null unless the job is done (J12)."""
    per = children.groupBy(key).pivot("kind", list(kinds)).agg(F.count(F.lit(1)).alias("rows"), F.max("page_no").alias("last"))
    per = per.select(key, *[c for k in kinds for c in (F.coalesce(f"{k}_rows", F.lit(0)).alias(f"{k}_rows"),
                                                       F.coalesce(F.col(f"{k}_last") + 1, F.lit(0)).alias(f"{k}_pages"))])
    doc = parts.groupBy(key).agg(F.count(F.lit(1)).alias("document_parts"), F.sum(F.length("text")).alias("document_chars"))
    out = jobs.join(per, key, "left").fillna(0, [f"{k}_{n}" for k in kinds for n in ("rows", "pages")]).join(doc, key, "left")
    done = F.col("status") == "done"
    return out.withColumns({n: F.when(done, F.col(n)) for n in ("document_parts", "document_chars")})


def with_documents(results: DataFrame, parts: DataFrame) -> DataFrame:
    """J8 at its sink: result rows (job_id, status, ...) with ``llms_txt``, the whole document of a done
    job.  ``parts`` is (job_id, part_no, text, root_url, page_count).  Rows are put together without
    any text; only the documents they name are joined up, and meet them once."""
    wanted = results.where(F.col("status") == "done").select("job_id").distinct()
    named = parts.join(wanted, "job_id", "left_semi").withColumnRenamed("job_id", "site")
    docs = joined_parts(named).select(F.col("site").alias("job_id"), "llms_txt")
    out = results.join(docs, "job_id", "left")
    return out.withColumn("llms_txt", F.when(F.col("status") == "done", F.col("llms_txt")))
