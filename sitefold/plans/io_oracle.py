"""DuckDB oracle SQL for ``io_queries.py``: the written files equal the documents; the streams
equal their batch forms."""

from __future__ import annotations

from sitefold.plans import job_oracle as J
from sitefold.plans import site_oracle as SO
from sitefold.plans import sqlparts as S


def site_files() -> str:
    s = S.url_parts(f"SELECT root_url, llms_txt FROM ({SO.site_documents()})", "root_url", "h")
    return f"SELECT {S.hostname('h')} AS hostname, llms_txt, CAST(length(llms_txt) AS BIGINT) AS chars FROM ({s})"


def site_archive() -> str:
    docs = SO.site_documents()
    rows = (f"SELECT 0 AS pos, root_url AS url, llms_txt FROM ({docs}) UNION ALL "
            f"SELECT 1 AS pos, 'http://' || site || '/' AS url, llms_txt || '<!-- again -->' || chr(10) FROM ({docs})")
    s = S.url_parts(f"SELECT * FROM ({rows}) WHERE llms_txt IS NOT NULL AND llms_txt != ''", "url", "h")
    s = f"SELECT pos, llms_txt, {S.hostname('h')} AS hostname FROM ({s})"
    return (f"SELECT CAST(0 AS BIGINT) AS batch_id, hostname || '-llms.txt' AS entry, llms_txt, CAST(n - 1 AS BIGINT) AS replaced FROM "
            f"(SELECT *, row_number() OVER (PARTITION BY hostname ORDER BY pos DESC) AS r, count(*) OVER (PARTITION BY hostname) AS n "
            f"FROM ({s})) WHERE r = 1")


def stream_progress() -> str:
    return ("SELECT l_orderkey AS job_id, count(*) FILTER (WHERE l_returnflag != 'R') AS pages_crawled, "
            "count(*) FILTER (WHERE l_returnflag = 'R') AS pages_skipped FROM lineitem GROUP BY l_orderkey")


def stream_results() -> str:
    return (f"SELECT parent_batch_id AS batch_id, job_id, url, status, CASE WHEN status = 'done' THEN pages_crawled END AS page_count, "
            f"error FROM ({J.jobs()}) WHERE parent_batch_id IS NOT NULL AND status IN ('done', 'error', 'cancelled')")


ORACLE = {
    "site_files": site_files,
    "site_archive": site_archive,
    "stream_dedup": J.request_dedup,
    "stream_metrics": J.job_metrics,
    "stream_progress": stream_progress,
    "stream_results": stream_results,
}
