"""All registered queries and their DuckDB oracle SQL builders."""

from __future__ import annotations

from sitefold.plans import crawl_oracle, crawl_queries, io_oracle, io_queries, job_oracle, job_queries, site_oracle, site_queries

QUERIES = {}
ORACLE_SQL = {}

for _q in (site_queries.QUERIES, crawl_queries.QUERIES, job_queries.QUERIES, io_queries.QUERIES):
    QUERIES.update(_q)
for _o in (site_oracle.ORACLE, job_oracle.ORACLE, crawl_oracle.ORACLE, io_oracle.ORACLE):
    ORACLE_SQL.update(_o)
