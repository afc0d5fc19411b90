"""All queries of the core library."""

from __future__ import annotations

from vaultframe.plans import archive_queries, content_queries, pipeline_queries, store_queries

FLAGSHIP = "dedupe_stats"
QUERIES = {**archive_queries.QUERIES, **content_queries.QUERIES, **store_queries.QUERIES, **pipeline_queries.QUERIES}
SQL = {**archive_queries.SQL, **content_queries.SQL, **store_queries.SQL, **pipeline_queries.SQL}
