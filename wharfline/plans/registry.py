"""Queries over the driver's tables, and SQL for the same rows."""

from __future__ import annotations

from wharfline.plans import case_queries, flow_queries, ops_queries, paper_queries, stream_queries

QUERIES: dict = {**case_queries.QUERIES, **ops_queries.QUERIES, **flow_queries.QUERIES, **paper_queries.QUERIES, **stream_queries.QUERIES}
ORACLES: dict = {**case_queries.ORACLES, **ops_queries.ORACLES, **flow_queries.ORACLES, **paper_queries.ORACLES, **stream_queries.ORACLES}
