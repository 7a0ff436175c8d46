"""Importing this package registers every query of the engine."""

from tarnfell.plans import assistant_queries, catalog_queries, detail_queries, graph_queries, index_queries, io_queries, job_queries, report_queries, retrieval_queries, stream_queries  # noqa: F401
