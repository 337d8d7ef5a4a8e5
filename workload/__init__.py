"""Queries over the given tables, one module per family of operators."""

from importlib import import_module, util

MODULES = ["files_queries", "text_queries", "chunk_queries", "canonical_queries", "graph_queries",
           "community_queries", "retrieval_queries", "question_queries", "evaluation_queries",
           "stream_queries"]


def load():
    """All queries and oracles."""
    for name in MODULES:
        if util.find_spec(f"{__name__}.{name}"):
            import_module(f"{__name__}.{name}")
    from workload.registry import ORACLES, QUERIES
    return QUERIES, ORACLES
