"""All registered queries of the evaluation operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "bs1_scaling_fit"
QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function, and the SQL for the same rows."""

    def put(f: Callable) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


from plumbline.plans import (  # noqa: E402, F401
    aggregate_queries,
    clause_queries,
    function_queries,
    identity_queries,
    join_queries,
    model_queries,
    reader_queries,
    resampling_queries,
    rule_queries,
    source_queries,
    split_queries,
    window_queries,
)
