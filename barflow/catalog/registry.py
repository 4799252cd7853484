"""All registered queries and their SQL."""

from __future__ import annotations

from barflow.catalog import (
    bar_queries, exit_queries, loop_queries, signal_queries, source_queries, stream_queries, trade_queries,
    training_queries,
)

MODULES = (signal_queries, bar_queries, trade_queries, exit_queries, loop_queries, training_queries,
           stream_queries, source_queries)


def queries():
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
