"""All queries of the reference's operators, by operator id, and their DuckDB SQL."""

from __future__ import annotations

from evidex.plans import q_compounds, q_graph, q_literature, q_memory, q_sources, q_streams

MODULES = (q_sources, q_literature, q_compounds, q_graph, q_memory, q_streams)


def flagship(spark, sf_dir):
    return q_literature.search(spark, sf_dir)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
