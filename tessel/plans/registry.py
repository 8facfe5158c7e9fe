"""Registered queries of the engine's own operators: name -> query, name -> DuckDB SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from tessel.plans import conversations, evaluation, ingestion, lookups, maintenance, models, outputs, polling, profiles, rendering, retrieval, sequences, tables, writing  # noqa: E402, F401
