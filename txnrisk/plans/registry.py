"""Query catalogue: name -> (Spark builder, oracle SQL).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame.  The SQL
is the DuckDB oracle for the same result; the shared fixture views are
prepended as CTEs (``FIXTURE_CTE``).  A body that starts with ``,`` continues
the WITH list with its own CTEs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from txnrisk.plans.oracle import FIXTURE_CTE

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class QuerySpec:
    name: str
    build: Builder
    sql: str | None


REGISTRY: dict[str, QuerySpec] = {}


def with_fixtures(body: str, events: str = "events") -> str:
    return FIXTURE_CTE.strip().replace("FROM events e", f"FROM {events} e") + "\n" + body.strip()


def query(name: str, sql: str | None = None, events: str = "events"):
    """Register a query.  ``events``: what the oracle's fixture views read as
    the events table."""
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(name, fn, with_fixtures(sql, events) if sql else None)
        return fn
    return deco


def load_all() -> dict[str, QuerySpec]:
    # importing the catalogue modules registers their queries
    from txnrisk.plans import (catalog_detect, catalog_eval, catalog_features, catalog_models,  # noqa: F401
                               catalog_serving, catalog_small, catalog_state,
                               catalog_store, catalog_stream)
    return REGISTRY
