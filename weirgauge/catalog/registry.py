"""Named queries with the SQL text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weirgauge.sources.lineitem_flows import FLOWS_CTE, plain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, with_flows: bool = True) -> Callable[[Query], Query]:
    """Register a query.  ``sql`` starts with further CTEs (``a AS (...),``) or ``SELECT``."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            text = sql.strip()
            if with_flows:
                text = f"WITH {FLOWS_CTE.strip()}{',' if not text.upper().startswith('SELECT') else ''}\n{text}"
            ORACLES[name] = text
        return fn

    return add
