"""Registry of named queries: a Spark plan builder and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: tuple[str, ...] = ()) -> Callable[[Plan], Plan]:
    """Register a plan. Columns in ``doubles`` are decimals that are published as doubles."""

    def add(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def published(spark: SparkSession, folder: str) -> DataFrame:
            return plan(spark, folder).withColumns({c: F.col(c).cast("double") for c in doubles})

        QUERIES[name] = published if doubles else plan
        if sql is not None:
            casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in doubles)
            SQL[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if doubles else sql
        return plan

    return add
