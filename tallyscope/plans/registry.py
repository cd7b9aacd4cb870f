"""Registry of named queries: a Spark plan and, where plain SQL can say the same, the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        if name in PLANS:
            raise KeyError(f"query {name!r} registered twice")
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql.strip()
        return plan

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Interpolated values, cut where two engines' last bits may part."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
