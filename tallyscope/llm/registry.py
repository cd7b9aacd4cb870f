"""Named queries of this subpackage and their check SQL."""

from __future__ import annotations

PLANS: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(plan):
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return add
