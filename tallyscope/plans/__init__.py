"""Named queries over whole tables and the SQL each one is checked against."""

from tallyscope.plans import (  # noqa: F401
    basket_queries,
    card_queries,
    claim_queries,
    lake_queries,
    quality_queries,
    storage_queries,
    transform_queries,
)
from tallyscope.plans.registry import PLANS, SQL

__all__ = ["PLANS", "SQL"]
