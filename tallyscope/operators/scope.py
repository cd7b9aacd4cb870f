"""Own-data filters, tenant scope, analysis window and viewer checks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_COMPARISON_DAYS = 14


class UnknownViewerError(ValueError):
    """The viewer is not a merchant of the panel."""


@dataclass(frozen=True)
class Window:
    """Half-open date range `[start, end)`."""

    start: dt.date
    end: dt.date

    def holds(self, ts: Column) -> Column:
        # Compared without a cast on the column, so the range reaches the Parquet scan.
        return (ts >= F.lit(self.start)) & (ts < F.lit(self.end))

    @property
    def last_day(self) -> dt.date:
        return self.end - dt.timedelta(days=1)


@dataclass(frozen=True)
class Filters:
    """Card filters: inclusive dates, stores, categories; an empty list means no constraint."""

    date_start: dt.date | None = None
    date_end: dt.date | None = None
    stores: Sequence[Any] = field(default=())
    categories: Sequence[str] = field(default=())


def filtered_txns(txns: DataFrame, filters: Filters, ts: str = "txn_ts") -> DataFrame:
    if filters.date_start is not None:
        txns = txns.filter(F.col(ts) >= F.lit(filters.date_start))
    if filters.date_end is not None:
        txns = txns.filter(F.col(ts) < F.lit(filters.date_end + dt.timedelta(days=1)))
    if filters.stores:
        txns = txns.filter(F.col("store_id").isin(*filters.stores))
    return txns


def category_filter(lines: DataFrame, filters: Filters) -> DataFrame:
    return lines.filter(F.col("category").isin(*filters.categories)) if filters.categories else lines


def row_filter(df: DataFrame, conditions: Mapping[str, Any]) -> DataFrame:
    """AND of equalities; a list value means any of its members."""
    for name, value in conditions.items():
        if name not in df.columns:
            raise LookupError(f"no column {name!r}")
        many = isinstance(value, (list, tuple, set, frozenset))
        df = df.filter(F.col(name).isin(*value) if many else F.col(name) == F.lit(value))
    return df


def check_viewer(merchants: DataFrame, viewer: str) -> str:
    """Raise unless the viewer is a merchant (one-row lookup)."""
    if merchants.filter(F.col("merchant_id") == viewer).isEmpty():
        raise UnknownViewerError(f"unknown viewer {viewer!r}")
    return viewer


def tenant_scope(
    tables: Mapping[str, DataFrame], viewer: str, window: Window | None = None, banner_col: str = "banner_code"
) -> dict[str, DataFrame]:
    """The viewer's slice of every tenant table; items follow the scoped transactions by semi join.

    `promotions` and `merchants` carry `merchant_id` instead of a banner column.
    """
    out: dict[str, DataFrame] = {}
    if "transactions" in tables:
        txns = tables["transactions"].filter(F.col(banner_col) == viewer)
        out["transactions"] = txns.filter(window.holds(F.col("txn_ts"))) if window else txns
    for name, df in tables.items():
        if name == "transactions":
            continue
        if name == "transaction_items":
            out[name] = items_of(df, out["transactions"])
        elif banner_col in df.columns and name != "merchants":
            out[name] = df.filter(F.col(banner_col) == viewer)
        else:
            out[name] = df.filter(F.col("merchant_id") == viewer)
    return out


def items_of(items: DataFrame, txns: DataFrame, keys: Sequence[str] = ("txn_id",)) -> DataFrame:
    """Items whose transaction is in `txns`."""
    return items.join(txns.select(*keys), list(keys), "left_semi")


def lake_window_scope(lake: DataFrame, window: Window) -> DataFrame:
    return lake.filter(window.holds(F.col("txn_date")))


def window_too_narrow(start: dt.date | Column, end: dt.date | Column, min_days: int = MIN_COMPARISON_DAYS) -> Column:
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return F.datediff(b, a) < min_days
