"""Result shaping for charts: one point per mark, in an explicit order, aggregated whole.

No frame is cut here.  A chart that shows so many marks takes them from `cards.capped_payload`, which also tells the full count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions.money import mean_fixed, sum_fixed
from tallyscope.functions.ranking import top_n


class ChartColumnError(ValueError):
    """A chart names a column that is absent or not numeric."""


def numeric_column_check(df: DataFrame, columns: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    missing = [c for c in [*columns, *numeric] if c not in df.columns]
    if missing:
        raise ChartColumnError(f"missing columns {missing}")
    wrong = [c for c in numeric if not isinstance(df.schema[c].dataType, T.NumericType)]
    if wrong:
        raise ChartColumnError(f"columns {wrong} are not numeric")
    return df


def series_by_x(df: DataFrame, x: str, series: Sequence[str]) -> DataFrame:
    """Mean of each series per x, in x order."""
    numeric_column_check(df, [x], series)
    return df.groupBy(x).agg(*[mean_fixed(F.col(s).cast("double")).alias(s) for s in series]).orderBy(x)


def heatmap_matrix(df: DataFrame, row: str, col: str, value: str, columns: Sequence) -> DataFrame:
    """Mean per (row, column), one output column per listed value, rows in order."""
    numeric_column_check(df, [row, col], [value])
    return df.groupBy(row).agg(*[mean_fixed(F.col(value).cast("double"), F.col(col) == c).alias(str(c)) for c in sorted(columns)]).orderBy(row)


def first_per_label(df: DataFrame, label: str, order: Sequence[Column]) -> DataFrame:
    return top_n(df, [label], order, 1).drop("rn").orderBy(label)


def waterfall_contributions(df: DataFrame, driver: str, value: str) -> DataFrame:
    numeric_column_check(df, [driver], [value])
    return df.groupBy(driver).agg(sum_fixed(F.col(value).cast("double")).alias(value)).orderBy(F.desc(value), driver)


def geo_points(df: DataFrame, lat: str, lon: str, value: str, label: str, order: str) -> DataFrame:
    """Mean value per coordinate with the label that comes first."""
    numeric_column_check(df, [lat, lon, label], [value])
    return df.groupBy(lat, lon).agg(
        mean_fixed(F.col(value).cast("double")).alias(value), F.min_by(label, F.struct(order, label)).alias(label)
    ).orderBy(lat, lon)


def facet_series(df: DataFrame, facet: str, x: str, value: str) -> DataFrame:
    """Mean per (facet, x) of every facet that has a name."""
    numeric_column_check(df, [facet, x], [value])
    return df.filter(F.col(facet).isNotNull()).groupBy(facet, x).agg(mean_fixed(F.col(value).cast("double")).alias(value))
