"""Scan for cells inside or outside an interval of their column."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashlar.functions.names import named
from ashlar.operators import ranks
from ashlar.operators.normalize import scaled_columns
from ashlar.operators.profile import ColumnStats, column_index, fit, found_number, number

INTERVALS = ("INLIER", "OUTLIER")
FEATURES = ("ZERO", "MEAN", "MEDIAN", "MODE", "NONE")
# Limits used when the given ones are in the wrong order.
DEFAULT_LIMITS = {"INLIER": (0.2, 0.8), "OUTLIER": (-3.0, 3.0)}


def check_options(
    interval: str, feature: str, low: float, high: float
) -> tuple[str, str, float, float]:
    """Upper-case the options and replace invalid ones by their defaults, with a warning."""
    chosen_interval, chosen_feature = interval.upper(), feature.upper()
    if chosen_interval not in INTERVALS:
        warnings.warn(f"interval {interval!r} is not one of {INTERVALS}; using INLIER")
        chosen_interval = "INLIER"
    if chosen_feature not in FEATURES:
        warnings.warn(f"feature {feature!r} is not one of {FEATURES}; using MEAN")
        chosen_feature = "MEAN"
    if low > high:
        warnings.warn(f"lower limit {low} is greater than upper limit {high}; using the defaults")
        low, high = DEFAULT_LIMITS[chosen_interval]
    return chosen_interval, chosen_feature, low, high


def _centres(df, cols, feature, stats) -> dict[str, float]:
    if feature == "MEAN":
        return {c: stats[c].mean for c in cols}
    if feature in ("MEDIAN", "MODE") and cols:
        table = (ranks.median if feature == "MEDIAN" else ranks.mode)(df, cols, stats=stats)
        return {row[0]: row[1] for row in table.collect()}
    return {c: 0.0 for c in cols}


def bounds(
    df: DataFrame,
    cols: Sequence[str],
    interval: str,
    feature: str,
    low: float,
    high: float,
    stats: dict[str, ColumnStats],
    centres: dict[str, float] | None = None,
) -> dict[str, tuple[float, float, float, float]]:
    """Lower and upper bound of each column, with origin and unit of the deviation.

    ``centres`` are medians or modes that the caller knows already.
    """
    if interval == "INLIER":
        span = {c: stats[c].max - stats[c].min for c in cols}
        return {
            c: (stats[c].min + low * span[c], stats[c].min + high * span[c], stats[c].min, span[c])
            for c in cols
        }
    if feature == "NONE":
        return {c: (stats[c].min, stats[c].max, 0.0, 0.0) for c in cols}
    centre = centres if centres is not None else _centres(df, cols, feature, stats)
    return {
        c: (
            centre[c] + low * stats[c].stddev,
            centre[c] + high * stats[c].stddev,
            centre[c],
            stats[c].stddev,
        )
        for c in cols
    }


def scan(
    df: DataFrame,
    key: str,
    cols: Sequence[str] | None = None,
    interval: str = "OUTLIER",
    feature: str = "MEDIAN",
    low: float = -3.0,
    high: float = 3.0,
    order: str | None = "row",
    stats: dict[str, ColumnStats] | None = None,
    centres: dict[str, float] | None = None,
) -> DataFrame:
    """Every hit as ``key, column, col_idx, value, low, high, deviation``.

    Hits lie strictly inside (inlier) or strictly outside (outlier) the bounds. Rows
    without a hit are dropped first, by plain comparisons with literals that reach a
    Parquet scan; only the rest is turned into one row per cell. ``order`` is ``"row"``
    (row, then column), ``"column"`` or ``None`` for no sort.
    """
    interval, feature, low, high = check_options(interval, feature, low, high)
    stats = stats or fit(df, cols, moments=True)
    cols = scaled_columns(stats, cols)
    limits = bounds(df, cols, interval, feature, low, high, stats, centres)

    def hit(value, lower, upper):
        if interval == "INLIER":
            return (value > lower) & (value < upper)
        return (value < lower) | (value > upper)

    def may_hit(name: str):
        lower, upper = limits[name][:2]
        if not isinstance(df.schema[name].dataType, T.NumericType):
            return hit(number(df, name), lower, upper)
        # The bare column, so that the scan can skip row groups; what is no number stands for zero.
        zero_hits = lower < 0.0 < upper if interval == "INLIER" else not lower <= 0.0 <= upper
        found = hit(named(name), F.lit(lower), F.lit(upper))
        return found | found_number(df, name).isNull() if zero_hits else found

    some = reduce(lambda a, b: a | b, [may_hit(c) for c in cols], F.lit(False))
    cells = (
        df.filter(some)
        .select(named(key), *[number(df, c).alias(c) for c in cols])
        .unpivot([named(key)], [named(c) for c in cols], "column", "value")
    )
    table = F.create_map(
        *[
            x
            for c in cols
            for x in (F.lit(c), F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(limits[c], ("low", "high", "origin", "unit"))]))
        ]
    )
    found = cells.withColumn("limits", F.element_at(table, F.col("column"))).select(
        key,
        "column",
        column_index(list(stats)).alias("col_idx"),
        "value",
        F.col("limits.low").alias("low"),
        F.col("limits.high").alias("high"),
        F.when(F.col("limits.unit") == 0, 0.0)
        .otherwise(F.try_divide(F.col("value") - F.col("limits.origin"), F.col("limits.unit")))
        .alias("deviation"),
    )
    hits = found.filter(hit(F.col("value"), F.col("low"), F.col("high")))
    if order is None:
        return hits
    if order not in ("row", "column"):
        raise ValueError("order must be 'row', 'column' or None")
    return hits.orderBy(*((key, "col_idx") if order == "row" else ("col_idx", key)))
