"""Column summaries and the types inferred from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashlar.functions.names import named
from ashlar.functions.text import parsed_double

# Spark compiles a stage only up to 100 fields (spark.sql.codegen.maxFields). A column's
# summary takes about this many, without and with moments; wider tables are summarized in
# long form, where the number of fields does not depend on the number of columns.
STAGE_FIELDS = 96
SUMMARY_FIELDS = {False: 12, True: 21}

NUMERIC_TYPES = ("Int", "Double", "NumLabel")
SCALED_TYPES = ("Int", "Double")


@dataclass(frozen=True)
class ColumnStats:
    """One row of a profile, held by the driver: its size is the number of columns."""

    column: str
    col_idx: int
    count: int
    parsed: int
    mean: float
    variance: float
    stddev: float
    min: float
    max: float
    l1: float
    l2: float
    nonzeros: int
    all_whole: bool
    inferred_type: str
    skewness: float | None = None
    kurtosis: float | None = None


def found_number(df: DataFrame, name: str) -> Column:
    """The column as doubles, NULL where a text is no number. Other types hold none.

    NaN and infinity are no numbers either, in text as in numeric columns: they count as missing.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        value = named(name).cast("double")
        return F.when(F.abs(value) < float("inf"), value)
    if isinstance(kind, T.NumericType):
        return named(name).cast("double")
    if isinstance(kind, T.StringType):
        return parsed_double(named(name))
    return F.lit(None).cast("double")


def number(df: DataFrame, name: str) -> Column:
    """The column as doubles; text that is no number, and NULL, count as 0.0."""
    return F.coalesce(found_number(df, name), F.lit(0.0))


def numeric_view(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` unchanged and ``cols`` as doubles, nothing else read."""
    kept = [named(k) for k in keep]
    return df.select(*kept, *[number(df, c).alias(c) for c in cols])


def long_values(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell: ``keep``, ``column``, ``value``."""
    view = numeric_view(df, cols, keep)
    return view.unpivot([named(k) for k in keep], [named(c) for c in cols], "column", "value")


def column_index(cols: Sequence[str]) -> Column:
    """Position of the ``column`` field's value in ``cols``."""
    pairs = [F.lit(item) for i, name in enumerate(cols) for item in (name, i)]
    return F.element_at(F.create_map(*pairs), F.col("column"))


def _summary(found: str, moments: bool) -> list[str]:
    """The aggregates of one column, as SQL: one call to Spark instead of hundreds."""
    value = f"coalesce({found}, 0D)"
    parts = [
        "count(1) AS count",
        f"count({found}) AS parsed",
        f"avg({value}) AS mean",
        f"coalesce(var_samp({value}), 0D) AS variance",
        f"min({value}) AS min",
        f"max({value}) AS max",
        f"sum(abs({value})) AS l1",
        f"sqrt(sum({value} * {value})) AS l2",
        f"count_if({value} <> 0) AS nonzeros",
        f"bool_and(rint({value}) = {value}) AS all_whole",
    ]
    if moments:
        # Spark divides by the population deviation; these definitions use the sample one.
        shrink = "(1 - try_divide(1D, count(1)))"
        parts += [
            f"skewness({value}) * power({shrink}, 1.5D) AS skewness",
            f"(kurtosis({value}) + 3) * power({shrink}, 2) - 3 AS kurtosis",
        ]
    return parts


# A column is text if every summary of its numbers is zero.
IS_TEXT = "l1 = 0 AND l2 = 0 AND mean = 0 AND variance = 0 AND max = 0 AND min = 0"
TYPE_RULES = {
    # Int where every single value is whole.
    "exact": f"CASE WHEN {IS_TEXT} THEN 'String' WHEN all_whole THEN 'Int' ELSE 'Double' END",
    # Int where L1 norm, max and min are whole; two halves can fool it.
    "coarse": f"""CASE WHEN {IS_TEXT} THEN 'String'
        WHEN rint(l1) = l1 AND rint(max) = max AND rint(min) = min THEN 'Int' ELSE 'Double' END""",
    # The exact type, with likely identifiers set apart (needs the moments).
    "label": f"""CASE WHEN {IS_TEXT} THEN 'String' WHEN NOT all_whole THEN 'Double'
        WHEN min >= 0 AND (max > 10000 OR kurtosis < -1.2 OR kurtosis > 3.0) THEN 'NumLabel'
        ELSE 'Int' END""",
}


def profile(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    moments: bool = False,
    rule: str | None = None,
    least_parse_rate: float = 0.0,
) -> DataFrame:
    """One row per column: count, mean, variance, norms, extremes, inferred type.

    A column with a smaller share of numbers than ``least_parse_rate`` is text; by default a
    single number other than zero makes it numeric.

    A single partial and final aggregate over one scan of the named columns; only the
    summaries are shuffled, one row per column and task.
    """
    cols = list(cols if cols is not None else df.columns)
    moments = moments or rule == "label"
    rule = rule or ("label" if moments else "exact")
    if rule not in TYPE_RULES:
        raise ValueError(f"rule must be one of {sorted(TYPE_RULES)}")
    names = [f"found_{i}" for i in range(len(cols))]
    found = df.select(*[found_number(df, c).alias(n) for c, n in zip(cols, names)])
    if len(cols) * SUMMARY_FIELDS[moments] <= STAGE_FIELDS:
        rows = [f"struct({i} AS col_idx, {', '.join(_summary(n, moments))})" for i, n in enumerate(names)]
        # An empty table gives no rows, as grouping does.
        table = found.agg(F.expr(f"array({', '.join(rows)}) AS rows")).selectExpr("inline(rows)")
        table = table.filter("count > 0")
    else:
        cells = found.unpivot([], names, "cell", "found")
        table = cells.groupBy(F.expr("int(substring(cell, 7)) AS col_idx")).agg(
            *[F.expr(part) for part in _summary("found", moments)]
        )
    texts = F.array(*[F.lit(c) for c in cols])
    return table.select(
        texts[F.col("col_idx")].alias("column"),
        "*",
        F.expr("sqrt(variance) AS stddev"),
        F.expr(f"CASE WHEN parsed < double({least_parse_rate!r}) * count THEN 'String' ELSE {TYPE_RULES[rule]} END AS inferred_type"),
    )


def raw_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column, raw_moment3, raw_moment4_minus3``: means of the cubes and fourth powers."""
    cube = F.col("value") * F.col("value") * F.col("value")
    return long_values(df, cols).groupBy("column").agg(
        F.avg(cube).alias("raw_moment3"), (F.avg(cube * F.col("value")) - 3).alias("raw_moment4_minus3")
    )


def fit(
    df: DataFrame, cols: Sequence[str] | None = None, moments: bool = False, least_parse_rate: float = 0.0
) -> dict[str, ColumnStats]:
    """Run the profile once and keep its few rows, to be used as literals afterwards."""
    names = list(ColumnStats.__dataclass_fields__)
    table = profile(df, cols, moments, least_parse_rate=least_parse_rate)
    rows = table.select(*[n for n in names if n in table.columns]).orderBy("col_idx").collect()
    return {row["column"]: ColumnStats(**row.asDict()) for row in rows}


def of_type(stats: dict[str, ColumnStats], types: Sequence[str] = NUMERIC_TYPES) -> list[str]:
    return [s.column for s in stats.values() if s.inferred_type in types]


def numeric_columns(stats: dict[str, ColumnStats], cols: Sequence[str] | None = None) -> list[str]:
    """The numeric columns among ``cols``, in table order."""
    found = [c for c in of_type(stats) if cols is None or c in cols]
    if not found:
        raise ValueError("no numeric column")
    return found


def infer_types(
    df: DataFrame, cols: Sequence[str] | None = None, rule: str = "exact", least_parse_rate: float = 0.0
) -> DataFrame:
    """``column, col_idx, inferred_type, parse_rate`` by the exact, coarse or label rule."""
    return profile(df, cols, rule=rule, least_parse_rate=least_parse_rate).selectExpr(
        "column", "col_idx", "inferred_type", "parsed / count AS parse_rate"
    )
