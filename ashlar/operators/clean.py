"""From jagged lines to a rectangular table.

A table of lines has the columns ``row_id`` (any sortable identity) and ``value``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashlar.functions.names import named
from ashlar.functions.text import (
    SENTINEL,
    SEPARATOR,
    field_count,
    fields,
    lenient_double,
    parsed_double,
    unquote,
)


@dataclass(frozen=True)
class Table:
    """A rectangular table, the lines that did not fit and what was found about both."""

    rows: DataFrame
    rejected: DataFrame
    names: list[str]
    shape: dict
    header: bool = True


def measured(lines: DataFrame) -> DataFrame:
    """Lines without quotes, with their field counts ``n_fields``."""
    return lines.select("row_id", unquote(F.col("value")).alias("value")).withColumn(
        "n_fields", field_count(F.col("value"))
    )


def field_shape(lines: DataFrame) -> DataFrame:
    """One row: ``n_rows, min_fields, max_fields, jagged, widest_row, header``.

    The widest row is the first one with the most fields. Rows as wide as that are the
    ones kept later, so it is their header as well, and one aggregate finds everything.
    """
    earliest = F.struct((-F.col("n_fields")).alias("narrow"), F.col("row_id"))
    return measured(lines).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("n_fields").alias("min_fields"),
        F.max("n_fields").alias("max_fields"),
        (F.min("n_fields") != F.max("n_fields")).alias("jagged"),
        F.min_by("row_id", earliest).alias("widest_row"),
        F.min_by("value", earliest).alias("header"),
    )


def stage_counts(lines: DataFrame) -> DataFrame:
    """``stage, rows`` for the lines read, too short and rectangular, from one scan."""
    widths = measured(lines).groupBy("n_fields").agg(F.count(F.lit(1)).alias("rows"))
    return widths.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total"),
        F.coalesce(F.max_by("rows", "n_fields"), F.lit(0)).alias("widest"),
    ).selectExpr(
        """inline(array(struct('read' AS stage, total AS rows),
                        struct('short' AS stage, total - widest AS rows),
                        struct('rectangular' AS stage, widest AS rows)))"""
    )


def append_sentinel(lines: DataFrame) -> DataFrame:
    """Lines with the constant trailing field."""
    return lines.withColumn("value", F.concat("value", F.lit(SEPARATOR + SENTINEL)))


def drop_sentinel(table: DataFrame) -> DataFrame:
    """The table without its trailing constant column."""
    return table.drop(SENTINEL)


def short_rows(lines: DataFrame, width: int) -> DataFrame:
    """Lines with fewer fields than the widest, for review."""
    return measured(lines).filter(F.col("n_fields") < width)


def rectangular_rows(lines: DataFrame, width: int) -> DataFrame:
    """Lines with exactly ``width`` fields."""
    return measured(lines).filter(F.col("n_fields") == width)


def drop_header(lines: DataFrame, header: str) -> DataFrame:
    """Lines without any copy of the header, wherever it stands."""
    return lines.filter(F.col("value") != header)


def is_header(value: Column) -> Column:
    """True for a line none of whose fields is a number other than zero."""
    return ~F.exists(fields(value), lambda field: lenient_double(field) != 0)


def detect_header(lines: DataFrame) -> DataFrame:
    """The first two lines with ``looks_like_header``; the second counts only after the first."""
    leading = (
        lines.orderBy("row_id").limit(2).agg(F.sort_array(F.collect_list(F.struct("row_id", "value"))).alias("rows"))
    )
    first, second = F.get("rows", F.lit(0)), F.get("rows", F.lit(1))
    judged = F.array(
        F.struct(F.lit(1).alias("line"), first["value"].alias("value"), is_header(first["value"]).alias("looks_like_header")),
        F.struct(
            F.lit(2).alias("line"),
            second["value"].alias("value"),
            (is_header(first["value"]) & is_header(second["value"])).alias("looks_like_header"),
        ),
    )
    return leading.select(F.inline(judged)).filter(F.col("value").isNotNull())


def split_fields(lines: DataFrame) -> DataFrame:
    """One row per field: ``row_id, col_idx, field``."""
    return lines.select("row_id", F.posexplode(fields(F.col("value"))).alias("col_idx", "field"))


def unique_names(header: Sequence[str]) -> list[str]:
    """Header fields as column names: blanks get their position, repeats a number."""
    names: list[str] = []
    taken = {"row_id"}
    for i, raw in enumerate(header):
        base = raw.strip().replace("`", "_") or f"c{i}"
        name, again = base, 2
        while name.lower() in taken:
            name, again = f"{base}_{again}", again + 1
        taken.add(name.lower())
        names.append(name)
    return names


def to_columns(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rectangular lines as ``row_id`` and one text column per field."""
    parts = lines.select("row_id", fields(F.col("value")).alias("parts"))
    return parts.select("row_id", *[F.get("parts", F.lit(i)).alias(n) for i, n in enumerate(names)])


def rectangularize(lines: DataFrame, header: bool | None = True) -> Table:
    """Clean lines into a table.

    One aggregate over the lines finds width and header; the table itself stays lazy. With
    ``header`` the first row of full width names the columns and every copy of it is
    dropped; without, the names are ``c0, c1, ...`` and no row is lost. ``None`` takes that row
    for a header if none of its fields is a number other than zero, so tables of text alone
    need a plain answer.
    """
    shape = field_shape(lines).first().asDict()
    if not shape["n_rows"]:
        raise ValueError("the input holds no lines")
    width = shape["max_fields"]
    if header is None:
        header = lines.sparkSession.range(1).select(is_header(F.lit(shape["header"]))).first()[0]
    counted = measured(lines)
    kept = counted.filter(F.col("n_fields") == width)
    if header:
        names = unique_names(shape["header"].split(SEPARATOR))
        kept = drop_header(kept, shape["header"])
    else:
        names = [f"c{i}" for i in range(width)]
    rejected = counted.filter(F.col("n_fields") < width)
    return Table(to_columns(kept, names), rejected, names, shape, header)


def typed_columns(df: DataFrame, names: Sequence[str], types: dict[str, str]) -> DataFrame:
    """The table with inferred types: whole numbers as bigint, others as double, text as is."""
    def typed(name: str) -> Column:
        value = named(name)
        kind = types[name]
        if kind == "String":
            return value
        already = isinstance(df.schema[name].dataType, T.NumericType)
        found = value.cast("double") if already else lenient_double(value)
        return found.cast("bigint") if kind in ("Int", "NumLabel") else found

    return df.select(*[typed(n).alias(n) for n in names])


def numbers_only(df: DataFrame, names: Sequence[str], types: dict[str, str]) -> DataFrame:
    """The numeric columns alone, chosen by type; a text among numbers counts as 0.0."""
    return typed_columns(df, [n for n in names if types[n] != "String"], types)


def parse_check(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """``keys, value, parsed``: the lenient number of a text and whether it was one."""
    text = named(col).cast("string")
    return df.select(
        *[named(k) for k in keys],
        lenient_double(text).alias("value"),
        parsed_double(text).isNotNull().alias("parsed"),
    )
