"""Z-scores, row norms and extreme rows."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashlar.functions.names import named
from ashlar.operators.profile import SCALED_TYPES, ColumnStats, fit, number, of_type

# What tasks run travels with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

METRICS = ("row_max", "row_min", "zeros", "l1_norm", "l2_norm")
# Where the search for a row's largest and smallest z-score starts, and the
# size from which a z-score no longer enters the norms.
START = 999999.0
NORM_GUARD = 100.0


def scaled_columns(stats: dict[str, ColumnStats], cols: Sequence[str] | None = None) -> list[str]:
    """The columns that get z-scores: neither text nor numeric labels."""
    return [c for c in of_type(stats, SCALED_TYPES) if cols is None or c in cols]


def z(df: DataFrame, stats: ColumnStats) -> Column:
    """The z-score; NULL for a constant column, which has no scale."""
    if stats.stddev == 0:
        return F.lit(None).cast("double")
    return (number(df, stats.column) - F.lit(stats.mean)) / F.lit(stats.stddev)


def zscore(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    stats: dict[str, ColumnStats] | None = None,
) -> DataFrame:
    """The table with each numeric column replaced by its z-scores; the rest is unchanged.

    The fitted mean and deviation are literals, so this is a projection without a join.
    """
    stats = stats or fit(df, cols, moments=True)
    scaled = set(scaled_columns(stats, cols))
    return df.select(*[z(df, stats[c]).alias(c) if c in scaled else named(c) for c in df.columns])


def _total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def row_norms(
    df: DataFrame,
    ids: Sequence[str],
    cols: Sequence[str] | None = None,
    stats: dict[str, ColumnStats] | None = None,
    guard: float | None = NORM_GUARD,
) -> DataFrame:
    """``ids`` with ``row_max, row_min, zeros, l1_norm, l2_norm`` of the row's z-scores.

    Z-scores of ``guard`` and beyond stay out of the norms; ``None`` lets all of them in.
    """
    stats = stats or fit(df, cols, moments=True)
    scaled = [c for c in scaled_columns(stats, cols) if stats[c].stddev > 0]
    hidden = [f"__z{i}" for i in range(len(scaled))]
    scores = df.select(
        *[named(i) for i in ids], *[z(df, stats[c]).alias(h) for c, h in zip(scaled, hidden)]
    )
    size = [F.abs(h) for h in hidden]
    counted = size if guard is None else [F.when(s < guard, s).otherwise(0.0) for s in size]
    return scores.select(
        *[named(i) for i in ids],
        F.greatest(F.lit(-START), F.lit(-START), *hidden).alias("row_max"),
        F.least(F.lit(START), F.lit(START), *hidden).alias("row_min"),
        reduce(lambda a, b: a + b, [F.when(F.col(h) == 0, 1).otherwise(0) for h in hidden], F.lit(0)).alias("zeros"),
        _total(counted).alias("l1_norm"),
        F.sqrt(_total([c * c for c in counted])).alias("l2_norm"),
    )


def labeled_norms(
    df: DataFrame,
    ids: Sequence[str] | None = None,
    cols: Sequence[str] | None = None,
    stats: dict[str, ColumnStats] | None = None,
) -> DataFrame:
    """Identifying columns (the first six by default) with both norms of the row."""
    ids = list(ids if ids is not None else df.columns[:6])
    return row_norms(df, ids, cols, stats).select(*[named(i) for i in ids], "l1_norm", "l2_norm")


def _key_parts(schema: T.DataType, key: Column) -> list[Column]:
    """What a key is ordered by: itself, or the fields of a struct in turn."""
    if not isinstance(schema, T.StructType):
        return [key]
    return [part for f in schema.fields for part in _key_parts(f.dataType, key.getField(f.name))]


def _best(table: pa.Table, k: int, up: bool, parts: int, ranked: bool = False) -> pa.Table:
    """The first ``k`` rows by ``value``, then by the parts of their key; a NULL part is the least one."""
    if table.num_rows <= k and not ranked:
        return table
    order, missing = ("ascending", "descending") if up else ("descending", "ascending")
    keys = [("value", order)]
    for i in range(parts):
        keys += [(f"n{i}", missing), (f"k{i}", order)]
    return table.take(pc.sort_indices(table, keys)[:k] if ranked else pc.select_k_unstable(table, k, keys))


def extreme_rows(
    norms: DataFrame,
    key: str,
    metrics: Sequence[str] = METRICS,
    ascending: bool | None = None,
    k: int = 5,
) -> DataFrame:
    """The ``k`` smallest and largest rows by each metric: ``metric, direction, rank, key, value``.

    Smallest rows break ties by the lower ``key``, largest by the higher one. One scan fills all
    lists: a task holds k rows of each and hands these on, and a list's rows meet in one task,
    which holds k of them in turn. Rows whose metric is NULL are in no list.
    """
    metrics, directions = list(metrics), {"smallest": True, "largest": False}
    lists = [(m, d) for m in metrics for d, up in directions.items() if ascending is None or ascending == up]
    parts = _key_parts(norms.schema[key].dataType, named(key))
    count, columns = len(parts), [f"m{i}" for i in range(len(metrics))]
    carried = ["key", *[f"{a}{i}" for i in range(count) for a in "nk"]]
    rows = norms.select(
        named(key).alias("key"),
        *[c for i, p in enumerate(parts) for c in (p.isNull().cast("int").alias(f"n{i}"), p.alias(f"k{i}"))],
        *[named(m).cast("double").alias(c) for m, c in zip(metrics, columns)],
    )

    def merged(held: dict[int, pa.Table], n: int, part: pa.Table) -> None:
        held[n] = _best(pa.concat_tables([held[n], part]) if n in held else part, k, directions[lists[n][1]], count)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Table] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for n, (metric, direction) in enumerate(lists):
                # Anew, for columns differ in whether they can be NULL.
                part = pa.table([*(table[c] for c in carried), table[columns[metrics.index(metric)]]], names=[*carried, "value"])
                part = part.filter(pc.is_valid(part["value"]))
                merged(held, n, _best(part, k, directions[direction], count))
        for n, part in held.items():
            yield from part.append_column("list", pa.array([n] * part.num_rows, pa.int32())).combine_chunks().to_batches()

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Table] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for n in pc.unique(table["list"]).to_pylist():
                merged(held, n, table.filter(pc.equal(table["list"], n)))
        for n, part in held.items():
            metric, direction = lists[n]
            part = _best(part, k, directions[direction], count, ranked=True).combine_chunks()
            size = part.num_rows
            made = [pa.repeat(metric, size), pa.repeat(direction, size), pa.array(range(1, size + 1), pa.int32())]
            made += [pa.concat_arrays(part[c].chunks) if size else pa.array([], part[c].type) for c in ("key", "value")]
            yield pa.RecordBatch.from_arrays(made, names=["metric", "direction", "rank", "key", "value"])

    heads = rows.select(*carried, F.lit(0.0).alias("value"), F.lit(0).alias("list")).schema
    result = rows.select(F.lit("").alias("metric"), F.lit("").alias("direction"), F.lit(0).alias("rank"), "key", F.lit(0.0).alias("value")).schema
    return rows.mapInArrow(first, heads).repartition("list").mapInArrow(last, result).withColumnRenamed("key", key)


def sort_rows(norms: DataFrame, key: str, metric: str, ascending: bool = True) -> DataFrame:
    """All rows in the order of a metric (range-partitioned sort)."""
    order = [F.col(metric), F.col(key)] if ascending else [F.desc(metric), F.desc(key)]
    return norms.orderBy(*order)
