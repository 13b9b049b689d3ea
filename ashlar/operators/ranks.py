"""Order statistics, histograms and modes."""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashlar.functions.names import named
from ashlar.operators.profile import ColumnStats, fit, number, numeric_columns, numeric_view

# What tasks run travels with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Where at most this many values of a column can be the wanted one, all of them are ranked.
EXACT_LIMIT = 100_000
# Tasks are dealt to so many groups; a group's sketch is so many evenly spaced quantiles of its
# values, each off by a rank of one in ACCURACY at most.
GROUPS = 64
POINTS = 500
ACCURACY = 5_000
# Bins in a slice of a task's counts.
SLICE = 1 << 14


@dataclass
class _Search:
    """Open interval that holds the wanted value: ``rows`` rows lie in it, ``below`` rows at or under it.

    ``guess`` is a narrower one, not counted yet, that should hold the value and at most ``held`` rows.
    """

    rank: int
    rows: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    found: float | None = None
    guess: tuple[float | None, float | None] = (None, None)
    held: int = 0

    @property
    def wanted(self) -> int:
        """The rank within the interval."""
        return self.rank - self.below

    def narrow(self, low: float | None, high: float | None, rows: int, under: int) -> None:
        if low is not None:
            self.low = low
        if high is not None:
            self.high = high
        self.rows, self.held, self.below, self.guess = rows, rows, self.below + under, (None, None)

    def settle(self, counts: Row) -> bool:
        """Take in the exact counts around the guess; whether the value is inside it."""
        low, high = self.guess
        if low is not None and self.wanted <= counts.under_low:
            self.narrow(None, low, counts.under_low, 0)
        elif low is not None and self.wanted <= counts.upto_low:
            self.found = low
        elif high is None or self.wanted <= counts.under_high:
            under = counts.upto_low if low is not None else 0
            self.narrow(low, high, (counts.under_high if high is not None else self.rows) - under, under)
            return True
        elif self.wanted <= counts.upto_high:
            self.found = high
        else:
            self.narrow(high, None, self.rows - counts.upto_high, counts.upto_high)
        return False

    def aim(self, sketches: Sequence[Row]) -> None:
        """The next guess: the nearest points of the groups' sketches that lie below and above the
        rank for certain, as far as sketches are certain."""
        points = np.concatenate([np.asarray(s.points, float) for s in sketches])
        weights = np.concatenate([np.full(len(s.points), s.n / len(s.points)) for s in sketches])
        order = np.argsort(points, kind="stable")
        points, middle = points[order], np.cumsum(weights[order]) - weights[order] / 2
        off = self.rows * (1 / POINTS + 2 / ACCURACY) + 1
        first, last = np.searchsorted(middle, self.wanted - off) - 1, np.searchsorted(middle, self.wanted + off)
        ends = [float(points[i]) if 0 <= i < len(points) else None for i in (first, last)]
        if ends == [None, None]:
            ends = [float(points[min(np.searchsorted(middle, self.wanted), len(points) - 1)])] * 2
        self.guess, self.held = (ends[0], ends[1]), min(self.rows, math.ceil(4 * off))


def _between(value: Column, low: float | None, high: float | None) -> Column:
    test = F.lit(True)
    if low is not None:
        test = test & (value > F.lit(low))
    if high is not None:
        test = test & (value < F.lit(high))
    return test


def _inside(name: str, low: float | None, high: float | None) -> str:
    """The same as SQL, of a column of numbers."""
    ends = [f"`{name}` {sign} double('{end!r}')" for sign, end in ((">", low), ("<", high)) if end is not None]
    return " AND ".join(ends) or "true"


def _reachable(df: DataFrame, name: str, s: _Search) -> Column:
    """Whether a row's value can lie in the interval, asked of the bare column, so that the scan can
    skip blocks of rows: a NULL counts as 0.0, and so do text without a number, NaN and infinity."""
    if not isinstance(df.schema[name].dataType, T.NumericType) or (s.low is None and s.high is None):
        return F.lit(True)
    inside = _between(named(name), s.low, s.high)
    zero = (s.low is None or s.low < 0) and (s.high is None or s.high > 0)
    if not zero:
        return inside
    missing = named(name).isNull()
    if isinstance(df.schema[name].dataType, T.FractionalType):
        missing = missing | (F.abs(named(name)) == F.lit(float("inf"))) | F.isnan(named(name))
    return inside | missing


def narrowing_scan(df: DataFrame, open_: dict[str, _Search], limit: int) -> DataFrame:
    """One scan for all open columns: per column ``i`` the exact counts around its guess, and what lies
    inside the guess, as sketches of groups of tasks or, if few values can be left, the value itself.

    Sketches are merged by group, in as many tasks as there are groups; no task sees all of them.
    """
    rows = df.filter(reduce(lambda a, b: a | b, [_reachable(df, c, s) for c, s in open_.items()]))
    # As text: one call to Spark a column instead of hundreds.
    shares = ",".join(repr((j + 0.5) / POINTS) for j in range(POINTS))
    view = numeric_view(rows, list(open_)).withColumn("__group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    kept = [f"CASE WHEN {_inside(c, s.low, s.high)} AND {_inside(c, *s.guess)} THEN `{c}` END AS __kept{i}" for i, (c, s) in enumerate(open_.items())]
    view, parts = view.selectExpr("*", *kept), []
    for i, (name, s) in enumerate(open_.items()):
        counts = []
        for end, side in zip(s.guess, ("low", "high")):
            for sign, how in (("<", "under"), ("<=", "upto")):
                test = "false" if end is None else f"{_inside(name, s.low, s.high)} AND `{name}` {sign} double('{end!r}')"
                counts.append(f"count_if({test}) AS {how}_{side}")
        points, held = f"percentile_approx(__kept{i}, cast(split('{shares}', ',') AS array<double>), {ACCURACY})", "CAST(NULL AS array<double>)"
        if s.held <= limit:
            points, held = held, f"collect_list(__kept{i})"
        counts += [f"count(__kept{i}) AS n", f"{s.wanted}L AS wanted", f"{str(s.guess[0] is not None).lower()} AS counted"]
        parts.append(f"struct({i} AS i, {', '.join(counts)}, {points} AS points, {held} AS held)")
    each = view.groupBy("__group").agg(F.expr(f"array({', '.join(parts)}) AS parts")).select(F.inline("parts"))
    totals = [F.sum(c).alias(c) for c in ("under_low", "upto_low", "under_high", "upto_high")]
    sketch = F.when(F.col("points").isNotNull() & (F.col("n") > 0), F.struct("n", "points"))
    merged = each.groupBy("i", "wanted", "counted").agg(
        *totals, F.collect_list(sketch).alias("sketches"), F.array_sort(F.flatten(F.collect_list("held"))).alias("held")
    )
    place = F.col("wanted") - F.when(F.col("counted"), F.col("upto_low")).otherwise(0)
    return merged.select("i", "under_low", "upto_low", "under_high", "upto_high", "sketches", F.get("held", (place - 1).cast("int")).alias("value"))


def order_statistic(
    df: DataFrame,
    cols: Sequence[str],
    rank: Callable[[int], int],
    stats: dict[str, ColumnStats],
    limit: int = EXACT_LIMIT,
) -> DataFrame:
    """The exact value at ``rank(n)`` (from 1) of every column; NULL where it is below 1.

    No sort and no shuffle of the data. The first scan sketches all values, in groups of tasks;
    the next one counts exactly around the narrow interval the sketches name and sketches what
    lies in it, and so on, until at most ``limit`` values can be left: the scan that counts
    around these ranks them, too. So r intervals take r + 1 scans, one if the table is that
    small. Sketches only choose where to count: a loose one costs another scan, never a wrong
    value, and as quantiles of groups they narrow alike however rows are dealt. A value held by
    many rows becomes an end of the interval and is counted, so ties end the search early.
    """
    search = {c: _Search(rank(stats[c].count), stats[c].count) for c in cols}
    for s in search.values():
        s.held = s.rows
    while open_ := {c: s for c, s in search.items() if s.rank >= 1 and s.found is None}:
        names = list(open_)
        for row in narrowing_scan(df, open_, limit).collect():
            s = open_[names[row.i]]
            exact = s.held <= limit
            if s.settle(row):
                if exact:
                    s.found = row.value
                else:
                    s.aim(row.sketches)
    rows = [(c, s.found) for c, s in search.items()]
    return df.sparkSession.createDataFrame(rows, "column string, value double")


def median(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    side: str = "upper",
    stats: dict[str, ColumnStats] | None = None,
    limit: int = EXACT_LIMIT,
) -> DataFrame:
    """``column, median``: the element after (upper) or before (lower) the middle."""
    offsets = {"upper": 1, "lower": 0}
    if side not in offsets:
        raise ValueError("side must be 'upper' or 'lower'")
    stats = stats or fit(df, cols)
    cols = numeric_columns(stats, cols)
    found = order_statistic(df, cols, lambda n: n // 2 + offsets[side], stats, limit)
    return found.withColumnRenamed("value", "median")


def bin_count(n: int) -> int:
    return math.isqrt(n)


def _literal_map(pairs: dict[str, float]) -> Column:
    items = [F.lit(x) for name, v in pairs.items() for x in (name, float(v))]
    return F.element_at(F.create_map(*items), F.col("column"))


def bin_counts(
    df: DataFrame, cols: Sequence[str] | None = None, stats: dict[str, ColumnStats] | None = None
) -> DataFrame:
    """Non-empty bins ``column, bin, count, left_edge``.

    The root of the row count many bins of equal width; the maximum falls in one extra
    bin. A constant column has no width and goes to bin 0.

    With so many bins most of a task's values meet a bin alone, and rows of counts would be no
    fewer than values. A task counts into dense vectors instead and hands on their slices,
    compressed; a slice's parts are added up in one task. So what moves is bounded by bins times
    tasks, at a byte or less each, whatever the rows.
    """
    stats = stats or fit(df, cols)
    cols = numeric_columns(stats, cols)
    width = {c: (stats[c].max - stats[c].min) / bin_count(stats[c].count) for c in cols}
    view = df.select(
        *[
            F.coalesce(
                F.floor(F.try_divide(number(df, c) - stats[c].min, F.lit(width[c]))), F.lit(0)
            ).alias(f"b{i}")
            for i, c in enumerate(cols)
        ]
    )
    slices = view.mapInArrow(_counted, "col int, slice bigint, counts binary").repartition("col", "slice")
    names = F.array(*[F.lit(c) for c in cols])
    found = slices.mapInArrow(_added, "col int, bin bigint, count bigint").select(names[F.col("col")].alias("column"), "bin", "count")
    low = _literal_map({c: stats[c].min for c in cols})
    return found.withColumn("left_edge", low + F.col("bin") * _literal_map(width))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's values per bin, as slices of ``SLICE`` bins; slices without values are left out."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for c, column in enumerate(batch.columns):
            bins, times = np.unique(column.to_numpy(), return_counts=True)
            cut = bins // SLICE
            first = np.flatnonzero(np.diff(cut, prepend=-1))
            for a, b in zip(first, [*first[1:], len(bins)], strict=True):
                key = (c, int(cut[a]))
                if key not in held:
                    held[key] = np.zeros(SLICE, np.int64)
                held[key][bins[a:b] - cut[a] * SLICE] += times[a:b]
    for (c, cut), counts in held.items():
        packed = zlib.compress(counts.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([cut], pa.int64()), pa.array([packed], pa.binary())], names=["col", "slice", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each slice's parts, as rows of bins that are not empty."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for c, cut, packed in zip(batch.column("col").to_pylist(), batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
            planes = np.frombuffer(zlib.decompress(packed.as_py()), np.uint8).reshape(8, -1)
            counts = np.ascontiguousarray(planes.T).view(np.int64).ravel()
            held[c, cut] = held[c, cut] + counts if (c, cut) in held else counts
    for (c, cut), counts in held.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c), pa.int32()), pa.array(at + cut * SLICE), pa.array(counts[at])], names=["col", "bin", "count"])


def histogram(
    df: DataFrame, cols: Sequence[str] | None = None, stats: dict[str, ColumnStats] | None = None
) -> DataFrame:
    """All bins ``column, bin, count``, the extra one and empty ones included."""
    stats = stats or fit(df, cols)
    cols = numeric_columns(stats, cols)
    bins = bin_count(stats[cols[0]].count)
    every = df.sparkSession.range(bins + 1).select(
        F.explode(F.array(*[F.lit(c) for c in cols])).alias("column"), F.col("id").alias("bin")
    )
    counts = bin_counts(df, cols, stats).select("column", "bin", "count")
    return every.join(counts, ["column", "bin"], "left").fillna(0, ["count"])


def histogram_edges(
    df: DataFrame, cols: Sequence[str] | None = None, stats: dict[str, ColumnStats] | None = None
) -> DataFrame:
    """Non-empty bins by left edge, lowest first, as many as there are regular bins."""
    return _leading_bins(df, cols, stats, F.col("bin").asc())


def ranked_modes(
    df: DataFrame, cols: Sequence[str] | None = None, stats: dict[str, ColumnStats] | None = None
) -> DataFrame:
    """Non-empty bins by count, fullest first, as many as there are regular bins."""
    return _leading_bins(df, cols, stats, F.col("count").desc(), F.col("bin").asc())


def _leading_bins(df, cols, stats, *order: Column) -> DataFrame:
    stats = stats or fit(df, cols)
    # The window holds at most one row per bin, the root of the row count.
    position = F.row_number().over(Window.partitionBy("column").orderBy(*order))
    keep = _literal_map({c: bin_count(s.count) for c, s in stats.items()})
    return (
        bin_counts(df, cols, stats)
        .withColumn("rank", position)
        .filter(F.col("rank") <= keep)
        .select("column", "rank", "left_edge", "count")
    )


def mode(
    df: DataFrame, cols: Sequence[str] | None = None, stats: dict[str, ColumnStats] | None = None
) -> DataFrame:
    """``column, mode``: left edge of the fullest bin, the lowest one among equals."""
    stats = stats or fit(df, cols)
    fullest = bin_counts(df, cols, stats).groupBy("column").agg(
        F.max_by("bin", F.struct("count", -F.col("bin"))).alias("bin")
    )
    names = numeric_columns(stats, cols)
    low = _literal_map({c: stats[c].min for c in names})
    span = _literal_map({c: stats[c].max - stats[c].min for c in names})
    bins = _literal_map({c: bin_count(stats[c].count) for c in names})
    return fullest.select("column", (low + span * F.col("bin") / bins).alias("mode"))
