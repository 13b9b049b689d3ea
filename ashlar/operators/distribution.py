"""Distribution shape: Kolmogorov-Smirnov test and Gaussian kernel density."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, fields
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.functions.numbers import ks_p_value, normal_cdf
from ashlar.operators.profile import ColumnStats, fit, long_values, number, numeric_columns

# What tasks run travels with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Buckets of the first count, parts an open one is cut into, intervals held at a time, and values
# that are ranked at the end.
KS_BUCKETS = 65_536
KS_PARTS = 256
KS_CELLS = 1 << 20
KS_ROWS = 10_000
# exp(-x*x/2) is exactly zero in double precision beyond this many bandwidths.
KERNEL_REACH = 38.7
# Values in a cell of this share of a bandwidth are summed up by this many moments; the
# first term left out is below 1e-14 of a kernel's peak.
CELL = 1 / 3
MOMENTS = 12


@dataclass
class _Intervals:
    """Disjoint stretches of probabilities, one row each: of which column, how many values, the least
    and the greatest of them, and how many values of the column lie before."""

    col: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    before: np.ndarray

    def take(self, at: np.ndarray) -> _Intervals:
        return _Intervals(*(getattr(self, f.name)[at] for f in fields(self)))

    def joined(self, other: _Intervals) -> _Intervals:
        return _Intervals(*(np.concatenate([getattr(self, f.name), getattr(other, f.name)]) for f in fields(self)))

    def exact(self, n: float) -> np.ndarray:
        """The deviation at either end."""
        return np.maximum((self.before + self.size) / n - self.high, self.low - self.before / n)

    def bound(self, n: float) -> np.ndarray:
        """What no value in between can exceed."""
        return np.maximum((self.before + self.size) / n - self.low, self.high - self.before / n)


def _within(view: DataFrame, open_: _Intervals) -> DataFrame:
    """Rows with a probability in the span of the open intervals of its column."""
    tests = []
    for c in np.unique(open_.col).tolist():
        mine = open_.col == c
        tests.append(F.col(f"p{c}").between(float(open_.low[mine].min()), float(open_.high[mine].max())))
    return view.filter(reduce(lambda a, b: a | b, tests))


def _placed(batch: pa.RecordBatch, open_: dict[int, tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per column: its probabilities that lie in an open interval, and in which."""
    for c, (lows, highs, _) in open_.items():
        p = batch.column(f"p{c}").to_numpy(zero_copy_only=False)
        at = np.searchsorted(lows, p, "right") - 1
        fine = np.flatnonzero((at >= 0) & (p <= highs[np.maximum(at, 0)]))
        yield c, p[fine], at[fine]


def _by_column(open_: _Intervals) -> dict[int, tuple]:
    """Per column the lows and highs of its intervals, ascending, and their numbers."""
    order = np.lexsort((open_.low, open_.col))
    return {c: (open_.low[m], open_.high[m], m) for c in np.unique(open_.col).tolist() for m in [order[open_.col[order] == c]]}


def _split(view: DataFrame, open_: _Intervals, parts: int) -> _Intervals:
    """Every interval cut into ``parts`` of equal length between its own ends, empty ones left out.

    A task keeps a count, least and greatest value per part; there are ``KS_CELLS`` at most.
    """
    shared, total = view.sparkSession.sparkContext.broadcast(_by_column(open_)), len(open_.col) * parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, low, high = np.zeros(total, np.int64), np.full(total, np.inf), np.full(total, -np.inf)
        for batch in batches:
            for c, p, at in _placed(batch, shared.value):
                lows, highs, numbers = shared.value[c]
                share = (p - lows[at]) / (highs[at] - lows[at])
                cell = numbers[at] * parts + np.minimum((share * parts).astype(np.int64), parts - 1)
                size += np.bincount(cell, minlength=total)
                np.minimum.at(low, cell, p)
                np.maximum.at(high, cell, p)
        used = np.flatnonzero(size)
        for a in range(0, len(used), 1 << 16):
            at = used[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (at, size[at], low[at], high[at])], names=["cell", "size", "low", "high"])

    cells = _within(view, open_).mapInArrow(run, "cell bigint, size bigint, low double, high double")
    table = cells.groupBy("cell").agg(F.sum("size").alias("size"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    cell, size, low, high = (table[c].to_numpy() for c in ("cell", "size", "low", "high"))
    order = np.argsort(cell)
    cell, size, low, high = (v[order] for v in (cell, size, low, high))
    whole = cell // parts
    return _Intervals(open_.col[whole], size, low, high, open_.before[whole] + _before(whole, size))


def _before(group: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Running sum of the sizes before, anew in every group; groups stand together."""
    upto = np.cumsum(size) - size
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return upto - np.repeat(upto[first], np.diff(first, append=len(group)))


def _ranked(view: DataFrame, open_: _Intervals, n: float) -> list[tuple[int, float]]:
    """The greatest deviation among the values of the intervals, per interval: at most ``KS_ROWS``
    values are left, which come as distinct ones with counts."""
    shared = view.sparkSession.sparkContext.broadcast(_by_column(open_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, p, at in _placed(batch, shared.value):
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(shared.value[c][2][at], pa.int64()), pa.array(p)], names=["at", "p"])

    values = _within(view, open_).mapInArrow(run, "at bigint, p double")
    table = values.groupBy("at", "p").agg(F.count(F.lit(1)).alias("size")).toArrow()
    at, p, size = (table[c].to_numpy() for c in ("at", "p", "size"))
    order = np.lexsort((p, at))
    at, p, size = at[order], p[order], size[order]
    points = _Intervals(open_.col[at], size, p, p, open_.before[at] + _before(at, size))
    return list(zip(points.col.tolist(), points.exact(n).tolist(), strict=True))


def ks_normal(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    stats: dict[str, ColumnStats] | None = None,
    p_value: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """One-sample test of each column against the normal law with its own mean and deviation.

    The data are not sorted. Values are first counted in buckets of equal normal probability,
    which gives the exact deviation at both ends of every bucket and a bound inside it. Only
    buckets whose bound exceeds the largest exact deviation can hold the maximum; these, the
    most promising first, are cut between their own ends and counted again, until ``KS_ROWS``
    values at most are left, which are ranked. So values squeezed into few buckets by a giant one
    are told apart by another scan or two, and equal values end the search where they stand. The
    driver and each task hold ``KS_CELLS`` intervals at most.
    """
    stats = stats or fit(df, cols)
    cols = [c for c in numeric_columns(stats, cols) if stats[c].variance > 0]
    if not cols:
        raise ValueError("no column varies")
    n = float(stats[cols[0]].count)
    # Normal data deviate by about one over the root of the row count; buckets well below
    # that leave few of them open.
    buckets = buckets or min(KS_BUCKETS, max(64, KS_CELLS // len(cols)), 8 * math.isqrt(int(n)) + 8)
    # The probability grows with the value, so it can stand in for it in all that follows.
    scores = df.select(*[((number(df, c) - stats[c].mean) / stats[c].stddev).alias(f"z{i}") for i, c in enumerate(cols)])
    view = scores.select(*[normal_cdf(F.col(f"z{i}")).alias(f"p{i}") for i in range(len(cols))])
    bucket = F.least(F.floor(F.col("p") * buckets), F.lit(buckets - 1)).cast("int")
    counted = (
        view.unpivot([], [f"p{i}" for i in range(len(cols))], "column", "p")
        .groupBy(F.substring("column", 2, 9).cast("int").alias("col"), bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("size"), F.min("p").alias("low"), F.max("p").alias("high"))
        .toArrow()
        .sort_by([("col", "ascending"), ("bucket", "ascending")])
    )
    col, size, low, high = (counted[c].to_numpy() for c in ("col", "size", "low", "high"))
    fresh, best = _Intervals(col, size, low, high, _before(col, size)), np.zeros(len(cols))
    waiting = fresh.take(np.zeros(0, int))
    while True:
        np.maximum.at(best, fresh.col, fresh.exact(n))
        waiting = waiting.joined(fresh)
        waiting = waiting.take(np.flatnonzero((waiting.bound(n) > best[waiting.col]) & (waiting.low < waiting.high)))
        if not len(waiting.col):
            break
        if waiting.size.sum() <= KS_ROWS:
            for c, deviation in _ranked(view, waiting, n):
                best[c] = max(best[c], deviation)
            break
        order = np.argsort(-waiting.bound(n), kind="stable")
        chosen, rest = order[: KS_CELLS // 4], order[KS_CELLS // 4 :]
        parts = max(4, min(KS_PARTS, KS_CELLS // len(chosen)))
        fresh, waiting = _split(view, waiting.take(chosen), parts), waiting.take(rest)
    rows = [(c, float(best[i]), stats[c].count) for i, c in enumerate(cols)]
    result = df.sparkSession.createDataFrame(rows, "column string, statistic double, n bigint")
    return result.withColumn("p_value", ks_p_value("statistic", "n")) if p_value else result


def default_grid(count: int) -> tuple[float, float, int]:
    """Start, step and number of points: as many points as the root of the row count."""
    root = math.isqrt(count)
    return 0.0, float(root), root


def unit_grid(count: int) -> tuple[float, float, int]:
    """One point per row at 0, 1, 2, ..."""
    return 0.0, 1.0, count


def _masses(df: DataFrame, cols: Sequence[str], bandwidth: float, reaches: Callable[[Column], Column]) -> tuple[DataFrame, Callable]:
    """One row ``column, cell, centre`` per cell of values, with the moments of these about its middle,
    and its mass at a point; cells that reach no point are left out before anything is summed.

    With x and d the distances of point and value from the middle, in bandwidths, the
    kernel is exp(-x*x/2) * exp(-d*d/2) * exp(x*d), the last factor as a power series in d.
    """
    width = bandwidth * CELL
    cell = F.floor(F.col("value") / width)
    placed = long_values(df, cols).select("column", "value", cell.alias("cell")).filter(reaches((F.col("cell") + 0.5) * width))
    distances = placed.select("column", "cell", ((F.col("value") - (F.col("cell") + 0.5) * width) / bandwidth).alias("d"))
    terms, power = [], F.exp(-0.5 * F.col("d") * F.col("d"))
    for k in range(MOMENTS):
        terms.append(F.sum(power).alias(f"m{k}"))
        power = power * F.col("d") / (k + 1)
    sources = distances.groupBy("column", "cell").agg(*terms).withColumn("centre", (F.col("cell") + 0.5) * width)

    def mass(point: Column) -> Column:
        x = (point - F.col("centre")) / bandwidth
        series = F.col(f"m{MOMENTS - 1}")
        for k in reversed(range(MOMENTS - 1)):
            series = series * x + F.col(f"m{k}")
        return F.exp(-0.5 * x * x) * series

    return sources, mass


def kde(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    grid: tuple[float, float, int] | None = None,
    points: Sequence[float] | None = None,
    bandwidth: float = 3.0,
    least: float | None = None,
    stats: dict[str, ColumnStats] | None = None,
) -> DataFrame:
    """Gaussian kernel density ``column, point, density``.

    Values are summed by cells narrower than the bandwidth before any shuffle. A kernel is
    exactly zero beyond ``KERNEL_REACH`` bandwidths, so a cell visits the points of an evenly
    spaced ``grid`` that it reaches, and listed ``points`` visit the cells that reach them, found
    by number: a point meets some 230 cells at most, however many points, cells or rows there
    are. Densities are exact to 1e-14 of a kernel's peak. With ``least`` only densities at or above it are kept; points nothing reaches then
    never appear and need no row.
    """
    stats = stats or fit(df, cols)
    cols = numeric_columns(stats, cols)
    n = stats[cols[0]].count
    start, step, size = grid or default_grid(n)
    reach, width = KERNEL_REACH * bandwidth, bandwidth * CELL
    spark = df.sparkSession

    if points is not None:
        listed = spark.createDataFrame([(i, float(p)) for i, p in enumerate(points)], "at bigint, point double")
        ends = [F.floor((F.col("point") + side * reach) / width) + side for side in (-1, 1)]
        near = listed.select("at", "point", F.explode(F.sequence(*ends)).alias("cell"))
        sources, mass = _masses(df, cols, bandwidth, lambda centre: F.lit(True))
        visits, all_points = sources.join(near, "cell"), listed
    else:
        first, last = (
            lambda c: F.greatest(F.ceil((c - (reach + start)) / step), F.lit(0)),
            lambda c: F.least(F.floor((c + (reach - start)) / step), F.lit(size - 1)),
        )
        sources, mass = _masses(df, cols, bandwidth, lambda centre: first(centre) <= last(centre))
        centre = F.col("centre")
        visits = sources.select("*", F.explode(F.sequence(first(centre), last(centre))).alias("at")).withColumn("point", F.lit(start) + F.col("at") * F.lit(step))
        all_points = spark.range(size).select(F.col("id").alias("at"), (F.lit(start) + F.col("id") * F.lit(step)).alias("point"))
    scale = n * bandwidth * math.sqrt(2 * math.pi)
    reached = visits.groupBy("column", "at").agg(F.min("point").alias("point"), (F.greatest(F.sum(mass(F.col("point"))), F.lit(0.0)) / scale).alias("density"))
    if least is not None:
        return reached.filter(F.col("density") >= least).select("column", "point", "density")
    every = all_points.select("at", "point", F.explode(F.array(*[F.lit(c) for c in cols])).alias("column"))
    return every.join(reached.select("column", "at", "density"), ["column", "at"], "left").select(
        "column", "point", F.coalesce("density", F.lit(0.0)).alias("density")
    )
