"""Association between columns: correlation and chi-square tests."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.functions.names import named
from ashlar.functions.numbers import chi2_p_value
from ashlar.operators.profile import ColumnStats, fit, number, numeric_columns, numeric_view

# What tasks run travels with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def vectorize(df: DataFrame, cols: Sequence[str], output: str = "features") -> DataFrame:
    """Append the columns' numbers as one dense vector."""
    hidden = [f"__{i}" for i in range(len(cols))]
    wide = df.select("*", *[number(df, c).alias(h) for c, h in zip(cols, hidden)])
    return VectorAssembler(inputCols=hidden, outputCol=output).transform(wide).drop(*hidden)


# Sides of a tile of the matrix, in columns, and how many groups of tasks are merged apart before
# a tile's rows meet.
TILE = 64
GROUPS = 32


class _Tile:
    """Centred products of the columns of two blocks, with what both need to be joined or finished."""

    def __init__(self, n: float, sides: list[np.ndarray], products: np.ndarray) -> None:
        self.n, self.products = n, products
        #: Per side and column: mean, squares about it, least and greatest value.
        self.sides = sides

    def add(self, other: _Tile) -> None:
        """Join another sample: the update for means and products of joined samples."""
        total = self.n + other.n
        share = self.n * other.n / total
        apart = [b[0] - a[0] for a, b in zip(self.sides, other.sides, strict=True)]
        self.products += other.products + np.outer(*apart) * share
        for a, b, d in zip(self.sides, other.sides, apart, strict=True):
            a[0] += d * (other.n / total)
            a[1] += b[1] + d * d * share
            a[2], a[3] = np.minimum(a[2], b[2]), np.maximum(a[3], b[3])
        self.n = total

    def packed(self) -> np.ndarray:
        return np.concatenate([[self.n, self.sides[0].shape[1]], *(s.ravel() for s in self.sides), self.products.ravel()])

    @classmethod
    def unpacked(cls, data: np.ndarray) -> _Tile:
        high = int(data[1])
        wide = (len(data) - 2 - 4 * high) // (4 + high)
        cuts = np.cumsum([2, 4 * high, 4 * wide])
        sides = [data[cuts[0] : cuts[1]].reshape(4, high).copy(), data[cuts[1] : cuts[2]].reshape(4, wide).copy()]
        return cls(data[0], sides, data[cuts[2] :].reshape(high, wide).copy())

    def coefficients(self, same: bool) -> np.ndarray:
        """Correlations; NaN where a column does not vary, 1 on the matrix' own diagonal."""
        spread = [np.where(s[2] < s[3], np.sqrt(s[1]), np.nan) for s in self.sides]
        with np.errstate(divide="ignore", invalid="ignore"):
            r = self.products / np.outer(*spread)
        if same:
            at = np.arange(len(r))
            r[at, at] = np.where(np.isnan(spread[0]), np.nan, 1.0)
        return r


def _rows(keys: Sequence[tuple], tiles: Sequence[_Tile], names: Sequence[str]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int32()) for c in zip(*keys, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([t.packed() for t in tiles], pa.list_(pa.float64()))], names=[*names, "data"])


def _tiles_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows as the tiles of the matrix' upper half.

    Values are taken from their batch's first one, so a constant column has no spread at all.
    """
    held: dict[tuple[int, int], _Tile] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        shift, low, high = x[0].copy(), x.min(axis=0), x.max(axis=0)
        x = x - shift
        middle = x.mean(axis=0)
        x -= middle
        about = np.stack([shift + middle, (x * x).sum(axis=0), low, high])
        cuts = [slice(a, a + TILE) for a in range(0, x.shape[1], TILE)]
        for i, one in enumerate(cuts):
            for j, two in enumerate(cuts[i:], i):
                tile = _Tile(float(len(x)), [about[:, one].copy(), about[:, two].copy()], x[:, one].T @ x[:, two])
                if (i, j) in held:
                    held[i, j].add(tile)
                else:
                    held[i, j] = tile
    for key, tile in held.items():
        yield _rows([key], [tile], ["i", "j"])


def _merged(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], _Tile]:
    held: dict[tuple[int, int], _Tile] = {}
    for batch in batches:
        for i, j, data in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("data"), strict=True):
            tile = _Tile.unpacked(data.values.to_numpy())
            if (i, j) in held:
                held[i, j].add(tile)
            else:
                held[i, j] = tile
    return held


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, tile in _merged(batches).items():
        yield _rows([key], [tile], ["i", "j"])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (i, j), tile in _merged(batches).items():
        r = tile.coefficients(i == j)
        a, b = (v.ravel() for v in np.indices(r.shape))
        for one, two in ((a + i * TILE, b + j * TILE), (b + j * TILE, a + i * TILE))[: 1 if i == j else 2]:
            columns = [pa.array(one, pa.int32()), pa.array(two, pa.int32()), pa.array(r.ravel(), from_pandas=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "r"])


def correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form ``col_i, col_j, r``, both halves; NULL where a column is constant.

    One scan for any number of columns. A task hands on tiles of half the matrix of centred
    products; a tile's rows are joined in groups of tasks first and then as a whole, and carry all
    that their coefficients need. Nothing runs before the result is asked for. An empty table
    gives no rows.
    """
    cols = list(cols)
    view = numeric_view(df, cols).toDF(*[f"c{i}" for i in range(len(cols))])
    schema = "i int, j int, data array<double>"
    tiles = view.mapInArrow(_tiles_of_task, schema)
    groups = tiles.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUPS))).repartition("i", "j", "part").drop("part")
    found = groups.mapInArrow(_joined, schema).repartition("i", "j").mapInArrow(_finished, "i int, j int, r double")
    names = F.array(*[F.lit(c) for c in cols])
    return found.select(names[F.col("i")].alias("col_i"), names[F.col("j")].alias("col_j"), "r")


def correlated_pairs(df: DataFrame, cols: Sequence[str], least: float = 0.5) -> DataFrame:
    """Every pair once, later column first, whose coefficient is at least ``least`` in size."""
    cols = list(cols)
    order = F.create_map(*[F.lit(x) for i, c in enumerate(cols) for x in (c, i)])
    later = order[F.col("col_i")] > order[F.col("col_j")]
    return correlation(df, cols).filter(later & (F.abs("r") >= least))


def chi2_independence(
    df: DataFrame,
    cols: Sequence[str],
    stats: dict[str, ColumnStats] | None = None,
    p_value: bool = True,
) -> DataFrame:
    """Pearson's test on the table's absolute values, read as row-by-column counts.

    Column sums come from the profile; each row then adds its own share, so the table is
    neither collected nor shuffled. All-zero rows and columns leave the test undefined and
    are skipped; the skipped rows are counted.
    """
    stats = stats or fit(df, cols)
    used = [c for c in cols if stats[c].l1 > 0]
    if not used:
        raise ValueError("every column is zero")
    total = sum(stats[c].l1 for c in used)
    cells = {c: F.abs(number(df, c)) for c in used}
    row_sum = sum((cells[c] for c in used[1:]), cells[used[0]])
    rows = df.select(*[cells[c].alias(f"v{i}") for i, c in enumerate(used)], row_sum.alias("row_sum"))

    def share(i: int, name: str):
        expected = F.col("row_sum") * F.lit(stats[name].l1) / F.lit(total)
        gap = F.col(f"v{i}") - expected
        return gap * gap / expected

    shares = sum((share(i, c) for i, c in enumerate(used[1:], 1)), share(0, used[0]))
    kept = F.col("row_sum") > 0
    result = rows.agg(
        F.sum(F.when(kept, shares)).alias("statistic"),
        ((F.count_if(kept) - 1) * (len(used) - 1)).alias("df"),
        F.count_if(~kept).alias("zero_rows"),
    )
    return result.withColumn("p_value", chi2_p_value("statistic", "df")) if p_value else result


def chi2_gof(
    df: DataFrame,
    cols: Sequence[str],
    stats: dict[str, ColumnStats] | None = None,
    p_value: bool = True,
) -> DataFrame:
    """Each column, shifted to start at zero or above, against itself plus one.

    The expected counts are scaled to the observed total, as the test requires.
    """
    stats = stats or fit(df, cols)
    used = numeric_columns(stats, cols)
    rows = []
    for c in used:
        s = stats[c]
        shift = -s.min if s.min < 0 else 0.0
        observed_total = s.count * (s.mean + shift)
        scale = observed_total / (observed_total + s.count)
        observed = number(df, c) + F.lit(shift)
        expected = (observed + 1) * F.lit(scale)
        gap = observed - expected
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.sum(F.try_divide(gap * gap, expected)).alias("statistic"),
                (F.count(F.lit(1)) - 1).alias("df"),
            )
        )
    result = df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    return result.withColumn("p_value", chi2_p_value("statistic", "df")) if p_value else result
