"""Columnar tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ashlar.functions.names import named
from ashlar.operators.profile import found_number
from ashlar.session import shared_path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table."""
    return spark.read.parquet(path)


class Staged:
    """A table written once to the cluster's shared folder, and read from there.

    Later passes then scan only the columns they need, and nothing is recomputed when an
    executor is lost. Columns named as numbers are stored as doubles beside what they were, so
    that no pass parses text again, and comparisons with them skip blocks of rows by their
    statistics. Whoever staged it owns the files: ``close`` removes them, as does the end of a
    ``with`` block, after which its tables can no longer be read.
    """

    def __init__(self, df: DataFrame, label: str, numbers: Sequence[str] = ()) -> None:
        self.spark, self.path, self.columns = df.sparkSession, shared_path(df.sparkSession, label), df.columns
        self.numbers = {c: f"__number{i}" for i, c in enumerate(numbers) if dict(df.dtypes)[c] != "double"}
        df.select("*", *[found_number(df, c).alias(n) for c, n in self.numbers.items()]).write.parquet(self.path)
        self._stored = self.spark.read.parquet(self.path)

    @property
    def rows(self) -> DataFrame:
        """The table as it was."""
        return self._stored.select(*[named(c) for c in self.columns])

    def typed(self, numbers: Sequence[str] | None = None, text: dict[str, str] | None = None) -> DataFrame:
        """The table with ``numbers`` (all by default) as doubles, NULL where a text held none; and
        columns as they were again, under other names."""
        chosen = self.numbers if numbers is None else {c: n for c, n in self.numbers.items() if c in numbers}
        again = [named(c).alias(n) for c, n in (text or {}).items()]
        return self._stored.select(*[named(chosen.get(c, c)).alias(c) for c in self.columns], *again)

    def close(self) -> None:
        """Remove the files; nothing happens if they are gone already."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Staged:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def staged(df: DataFrame, label: str) -> DataFrame:
    """The table staged as it is, for a caller who leaves its files to the owner of the shared folder."""
    return Staged(df, label).rows
