"""Text lines in and out: scan, preview, rows rebuilt as lines, read-back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.functions.names import named
from ashlar.functions.text import SEPARATOR


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines as ``row_id, value``.

    ``row_id`` (file, start of the split, position) sorts lines as they stand in the files,
    whichever way Spark packs splits into partitions, and is the same when a task is run
    again. Name files so that they sort as they should be read.
    """
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.text(paths).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("row_id"),
        "value",
    )


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines as ``row_id, value`` where ``row_id`` is the file's name and the line's number in it.

    It is the same wherever the files lie and however they are split and packed. Lines of a
    split stand together in one task, so a line's place is its distance from the split's
    first; what comes before the split is a running sum over the counts per split, of which
    there are few. Files are read once more to count them.
    """
    lines = read_lines(spark, path)
    at = ["row_id.file", "row_id.split"]
    splits = lines.groupBy(*at).agg(F.min("row_id.line").alias("first"), F.count(F.lit(1)).alias("n"))
    before = splits.selectExpr(
        "file AS f", "split AS s", "first",
        "sum(n) OVER (PARTITION BY file ORDER BY split ROWS UNBOUNDED PRECEDING) - n AS before",
    )
    place = F.col("row_id.line") - F.col("first") + F.col("before")
    return lines.join(before, (F.col("row_id.file") == F.col("f")) & (F.col("row_id.split") == F.col("s"))).select(
        F.struct(F.substring_index("f", "/", -1).alias("file"), place.alias("line")).alias("row_id"), "value"
    )


def as_lines(df: DataFrame, key: str, cols: Sequence[str] | None = None) -> DataFrame:
    """A table's rows as comma-separated lines, ``row_id`` being its key."""
    names = list(cols if cols is not None else df.columns)
    texts = [F.coalesce(named(c).cast("string"), F.lit("")) for c in names]
    return df.select(named(key).alias("row_id"), F.concat_ws(SEPARATOR, *texts).alias("value"))


def preview(df: DataFrame, order: str, k: int = 5) -> DataFrame:
    """The first ``k`` rows in a stated order (a top-k, not a sort of all)."""
    return df.orderBy(order).limit(k)


def first_row(df: DataFrame, order: str) -> DataFrame:
    return preview(df, order, 1)
