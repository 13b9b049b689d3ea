"""The data maker: write synthetic rows, read them back and check their moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ashlar.operators.clean import to_columns
from ashlar.operators.synth import check_spec, generate, layout, verify
from ashlar.sources.lines import preview, read_lines
from ashlar.sources.sinks import write_csv


def make_data(
    spark: SparkSession,
    output: str,
    rows: int,
    columns: int,
    means: Sequence[float],
    variances: Sequence[float],
    seed: int = 0,
    partitions: int | None = None,
    mode: str = "errorifexists",
) -> dict[str, DataFrame]:
    """Write ``rows`` lines without a header and profile what was written."""
    check_spec(columns, means, variances)
    made = generate(spark, rows, means, variances, seed, partitions)
    write_csv(made, output, header=False, mode=mode)
    lines = read_lines(spark, output)
    return {
        "preview": preview(lines, "row_id"),
        "check": verify(to_columns(lines, layout(columns)), means, variances),
    }
