"""The anonymizer: clean a text file, substitute it and compare both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ashlar.operators.anonymize import anonymize, fidelity
from ashlar.operators.clean import rectangularize
from ashlar.operators.profile import fit, profile
from ashlar.sources.lines import numbered_lines
from ashlar.sources.sinks import read_back, write_csv


def make_substitute(
    spark: SparkSession,
    path: str,
    output: str,
    header: bool | None = True,
    seed: int = 0,
    mode: str = "errorifexists",
    salt: str = "",
    least_parse_rate: float = 0.0,
) -> dict[str, DataFrame]:
    """Write look-alike data under the original header, read it back and compare.

    Draws are keyed on the file's name and the line's number, so that neither the folder nor
    the packing of splits into tasks changes them, but for the last digits of the fitted means.
    Files of one name get equal draws. ``salt`` goes into the digests of text; columns with a
    smaller share of numbers than ``least_parse_rate`` are text.
    """
    table = rectangularize(numbered_lines(spark, path), header)
    header = table.header
    stats = fit(table.rows, table.names, least_parse_rate=least_parse_rate)
    substituted = anonymize(table.rows, ["row_id"], table.names, seed, stats, salt)
    write_csv(substituted, output, header=header, mode=mode)
    again = read_back(spark, output, header)
    return {
        "rejected": table.rejected,
        "parameters": profile(table.rows, table.names, least_parse_rate=least_parse_rate),
        "substituted": again.rows.drop("row_id"),
        "fidelity": fidelity(table.rows, again.rows, table.names),
    }
