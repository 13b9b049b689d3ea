"""Replace a table by a look-alike with the same types, means and variances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.functions.names import named
from ashlar.functions.numbers import draw_digests, gaussian_draws
from ashlar.functions.text import look_alike
from ashlar.operators.profile import ColumnStats, fit, of_type, profile


def row_key(keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *[named(k).cast("string") for k in keys])


def redraw(
    df: DataFrame, keys: Sequence[str], stats: dict[str, ColumnStats], seed: int = 0
) -> DataFrame:
    """The table with an independent normal draw in every numeric cell of ``stats``.

    Draws have the column's mean and deviation; whole-number columns are truncated toward
    zero. ``keys`` must identify a row; the draws depend on them and the seed only.
    """
    numeric = of_type(stats)
    digests = draw_digests(row_key(keys), seed, len(numeric))
    hidden = [F.col(f"__digest{i}") for i in range(len(digests))]
    wide = df.select("*", *[d.alias(f"__digest{i}") for i, d in enumerate(digests)])
    drawn = {}
    for name, draw in zip(numeric, gaussian_draws(hidden, len(numeric))):
        value = draw * F.lit(stats[name].stddev) + F.lit(stats[name].mean)
        drawn[name] = value if stats[name].inferred_type == "Double" else value.cast("bigint")
    return wide.select(*[(drawn[c] if c in drawn else named(c)).alias(c) for c in df.columns])


def anonymize(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str] | None = None,
    seed: int = 0,
    stats: dict[str, ColumnStats] | None = None,
    salt: str = "",
) -> DataFrame:
    """Look-alike text and redrawn numbers for ``cols`` (all by default), other columns left out.

    Two projections over the scan; nothing is shuffled. ``salt`` goes into the digests of text.
    """
    stats = stats or fit(df, cols)
    drawn = redraw(df, keys, stats, seed)
    texts = set(stats) - set(of_type(stats))
    return drawn.select(
        *[(look_alike(named(c).cast("string"), salt) if c in texts else named(c)).alias(c) for c in stats]
    )


def fidelity(before: DataFrame, after: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Means and variances of both tables side by side, with their differences."""
    sides = [
        profile(df, cols).select(
            "column", "col_idx", F.col("mean").alias(f"mean_{s}"), F.col("variance").alias(f"variance_{s}")
        )
        for df, s in ((before, "before"), (after, "after"))
    ]
    return (
        sides[0]
        .join(sides[1].drop("col_idx"), "column")
        .withColumn("mean_delta", F.col("mean_after") - F.col("mean_before"))
        .withColumn("variance_delta", F.col("variance_after") - F.col("variance_before"))
    )
