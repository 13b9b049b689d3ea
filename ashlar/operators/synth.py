"""Mixed label and number rows with given means and variances."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.functions.names import named
from ashlar.functions.numbers import draw_digests, gaussian_draws
from ashlar.functions.text import digest_byte, digest_text, readable_label
from ashlar.operators.profile import profile

# Least and greatest length of the identifying label and of all others.
ID_LENGTHS = (13, 13)
LABEL_LENGTHS = (4, 13)
DIGEST_BYTES = 16


def check_spec(columns: int, means: Sequence[float], variances: Sequence[float]) -> None:
    """Refuse a specification whose lengths differ, before any job runs."""
    if len(means) != columns or len(variances) != columns:
        raise ValueError(
            f"{columns} columns need as many means and variances; "
            f"got {len(means)} means and {len(variances)} variances"
        )
    if any(v < 0 for v in variances):
        raise ValueError("variances must not be negative")


def split_spec(columns: int, spec: Sequence[float]) -> tuple[list[float], list[float]]:
    """One list, means first and variances second, as two."""
    check_spec(columns, spec[:columns], spec[columns:])
    return list(spec[:columns]), list(spec[columns:])


def layout(columns: int) -> list[str]:
    return [name for j in range(columns) for name in (f"label_{j}", f"num_{j}")]


def _label_digest(seed: int, key: Column, column: int, longest: int) -> Column:
    """Bytes for the characters of one label and, at the end, for its length."""
    parts = [F.lit(str(seed)), key, F.lit(f"label{column}")]
    blocks = [digest_text(F.concat_ws("|", *parts))]
    for block in range(1, (longest + DIGEST_BYTES) // DIGEST_BYTES):
        blocks.append(digest_text(F.concat_ws("|", *parts, F.lit(str(block)))))
    return F.concat(*blocks) if len(blocks) > 1 else blocks[0]


def _label(digest: Column, lengths: tuple[int, int]) -> Column:
    shortest, longest = lengths
    if shortest == longest:
        return readable_label(digest, F.lit(longest), longest)
    last = (longest + DIGEST_BYTES) // DIGEST_BYTES * DIGEST_BYTES - 1
    length = digest_byte(digest, last) % (longest - shortest + 1) + shortest
    return readable_label(digest, length, longest)


def fill_rows(
    keys: DataFrame,
    key: str,
    means: Sequence[float],
    variances: Sequence[float],
    seed: int = 0,
    id_lengths: tuple[int, int] = ID_LENGTHS,
    label_lengths: tuple[int, int] = LABEL_LENGTHS,
    keep_key: bool = False,
) -> DataFrame:
    """``label_0, num_0, label_1, num_1, ...`` for every row of ``keys``.

    All values come from digests of seed, key and column, so a lost task repeats them.
    """
    columns = len(means)
    check_spec(columns, means, variances)
    lengths = [id_lengths] + [label_lengths] * (columns - 1)
    if not all(1 <= shortest <= longest for shortest, longest in lengths):
        raise ValueError("label lengths must run from 1 or more upward")
    text = named(key).cast("string")
    noise = draw_digests(text, seed, columns)
    digests = keys.select(
        named(key).alias("__key"),
        *[_label_digest(seed, text, j, lengths[j][1]).alias(f"__d{j}") for j in range(columns)],
        *[d.alias(f"__n{i}") for i, d in enumerate(noise)],
    )
    draws = gaussian_draws([F.col(f"__n{i}") for i in range(len(noise))], columns)
    output = [F.col("__key").alias(key)] if keep_key else []
    for j in range(columns):
        output.append(_label(F.col(f"__d{j}"), lengths[j]).alias(f"label_{j}"))
        output.append((draws[j] * math.sqrt(variances[j]) + means[j]).alias(f"num_{j}"))
    return digests.select(*output)


def generate(
    spark: SparkSession,
    rows: int,
    means: Sequence[float],
    variances: Sequence[float],
    seed: int = 0,
    partitions: int | None = None,
    **lengths,
) -> DataFrame:
    """``rows`` synthetic rows, made where they are needed; nothing passes the driver."""
    check_spec(len(means), means, variances)
    return fill_rows(spark.range(0, rows, 1, partitions), "id", means, variances, seed, **lengths)


def verify(table: DataFrame, means: Sequence[float], variances: Sequence[float]) -> DataFrame:
    """Profile of the number columns beside the specification they should meet."""
    names = [f"num_{j}" for j in range(len(means))]
    specs = F.array(
        *[
            F.struct(F.lit(n).alias("column"), F.lit(float(m)).alias("spec_mean"), F.lit(float(v)).alias("spec_variance"))
            for n, m, v in zip(names, means, variances)
        ]
    )
    found = profile(table, names).select("column", "count", "mean", "variance", F.inline(specs).alias("c", "m", "v"))
    return found.filter("column = c").select(
        "column",
        "count",
        F.col("m").alias("spec_mean"),
        "mean",
        F.col("v").alias("spec_variance"),
        "variance",
        # Distance of the mean from its target, in standard errors.
        F.try_divide(F.col("mean") - F.col("m"), F.sqrt(F.col("v") / F.col("count"))).alias("mean_error"),
    )
