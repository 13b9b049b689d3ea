"""CSV and text sinks. Every task writes its own part file."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashlar.functions.names import named
from ashlar.operators.clean import Table, rectangularize
from ashlar.operators.normalize import labeled_norms, zscore
from ashlar.operators.profile import ColumnStats
from ashlar.sources.lines import read_lines


# What a written text survives unchanged: line breaks, commas and quotes inside it (quotes are
# doubled), blanks at its ends; and line ends other than the sink's own are left alone.
EXACT = {"lineSep": "\n", "quote": '"', "escape": '"'}


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "errorifexists", exact: bool = False) -> None:
    """Comma-separated part files; blanks at either end of a text and empty text survive.

    With ``exact`` every text comes back from ``read_table_back`` as it was, line breaks and
    quotes included, and NULL is told from empty text, which is then written as two quotes.
    """
    writer = (
        df.write.mode(mode)
        .option("header", header)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    (writer.options(**EXACT, emptyValue='""') if exact else writer.option("emptyValue", "")).csv(path)


def write_text(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The ``value`` column as text part files."""
    lines.select("value").write.mode(mode).text(path)


def write_normalized(
    df: DataFrame,
    path: str,
    cols: Sequence[str] | None = None,
    stats: dict[str, ColumnStats] | None = None,
    mode: str = "errorifexists",
) -> None:
    """Header, text columns as they are, numbers as z-scores."""
    write_csv(zscore(df, cols, stats), path, mode=mode)


def write_norms(
    df: DataFrame,
    path: str,
    ids: Sequence[str] | None = None,
    cols: Sequence[str] | None = None,
    stats: dict[str, ColumnStats] | None = None,
    mode: str = "errorifexists",
) -> None:
    """Identifying columns with ``L1-Norm`` and ``L2-Norm``."""
    write_norm_table(labeled_norms(df, ids, cols, stats), path, mode)


def write_norm_table(norms: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Labeled norms that are made already."""
    write_csv(norms.withColumnsRenamed({"l1_norm": "L1-Norm", "l2_norm": "L2-Norm"}), path, mode=mode)


def label_path(input_path: str, folder: str) -> str:
    """Where the norms of an input go: its name without the ending, plus ``Label.csv``."""
    name = posixpath.basename(input_path.rstrip("/"))
    return posixpath.join(folder, posixpath.splitext(name)[0] + "Label.csv")


def read_back(spark: SparkSession, path: str, header: bool = True) -> Table:
    """Read a written table through the same cleaning as any input.

    Each part file repeats the header; all of them are removed.
    """
    return rectangularize(read_lines(spark, path), header)



def read_table_back(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A table that ``write_csv`` wrote with header and ``exact``, as it was.

    Records end where the quotes do, not at every line break, and each file's first record is
    its header; rows that look like it are rows. A file is read by one task, as it was written
    by one.
    """
    # Read plainly, both come back as NULL: an empty text is marked by a word no file can hold.
    empty = uuid.uuid4().hex
    rows = (
        spark.read.schema(schema)
        .options(**EXACT, header=True, multiLine=True, enforceSchema=True, emptyValue=empty, mode="FAILFAST", maxCharsPerColumn=-1)
        .csv(path)
    )
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    return rows.select(*[(F.when(named(c) == empty, "").otherwise(named(c)) if c in texts else named(c)).alias(c) for c in rows.columns])
