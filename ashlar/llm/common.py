"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.session import shared_path

#: Characters between words: space and the controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"

#: Different rows of one key that a sample takes, and bytes of text of a labelled sample.
PER_KEY = 4
SAMPLE_BYTES = 128 << 20


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text; bytes split at exactly these characters."""
    return text.split() if text else []


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """All pairs equal, NULL being equal to NULL."""
    found = F.lit(True)
    for a, b in zip(left, right, strict=True):
        found = found & a.eqNullSafe(b)
    return found


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the session's shared folder and read back: a cut in the lineage that
    outlives lost executors. The files stay for the owner of that folder to remove."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model learns from: CRC-32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def bounded_sample(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """About ``rows`` rows at most, chosen by the hash of their key: the same ones each time.

    Rows alike in all columns count once, and a key has ``PER_KEY`` rows at most, so one key in a
    third of the table counts like any other. What is broadcast are the chosen rows' hashes.
    """
    row = F.xxhash64(F.col(key), F.lit("row"), *[F.col(c) for c in df.columns])
    narrow = df.select(F.xxhash64(F.col(key), F.lit("sample")).alias("k"), row.alias("h")).distinct()
    few = narrow.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("h"))).filter(F.col("n") <= PER_KEY)
    limit = int(rows / max(few.count(), rows, 1) * 2**32)
    chosen = few.filter(F.pmod("k", F.lit(2**32)) < limit).select(F.col("h").alias("_chosen"))
    return df.withColumn("_row", row).join(F.broadcast(chosen), F.col("_row") == F.col("_chosen"), "left_semi").dropDuplicates(["_row"]).drop("_row")


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, by_class: bool = False, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict]:
    """``key, text, label`` of a bounded sample of labelled rows that are not held out, written to
    the shared folder, and how many such labels there are of each class.

    About ``rows`` labels are chosen first, of all or of each class, by the hash of their keys.
    That bounds what is broadcast, and texts are read without moving any but the chosen. Of a key's
    texts ``PER_KEY`` different ones are taken, and of all so many that they have ``SAMPLE_BYTES``.
    """
    learned = labels.select(key, F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & ~held_out(F.col(key)))
    counts = {r.label: r["count"] for r in learned.groupBy("label").count().collect()}
    parts = [learned.filter(F.col("label") == c) for c in sorted(counts)] if by_class and counts else [learned]
    chosen = reduce(DataFrame.unionAll, [bounded_sample(p, rows, key) for p in parts])
    texts = docs.select(key, text).join(F.broadcast(chosen), key).withColumn("_hash", F.xxhash64(F.coalesce(text, F.lit(""))))
    order = Window.partitionBy(key, "label").orderBy("_hash")
    few = texts.dropDuplicates([key, "label", "_hash"]).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= PER_KEY)
    sample = written(few.drop("_n"), "sample")
    size = sample.agg(F.sum(F.octet_length(text))).first()[0] or 0
    if size > SAMPLE_BYTES:
        sample = sample.filter(F.pmod(F.xxhash64(key, "_hash"), F.lit(2**32)) < int(SAMPLE_BYTES / size * 2**32))
    return sample.drop("_hash"), counts


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[int, list]]:
    """A batch's values in runs of about ``most`` bytes, each with its first row's number; so
    working arrays stay small however large a batch is. A long text is a run of its own."""
    values = batch.column(column)
    first, size, run = 0, 0, []
    for i in range(len(values)):
        v = values[i].as_py()
        if run and size + len(v or b"") > most:
            yield first, run
            first, size, run = i, 0, []
        run.append(v)
        size += len(v or b"")
    if run:
        yield first, run
