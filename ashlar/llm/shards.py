"""Shards by rendezvous hashing of stable keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one shard that are numbered in one task.
BLOCK_ROWS = 100_000
#: Fewest blocks a shard; with few rows they only spread the work.
LEAST_BLOCKS = 64
#: Rows of equal key, size and checksum that one step of the expansion writes out.
RUN_ROWS = 100_000


def _draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the top 53 bits of the hash of key and shard."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    return (bits.cast("double") + 0.5) / float(2**53)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score ``-weight / ln(draw)``, the lower number among equals.

    A shard's expected share is its weight's share. A further shard takes rows only into
    itself; a removed one gives up only its own. A weight of zero takes no rows. NULL keys have
    one hash and stay together.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    scores = [
        F.struct((-float(w) / F.log(_draw(key, i))).alias("score"), F.lit(-i).alias("turn"))
        for i, w in enumerate(weights)
        if w > 0
    ]
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["turn"]).cast("int")


def shard(docs: DataFrame, weights: Sequence[float], grown: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``size`` (UTF-8 bytes plus 1; NULL text counts none), ``text_crc32`` (NULL
    text: that of no bytes, 0), ``shard``, ``grown_shard`` under the weights ``grown`` and
    ``slot``, gapless from 0 within the shard.

    Slots are dealt without bringing a shard together: rows fall into blocks by the hash of
    their key, blocks get offsets from their counts, rows a place within the block. Rows alike
    in key, size and checksum are counted before they move, so a key that holds a third of
    all rows is one row in its block, and are written out again in runs. Such rows are
    interchangeable; everything else depends on the rows alone, so reruns give the same slots.
    An empty table gives no rows.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    body = F.encode(value, "UTF-8")
    narrow = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("crc"),
    )
    blocks = max(LEAST_BLOCKS, docs.count() // (len(weights) * BLOCK_ROWS))
    alike = narrow.groupBy("key", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
    dealt = alike.select(
        "*",
        rendezvous(F.col("key"), weights).alias("shard"),
        rendezvous(F.col("key"), grown).alias("grown"),
        F.pmod(F.xxhash64("key", F.lit("block")), F.lit(blocks)).alias("block"),
    )
    counts = dealt.groupBy("shard", "block").agg(F.sum("n").alias("rows"))
    offsets = counts.selectExpr(
        "shard AS s", "block AS b",
        "sum(rows) OVER (PARTITION BY shard ORDER BY block ROWS UNBOUNDED PRECEDING) - rows AS before",
    )
    placed = dealt.selectExpr(
        "*",
        "sum(n) OVER (PARTITION BY shard, block ORDER BY key, size, crc ROWS UNBOUNDED PRECEDING) - n AS place",
    ).join(offsets, (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b")))
    runs = placed.withColumn("run", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN_ROWS})")))
    each = runs.withColumn(
        "copy",
        F.explode(F.expr(f"sequence(run * {RUN_ROWS}, least(n, (run + 1) * {RUN_ROWS}) - 1)")),
    )
    return each.select(
        F.col("key").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("before") + F.col("place") + F.col("copy")).alias("slot"),
        F.col("grown").alias("grown_shard"),
    )
