"""Near-duplicates by SimHash fingerprints, found with vantage-point trees.

Fingerprints that differ in at most ``RADIUS`` of 64 bits are linked. Cut into ``BANDS`` bands,
two such fingerprints differ in at most ``RADIUS // BANDS`` bits of some band. So each band
is searched on its own: a vantage-point tree over the band's Hamming distance deals the
fingerprints to shards, queries go to every shard that their ball may reach by the triangle
inequality, and trees within the shards prune likewise. Whole fingerprints are compared at the
leaves. In a band a ball of radius 1 meets few shards, where one of radius 4 among all 64 bits
would meet almost all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import pieces, written

SHINGLE = 4
SEED = 42
RADIUS = 4
BANDS = 3
#: Fingerprints per shard aimed at, and the least number of shards a band.
SHARD_SIZE = 20_000
LEAST_SHARDS = 32
#: Points or queries of a shard that meet in one task; larger shards are searched in blocks.
HELD = 1 << 18
#: Fingerprints that the dealing trees are built from; they decide balance, never results.
SAMPLE = 20_000
#: Fingerprints of a leaf that are compared without a further vantage point.
LEAF = 48
#: Pairs compared at once.
BLOCK = 1 << 21


def _lowered(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []  # bytes: only A to Z change


def fingerprint(words: Sequence[bytes]) -> int:
    """Majority bits of the shingles' XXH64; no words: zero."""
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    k = min(SHINGLE, len(words))
    starts = [0, *[e + 1 for e in ends[: len(ends) - k]]]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :])), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``row`` (the columns ``keep``) and ``fp`` (64 bits as a signed long) of every whole text.

    A to Z are lower-cased; words are runs without ASCII blanks; shingles are 4 words, repeats
    included; fewer words make one shingle; NULL and empty texts have fingerprint 0.
    """
    inputs = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("binary").alias("body"))
    schema = inputs.select("row", F.lit(0).cast("bigint").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, bodies in pieces(batch, "body"):
                found = np.array([fingerprint(_lowered(b)) for b in bodies], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(first, len(bodies)), pa.array(found)], names=["row", "fp"]
                )

    return inputs.mapInArrow(run, schema)


def _bands(bands: int) -> list[tuple[int, int]]:
    """First bit and mask of each band."""
    cuts = [64 * i // bands for i in range(bands + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]


def _away(values: np.ndarray, point: int) -> np.ndarray:
    return np.bitwise_count(values ^ np.uint64(point)).astype(np.int64)


def grown(values: np.ndarray, leaves: int) -> list:
    """A vantage-point tree as nested lists ``[point, limit, inner, outer]``; a leaf is None.

    Inner values are at most ``limit`` from the point. The point is the value farthest from
    the first one, the limit the distance that halves the values best.
    """
    if leaves < 2 or len(values) < 2 or (values == values[0]).all():
        return None
    point = int(values[np.argmax(_away(values, int(values[0])))])
    away = _away(values, point)
    counts = np.cumsum(np.bincount(away))
    limit = int(np.argmin(np.abs(2 * counts[:-1] - len(values)))) if len(counts) > 1 else 0
    inner = away <= limit
    return [point, limit, grown(values[inner], leaves // 2), grown(values[~inner], leaves - leaves // 2)]


def dealt(tree: list, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, at home) of every leaf that each value's ball may reach."""
    rows, leaves, homes, number = [], [], [], 0

    def walk(node, at, home):
        nonlocal number
        if node is None:
            rows.append(at), leaves.append(np.full(len(at), number)), homes.append(home)
            number += 1
            return
        point, limit, inner, outer = node
        away = _away(values[at], point)
        near, far = away - radius <= limit, away + radius > limit
        walk(inner, at[near], (home & (away <= limit))[near])
        walk(outer, at[far], (home & (away > limit))[far])

    walk(tree, np.arange(len(values)), np.ones(len(values), bool))
    return np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)


def linked(points: np.ndarray, queries: np.ndarray, first: int, mask: int, radius: int = RADIUS, reach: int = RADIUS // BANDS) -> np.ndarray:
    """Edges ``(from, to)`` that join every query with its near points' components.

    A tree over the band; at its leaves whole fingerprints are compared, block by block. Of a
    leaf's links only a star per component leaves: each value with the least one of its
    component, so a dense group makes as many edges as it has members.
    """
    edges, shift = [], np.uint64(first)
    band = lambda v: (v >> shift) & np.uint64(mask)
    stack = [(points, queries)]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        bp = band(p)
        if len(p) > LEAF and (bp != bp[0]).any():
            tree = grown(bp, 2)
            if tree is not None:
                point, limit = tree[0], tree[1]
                ap, aq = _away(bp, point), _away(band(q), point)
                if (ap <= limit).any() and (ap > limit).any():
                    stack.append((p[ap <= limit], q[aq - reach <= limit]))
                    stack.append((p[ap > limit], q[aq + reach > limit]))
                    continue
        edges.append(_stars(p, q, radius))
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.uint64)


def _stars(p: np.ndarray, q: np.ndarray, radius: int) -> np.ndarray:
    values = np.unique(np.concatenate([p, q]))
    label = np.arange(len(values))
    ip, iq = np.searchsorted(values, p), np.searchsorted(values, q)
    step = max(1, BLOCK // len(p))
    for i in range(0, len(q), step):
        a, b = np.nonzero(np.bitwise_count(q[i : i + step, None] ^ p[None, :]) <= radius)
        a, b = iq[a + i], ip[b]
        # Merge what this block links at once, so that pairs are never gathered.
        while len(a) and (label[a] != label[b]).any():
            np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
            while (label[label] != label).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(len(values)))
    return np.stack([values[moved], values[label[moved]]], axis=1)


def edges_of(found: DataFrame) -> DataFrame:
    """Links ``(u, v)``, u > v as unsigned numbers, that span the components of distinct ``fp``."""
    spark, bands = found.sparkSession, _bands(BANDS)
    total, reach = found.count(), RADIUS // BANDS
    share = min(1.0, SAMPLE / max(total, 1))
    picked = found.filter(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = np.array([r.fp for r in picked.limit(4 * SAMPLE).collect()], np.int64).view(np.uint64)
    sample.sort()
    shards = max(LEAST_SHARDS, total // SHARD_SIZE)
    trees = [grown((sample >> np.uint64(first)) & np.uint64(mask), shards) for first, mask in bands]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy().view(np.uint64)
            for k, (first, mask) in enumerate(bands):
                rows, leaves, homes = dealt(trees[k], (values >> np.uint64(first)) & np.uint64(mask), reach)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k * (shards + 1) + leaves, pa.int64()), pa.array(values[rows].view(np.int64)), pa.array(homes)],
                    names=["shard", "fp", "home"],
                )

    def search(key: tuple, table: pa.Table) -> pa.Table:
        values = table.column("fp").to_numpy().view(np.uint64)
        points, queries = (table.column(c).to_numpy(zero_copy_only=False) for c in ("point", "query"))
        first, mask = bands[key[0].as_py() // (shards + 1)]
        edges = linked(values[points], values[queries], first, mask).view(np.int64)
        return pa.table({"u": edges[:, 0], "v": edges[:, 1]})

    spread = found.select("fp").mapInArrow(deal, "shard bigint, fp bigint, home boolean")
    spread = in_blocks(written(spread, "shards"))
    return spread.groupBy("shard", "block").applyInArrow(search, "u bigint, v bigint").distinct()


def in_blocks(spread: DataFrame) -> DataFrame:
    """``shard, block, fp, point, query``: what meets in one task, of rows ``shard, fp, home``.

    A shard has one block, where values at home are points and all values are queries. Where
    very many fingerprints share a band's value no tree can part them; then points and queries
    are dealt to parts of at most about ``HELD`` each by their hash, and every part of points
    meets every part of queries in a block of its own. No link is lost, no task holds a shard.
    """
    sizes = spread.groupBy("shard").agg(F.count_if("home").alias("p"), F.count(F.lit(1)).alias("q"))
    large = written(sizes.filter(F.col("q") > HELD).withColumnRenamed("shard", "s"), "large")
    one = spread.select("shard", F.lit(0).cast("bigint").alias("block"), "fp", F.col("home").alias("point"), F.lit(True).alias("query"))
    if large.isEmpty():
        return one
    match = F.col("shard") == F.col("s")
    parts = spread.join(large, match).selectExpr("shard", "fp", "home", f"(p - 1) div {HELD} + 1 AS a", f"(q - 1) div {HELD} + 1 AS b")
    points = parts.filter("home").selectExpr("*", "explode(sequence(0L, b - 1)) AS j").selectExpr(
        "shard", "j * a + pmod(xxhash64(fp, 'point'), a) AS block", "fp", "true AS point", "false AS query"
    )
    queries = parts.selectExpr("*", "explode(sequence(0L, a - 1)) AS i").selectExpr(
        "shard", "pmod(xxhash64(fp, 'query'), b) * a + i AS block", "fp", "false AS point", "true AS query"
    )
    return one.join(large, match, "left_anti").unionAll(points).unionAll(queries)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node with an edge, by large and small stars until nothing changes.

    Each round links larger neighbours, then smaller ones, to the smallest neighbour and is
    written to the shared folder, and so are the smallest neighbours before they are joined to
    the links: then both sides of the join are shuffled for it, and Spark splits the links of a
    node that has very many. The number of rounds grows with the logarithm of the longest
    chain, not with a component's size.
    """
    state = None
    edges = written(edges.filter("u <> v"), "edges")
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        least = written(least, "least")
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        root = written(down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), "least")
        small_star = down.join(root, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small_star.union(root.select("k", "m")).filter("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, keep: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (the columns ``keep``), ``key``, ``fp``, ``root`` (one fingerprint that names the
    component) and ``component``: the smallest key that can be reached over links of
    fingerprints, the row's own included.

    Texts are read once and their fingerprints written to the shared folder. The trees see each
    distinct fingerprint once, so exact copies, repeated rows and empty texts cost nothing
    there. NULL keys do not count as smallest; a component of NULL keys alone has NULL. An
    empty table gives no rows.
    """
    printed = written(fingerprints(docs, list(dict.fromkeys([*keep, key])), text), "fingerprints")
    printed = printed.withColumn("key", F.col("row").getField(key))
    each = written(printed.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    roots = components(edges_of(each))
    placed = each.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    lowest = placed.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component"))
    labels = placed.join(lowest, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component")
    return printed.join(labels, F.col("fp") == F.col("f")).select("row", "key", "fp", "root", "component")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", grouped: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest
    key stays (NULL last, then the smallest hash of the text; one of rows alike in both).
    ``grouped`` finds the components: ``near_duplicates`` or ``similar.similar``.

    Groups are settled on narrow rows, pre-aggregated; texts move once, for the final join.
    """
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    narrow = docs.select(F.col(key).alias("key"), digest.alias("digest"), F.col(text).alias("text"))
    found = grouped(narrow, ["digest"], "key", "text")
    order = F.struct(F.col("key").isNull(), F.col("key").alias("key"), F.col("row.digest").alias("digest"))
    alike = found.groupBy("root", "key", "row.digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    best = alike.groupBy("root").agg(F.min(F.struct("o", "n")).alias("b"))
    winners = written(best.select(F.col("b.o.key").alias("_key"), F.col("b.o.digest").alias("_digest"), F.col("b.n").alias("_n")), "winners")
    names = docs.columns

    def rows(which: DataFrame) -> DataFrame:
        match = F.col(key).eqNullSafe(F.col("_key")) & (digest == F.col("_digest"))
        return docs.join(which, match, "left_semi")

    single = rows(winners.filter("_n = 1"))
    if winners.filter("_n > 1").isEmpty():
        return single.select(*names)
    # Repeated rows with one key and text: one of them, whichever; these are few and narrow in key.
    return single.unionByName(rows(winners.filter("_n > 1")).dropDuplicates([key, text])).select(*names)
