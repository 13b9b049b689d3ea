"""Texts that share shingles: SimHash prints propose links, exact Jaccard similarity decides.

The shingles are the distinct runs of ``SHINGLE`` words. Of them ``PRINTS`` independent SimHash
fingerprints are made, each of three bands that vantage-point trees search with radius 1, as in
``simhash``. Two texts of similarity 0.8 differ in about 15 % of a print's bits, so a band finds
them with a chance of about 0.15 and all 27 bands with 0.99; more similar ones sooner. What is
found is a proposal only: shingle sets are compared before anything counts as a link.

What the searches join are clusters. Within a cluster every two texts that no link has joined are
compared, whichever search met them. So many copies of one text cost a few comparisons each; where
a cluster is loose, so that most comparisons fail, their number grows with its square.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import pieces, written
from ashlar.llm.simhash import BLOCK, LEAF, SAMPLE, _away, _bands, _lowered, components, dealt, grown, in_blocks

SHINGLE = 5
SIMILARITY = 0.8
SEED = 7
PRINTS = 9
BANDS = 3
#: Prints of a pair that are compared, that of the band and the next ones, and bits that these may
#: differ in: at similarity 0.8 about 38.7 +- 5.7, of unrelated texts 128 +- 8.
COMPARED = 4
RADIUS = 59
REACH = 1
#: Fingerprints per shard and band aimed at.
SHARD_SIZE = 100_000
#: Proposed pairs that a task gathers before it keeps only trees.
GATHERED = 1 << 18
#: A large cluster is cut into parts, every two of which meet in a task: texts of a part aimed at,
#: parts from which on they grow instead, and the bytes of shingle sets up to which they do.
PART = 256
PARTS = 16
PART_BYTES = 32 << 20
#: Bytes of small clusters' shingle sets that meet in a task, and the least number of such tasks.
BIN_BYTES = 4 << 20
BINS = 64
#: Shingles compared at once.
COUNTED = 1 << 20
_ODD = 0x9E3779B97F4A7C15


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words than a shingle make one, none make none."""
    words = _lowered(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    k = min(SHINGLE, len(words))
    starts = [0, *[e + 1 for e in ends[: len(ends) - k]]]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :])), np.uint64, len(starts)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prints(found: np.ndarray) -> np.ndarray:
    """Independent SimHash fingerprints of a shingle set."""
    made = np.zeros(PRINTS, np.uint64)
    for k in range(PRINTS if len(found) else 0):
        counts = np.zeros(64, np.int64)
        hashes = _mixed(found + np.uint64((k + 1) * _ODD % (1 << 64)))
        for i in range(0, len(hashes), 1 << 14):
            part = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        made[k] = np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]
    return made


def _item(found: np.ndarray) -> int:
    """A name of the shingle set: equal sets have equal names."""
    return xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), SEED)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def printed(docs: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """``row`` (the columns ``keep``), ``item`` and ``prints`` of every whole text."""
    inputs = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("binary").alias("body"))
    schema = inputs.select("row", F.lit(0).cast("bigint").alias("item"), F.array().cast("array<bigint>").alias("prints")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, bodies in pieces(batch, "body"):
                sets = [shingles(b) for b in bodies]
                items = np.array([_item(s) for s in sets], np.uint64).view(np.int64)
                each = [prints(s).view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(first, len(bodies)), pa.array(items), pa.array(each, pa.list_(pa.int64()))],
                    names=["row", "item", "prints"],
                )

    return inputs.mapInArrow(run, schema)


def _merged(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Each number's least one that it is joined with, by ``label`` and the pairs."""
    while (label[u] != label[v]).any():
        np.minimum.at(label, np.maximum(label[u], label[v]), np.minimum(label[u], label[v]))
        while (label[label] != label).any():
            label = label[label]
    return label


def spanning(a: np.ndarray, b: np.ndarray, away: np.ndarray) -> np.ndarray:
    """Which of the pairs, ordered by ``away``, form shortest spanning trees: as many as a group has
    members, the nearest ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label, chosen = np.arange(len(nodes)), np.zeros(len(a), bool)
    while len(live := np.flatnonzero(label[x] != label[y])):
        best = np.full(len(nodes), len(a))
        for side in (x, y):
            np.minimum.at(best, label[side[live]], live)
        pick = np.unique(best[best < len(a)])
        chosen[pick] = True
        label = _merged(label, x[pick], y[pick])
    return chosen


def thinned(a: np.ndarray, b: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs with their distances, nearest first, and which are of spanning trees: these
    join all that the pairs join."""
    order = np.lexsort((b, a, away))
    a, b, away = a[order], b[order], away[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (away[1:] != away[:-1])
    a, b, away = a[fresh], b[fresh], away[fresh]
    return a, b, away, spanning(a, b, away)


def proposals(points: np.ndarray, point_items: np.ndarray, queries: np.ndarray, query_items: np.ndarray, first: int, mask: int):
    """Pairs ``(u, v)`` of items, u > v, that join what all pairs of near prints of a shard join: each
    item with the least one. A row of ``points`` and ``queries`` is the print whose band is
    searched and others."""
    held: list[tuple] = []
    count, shift = 0, np.uint64(first)
    band = lambda v: (v >> shift) & np.uint64(mask)
    stack = [(np.arange(len(points)), np.arange(len(queries)))]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        bp, bq = band(points[p, 0]), band(queries[q, 0])
        if len(p) > LEAF and (bp != bp[0]).any() and (tree := grown(bp, 2)) is not None:
            point, limit = tree[0], tree[1]
            ap, aq = _away(bp, point), _away(bq, point)
            if (ap <= limit).any() and (ap > limit).any():
                stack.append((p[ap <= limit], q[aq - REACH <= limit]))
                stack.append((p[ap > limit], q[aq + REACH > limit]))
                continue
        step = max(1, BLOCK // 8 // len(p))
        for i in range(0, len(q), step):
            away = np.bitwise_count(queries[q[i : i + step], None] ^ points[None, p]).sum(axis=2, dtype=np.uint16)
            s, t = np.nonzero(away <= RADIUS)
            u, v = query_items[q[i + s]], point_items[p[t]]
            other = u != v
            if other.any():
                held.append((np.maximum(u, v)[other], np.minimum(u, v)[other], away[s, t][other]))
                count += int(other.sum())
            if count > GATHERED:
                *pairs, tree = thinned(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held = [tuple(c[tree] for c in pairs)]
                count = 0
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    u, v = (np.concatenate(c) for c in list(zip(*held, strict=True))[:2])
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = _merged(np.arange(len(nodes)), at[: len(u)], at[len(u) :])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def proposed(found: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of items whose components are the clusters, of distinct rows ``item, prints``."""
    names = [f"print{j}" for j in range(COMPARED)]
    bands = [(k, first, mask) for k in range(PRINTS) for first, mask in _bands(BANDS)]
    total = found.count()
    share = min(1.0, SAMPLE / max(total, 1))
    picked = found.filter(F.pmod(F.xxhash64("item", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = np.array([r.prints for r in picked.limit(2 * SAMPLE).collect()], np.int64).reshape(-1, PRINTS).view(np.uint64)
    shards = max(2, total // SHARD_SIZE)
    trees = [grown(np.sort((sample[:, k] >> np.uint64(first)) & np.uint64(mask)), shards) for k, first, mask in bands]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("item").to_numpy()
            every = batch.column("prints").flatten().to_numpy().view(np.uint64).reshape(-1, PRINTS)
            for n, (k, first, mask) in enumerate(bands):
                values = every[:, k]
                rows, leaves, homes = dealt(trees[n], (values >> np.uint64(first)) & np.uint64(mask), REACH)
                shown = [pa.array(every[rows, (k + j) % PRINTS].view(np.int64)) for j in range(COMPARED)]
                fp = pa.StructArray.from_arrays([pa.array(items[rows]), *shown], names=["item", *names])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(n * (shards + 1) + leaves, pa.int64()), fp, pa.array(homes)], names=["shard", "fp", "home"]
                )

    def search(key: tuple, table: pa.Table) -> pa.Table:
        fp = table.column("fp").combine_chunks()
        items, values = fp.field("item").to_numpy(), np.stack([fp.field(c).to_numpy() for c in names], axis=1).view(np.uint64)
        points, queries = (table.column(c).to_numpy(zero_copy_only=False) for c in ("point", "query"))
        _, first, mask = bands[key[0].as_py() // (shards + 1)]
        u, v = proposals(values[points], items[points], values[queries], items[queries], first, mask)
        return pa.table({"u": u, "v": v})

    held = ",".join(f"{n}:bigint" for n in ["item", *names])
    spread = found.select("item", "prints").mapInArrow(deal, f"shard bigint, fp struct<{held}>, home boolean")
    spread = in_blocks(written(spread, "shards"))
    return spread.groupBy("shard", "block").applyInArrow(search, "u bigint, v bigint").distinct()


def shingled(texts: DataFrame) -> DataFrame:
    """``cluster, item, shingles``: the packed shingle set of every row ``cluster, item, body``, written
    to the shared folder."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, bodies in pieces(batch, "body"):
                made = pa.array([shingles(b).astype("<u8").tobytes() for b in bodies], pa.binary())
                named = [batch.column(c).slice(first, len(bodies)) for c in ("cluster", "item")]
                yield pa.RecordBatch.from_arrays([*named, made], names=["cluster", "item", "shingles"])

    return written(texts.mapInArrow(sets, "cluster bigint, item bigint, shingles binary"), "shingles")


def linked(sets: Sequence[np.ndarray], clusters: np.ndarray) -> np.ndarray:
    """A number for each of the sets: the least set's of those that similarities of 0.8 or more join,
    within its cluster. Each two sets of a cluster are compared unless links have joined them."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((sizes, clusters))
    sizes, clusters = sizes[order], clusters[order]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    every, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    label, held = np.arange(len(sets)), np.zeros(len(every), np.int32)
    borders = np.flatnonzero(np.diff(clusters, append=clusters[-1] + 1)) + 1
    # Smaller sets first: of a set's partners none is larger than its size allows.
    for a, border in zip(range(len(sets)), np.repeat(borders, np.diff(borders, prepend=0)), strict=True):
        most = a + 1 + np.searchsorted(sizes[a + 1 : border], sizes[a] / SIMILARITY + 1, side="right")
        others = a + 1 + np.flatnonzero(label[a + 1 : most] != label[a])
        if not len(others) or not sizes[a]:
            continue
        held[flat[starts[a] : ends[a]]] = 1
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes[others]) // COUNTED)) + 1
        for some in np.split(others, cuts):
            first = np.cumsum(sizes[some]) - sizes[some]
            if some[-1] - some[0] + 1 == len(some):
                shown = flat[starts[some[0]] : ends[some[-1]]]
            else:
                shown = flat[np.repeat(starts[some] - first, sizes[some]) + np.arange(first[-1] + sizes[some[-1]])]
            both = np.add.reduceat(held[shown], first)
            near = some[both / (sizes[a] + sizes[some] - both) >= SIMILARITY]
            if len(near):
                names = np.unique(label[np.append(near, a)])
                label[a:border][np.isin(label[a:border], names)] = names[0]
                # What is behind keeps its number; the least one of all stands for it.
                label[names] = names[0]
        held[flat[starts[a] : ends[a]]] = 0
    label = _merged(label, np.arange(len(sets)), label.copy())
    found = np.empty(len(sets), np.int64)
    found[order] = order[label]
    return found


def in_parts(members: DataFrame) -> DataFrame:
    """``deal, block, cluster, item, shingles``: what meets in one task, of rows ``cluster, item, shingles``.

    Small clusters are dealt to bins. A large one is cut into parts by its items' hash, and every
    two of them meet in a block of their own, so all its pairs do and no task holds it.
    """
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("shingles")).alias("bytes"))
    parts = F.greatest(F.expr(f"(bytes - 1) div {PART_BYTES} + 1"), F.least(F.lit(PARTS), F.expr(f"(n - 1) div {PART} + 1")))
    sizes = written(sizes.select(F.col("cluster").alias("c"), "bytes", parts.alias("p")), "clusters")
    total = sizes.filter("p = 1").agg(F.sum("bytes")).first()[0] or 0
    bins, match = max(BINS, total // BIN_BYTES), F.col("cluster") == F.col("c")
    small = members.join(sizes.filter("p = 1"), match).selectExpr(
        f"pmod(xxhash64(cluster), {bins}L) AS deal", "-1L AS block", "cluster", "item", "shingles"
    )
    large = members.join(sizes.filter("p > 1"), match).selectExpr("*", "pmod(xxhash64(item, 'part'), p) AS i")
    met = large.selectExpr("*", "explode(filter(sequence(0L, p - 1), j -> j <> i)) AS j")
    block = F.expr("least(i, j) * p + greatest(i, j)")
    return small.unionAll(met.select(F.col("cluster").alias("deal"), block.alias("block"), "cluster", "item", "shingles"))


def links(members: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that span what similarities of 0.8 or more join within the clusters."""

    def compared(table: pa.Table) -> pa.Table:
        items = table.column("item").to_numpy()
        sets = [np.frombuffer(s.as_buffer(), "<u8") for s in table.column("shingles")]
        found = linked(sets, table.column("cluster").to_numpy())
        moved = np.flatnonzero(found != np.arange(len(items)))
        return pa.table({"u": items[moved], "v": items[found[moved]]})

    return in_parts(members).groupBy("deal", "block").applyInArrow(compared, "u bigint, v bigint").distinct()


def similar(docs: DataFrame, keep: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (the columns ``keep``), ``key`` and ``root``, a name of the component of texts linked
    by a similarity of 0.8 or more. Equal shingle sets are one item; NULL and blank texts, too.

    Prints only are dealt; texts move once for the items of clusters, as shingle sets. Within a
    cluster of near prints all that no link has joined is compared, whatever the cluster's size.
    """
    narrow = docs.select(*dict.fromkeys([*keep, key]), F.col(text).alias("_text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_digest"))
    found = written(printed(narrow, list(dict.fromkeys([*keep, key, "_digest"])), "_text"), "prints")
    each = written(found.groupBy("item").agg(F.min("row._digest").alias("digest"), F.first("prints").alias("prints")), "distinct")
    joined = components(proposed(each))
    # A cluster's least item has no row of its own.
    clusters = joined.select(F.col("node").alias("item"), F.col("root").alias("cluster"))
    clusters = clusters.unionAll(joined.select(F.col("root").alias("item"), F.col("root").alias("cluster")).distinct())
    wanted = each.select("item", "digest").join(clusters, "item")
    texts = narrow.select(F.col("_digest").alias("digest"), F.col("_text").cast("binary").alias("body")).join(wanted, "digest")
    one = texts.groupBy("item").agg(F.first("cluster").alias("cluster"), F.first("body").alias("body"))
    roots = components(links(shingled(one)))
    placed = each.select("item").join(roots, F.col("item") == F.col("node"), "left").select(F.col("item").alias("i"), F.coalesce("root", "item").alias("root"))
    row = F.struct(*[F.col("row").getField(c).alias(c) for c in keep])
    return found.join(placed, F.col("item") == F.col("i")).select(row.alias("row"), F.col("row").getField(key).alias("key"), "root")
