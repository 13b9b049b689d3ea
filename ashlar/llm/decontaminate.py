"""Benchmark passages in documents, by greedy string tiling over shared-token seeds."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import pieces

#: Tokens of a seed, and of the shortest tile; shorter items are matched as a whole.
LEAST = 5
#: Share of an item's tokens that tiles must cover.
COVERAGE = 0.8
#: Bytes of benchmark text that one pass over the documents holds.
BLOCK_BYTES = 8 << 20
_TOKEN = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: str) -> list[str]:
    """Runs of letters, digits and underscores, lower-cased."""
    return _TOKEN.findall(text.lower())


def _rolled(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` numbers, modulo 2**64."""
    count = len(ids) - size + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total = total * _BASE + mixed[k : k + count]
    return total ^ (total >> np.uint64(31))


def _scan(item: np.ndarray, doc: np.ndarray, free_i: np.ndarray, free_d: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal unmarked matches of at least ``size`` tokens: (length, place in item, in text).

    Only runs without a marked token are hashed, on either side.
    """
    if len(item) < size or len(doc) < size:
        return []
    whole = lambda free: np.flatnonzero(np.convolve(free, np.ones(size, np.int64), "valid") == size)
    starts = whole(free_i)
    if not len(starts):
        return []
    keys = _rolled(item, size)[starts]
    order = np.argsort(keys, kind="stable")
    keys, starts = keys[order], starts[order]
    hashes, at = _rolled(doc, size), whole(free_d)
    low, high = (np.searchsorted(keys, hashes[at], side=side) for side in ("left", "right"))
    reps = high - low
    i = starts[np.repeat(low, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
    j = np.repeat(at, reps)
    inside = (i > 0) & (j > 0) & (item[i - 1] == doc[j - 1]) & free_i[i - 1] & free_d[j - 1]  # of a longer match
    found = []
    for i, j in zip(i[~inside].tolist(), j[~inside].tolist(), strict=True):  # noqa: B020
        n = min(len(item) - i, len(doc) - j)
        fits = (item[i : i + n] == doc[j : j + n]) & free_i[i : i + n] & free_d[j : j + n]
        k = n if fits.all() else int(np.argmin(fits))
        if k >= size:
            found.append((k, i, j))
    return found


def tiles(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: the longest match first, of equal ones that first in the item, then in
    the text; none overlap in either.

    The length looked for starts high and halves. Of a match that others have marked in part, the
    parts still free wait in its place, by their own length.
    """
    free_i, free_d = np.ones(len(item), bool), doc >= 0
    size, made = max(least, min(len(item), 32)), []
    while free_i.any():
        waiting = [(-k, i, j) for k, i, j in _scan(item, doc, free_i, free_d, size)]
        heapq.heapify(waiting)
        while waiting and free_i.any():
            k, i, j = heapq.heappop(waiting)
            free = free_i[i : i - k] & free_d[j : j - k]
            if free.all():
                free_i[i : i - k] = free_d[j : j - k] = False
                made.append((-k, i, j))
                continue
            edges = np.flatnonzero(np.diff(free, prepend=False, append=False))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a >= size:
                    heapq.heappush(waiting, (a - b, i + a, j + a))
        if size == least:
            break
        size = max(least, size // 2)
    return made


class Items:
    """Benchmark items of one block as numbers, with their seeds in order of hash.

    A seed has ``LEAST`` tokens, or all of an item that has fewer: such an item must stand whole.
    """

    def __init__(self, rows: Sequence[tuple[object, str]]):
        self.vocabulary: dict[str, int] = {}
        self.keys, self.tokens = [], []
        for key, text in rows:
            if found := tokens_of(text or ""):
                self.keys.append(key)
                self.tokens.append(np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in found], np.int64))
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({min(LEAST, len(t)) for t in self.tokens}):
            mine = [k for k, t in enumerate(self.tokens) if min(LEAST, len(t)) == size]
            hashes = [_rolled(self.tokens[k], size) for k in mine]
            joined = np.concatenate(hashes)
            order = np.argsort(joined, kind="stable")
            item = np.repeat(mine, [len(h) for h in hashes])[order]
            self.seeds[size] = joined[order], item, np.concatenate([np.arange(len(h)) for h in hashes])[order]

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item, tokens covered, tiles) of the items that the text covers enough."""
        known = self.vocabulary
        ids = np.array([known.get(t, -1) for t in tokens_of(text)], np.int64)
        return sorted(match for size in self.seeds for match in self._seeded(ids, size))

    def _seeded(self, ids: np.ndarray, size: int) -> list[tuple[int, int, int]]:
        seeds, seed_item, seed_place = self.seeds[size]
        if len(ids) < size:
            return []
        at = np.flatnonzero(np.convolve(ids >= 0, np.ones(size, np.int64), "valid") == size)
        if not len(at):
            return []
        hashes = _rolled(ids, size)[at]
        low = np.searchsorted(seeds, hashes)
        high = np.searchsorted(seeds, hashes, side="right")
        hit = high > low
        if not hit.any():
            return []
        at, low, high = at[hit], low[hit], high[hit]
        # The join of seeds: every (place in the text, seed of an item).
        reps = high - low
        seed = np.repeat(low, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        place, item = np.repeat(at, reps), seed_item[seed]
        found = []
        for k in np.unique(item).tolist():
            mine = item == k
            target = self.tokens[k]
            covered = np.zeros(len(target), bool)
            covered[(seed_place[seed[mine]][:, None] + np.arange(size)).ravel()] = True
            if covered.sum() < COVERAGE * len(target):
                continue  # tiles are made of seeds, so they cannot cover more
            used = np.unique((place[mine][:, None] + np.arange(size)).ravel())
            # Only text under seeds can be tiled; gaps shrink to one number that matches nothing.
            gaps = np.flatnonzero(np.diff(used) > 1) + 1
            made = tiles(target, np.insert(ids[used], gaps, -1), size)
            total = sum(t[0] for t in made)
            if total >= COVERAGE * len(target):
                found.append((k, total, len(made)))
        return found


def _blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[Items]:
    """The distinct items in blocks of bounded size, each one to be broadcast."""
    items = benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = -(-size // BLOCK_BYTES)
    for b in range(count):
        block = items.filter(F.pmod(F.xxhash64("k", "t"), F.lit(count)) == b)
        yield Items(sorted(((r.k, r.t) for r in block.toLocalIterator()), key=repr))


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str], text: str = "text", key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``keep``, the item's key, ``n_tokens`` (the item's), ``covered``, ``coverage`` and ``tiles``, one
    row per document row and item with a coverage of 0.8 or more.

    Whole texts are read once per block of the benchmark, without a shuffle; tiles have five
    tokens or more and may come in any order, so reordered passages count. An item of fewer than
    five tokens matches where it stands whole; NULL, empty and wordless texts match nothing; items
    given twice count once; repeated documents are repeated in the result; empty tables give no
    rows.
    """
    inputs = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("binary").alias("body"))
    kind = benchmark.schema[key].dataType
    schema = inputs.select(
        "row", F.lit(None).cast(kind).alias(key), F.lit(0).cast("bigint").alias("n_tokens"),
        F.lit(0).cast("bigint").alias("covered"), F.lit(0.0).alias("coverage"), F.lit(0).cast("bigint").alias("tiles"),
    ).schema
    result = None
    for items in _blocks(benchmark, key, item_text):
        part = inputs.mapInArrow(_finder(inputs, items, schema.names), schema)
        result = part if result is None else result.unionAll(part)
    if result is None:
        result = docs.sparkSession.createDataFrame([], schema)
    return result.select("row.*", *schema.names[1:])


def _finder(inputs: DataFrame, items: Items, names: list[str]):
    shared = inputs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for first, bodies in pieces(batch, "body"):
                rows, found = [], []
                for i, body in enumerate(bodies):
                    for match in items.matches(body.decode()) if body else ():
                        rows.append(first + i)
                        found.append(match)
                if rows:
                    sizes = [len(items.tokens[k]) for k, _, _ in found]
                    columns = [
                        batch.column("row").take(pa.array(rows)),
                        pa.array([items.keys[k] for k, _, _ in found]),
                        pa.array(sizes, pa.int64()),
                        pa.array([c for _, c, _ in found], pa.int64()),
                        pa.array([c / n for (_, c, _), n in zip(found, sizes, strict=True)]),
                        pa.array([t for _, _, t in found], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no item is found in; a further block reads what earlier ones left."""
    spark, names = docs.sparkSession, docs.columns
    left = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(text).cast("binary").alias("body"))

    def keeper(items: Items):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fine = [not body.is_valid or not shared.value.matches(body.as_py().decode()) for body in batch.column("body")]
                yield batch.filter(pa.array(fine, pa.bool_()))

        return run

    for items in _blocks(benchmark, key, item_text):
        left = left.mapInArrow(keeper(items), left.schema)
    return left.select("row.*")
