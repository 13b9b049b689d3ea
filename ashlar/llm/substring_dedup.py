"""Repeated passages: count-min sketches find windows that may repeat, exact groups decide.

The sketch counts anchors rather than windows. A window's anchor is the least hash among its
runs of ``GRAM`` words, so equal windows have equal anchors at equal places, and a window that
occurs twice has an anchor that occurs twice: an anchor's count is never below a window's.
There is about one anchor per fourteen windows, which keeps the sketch small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import pieces, written

WINDOW = 35
GRAM = 8
#: Sketch rows; a window is estimated repeated if all of them say so.
DEPTH = 2
#: Cells per row: from LEAST_BITS to MOST_BITS (as powers of two), about four per anchor. With
#: more anchors than the largest sketch can tell apart, more windows take the exact way; none is lost.
LEAST_BITS, MOST_BITS = 20, 29
#: Cells of a slice of the sketch, as a power of two, and anchors that a task gathers at a time.
SLICE_BITS = 20
GATHERED = 1 << 21
#: Words hashed at once.
REMEMBERED = 300_000
_MULTIPLIER, _OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_known: dict[bytes, int] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _hashed(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; those met lately are remembered per worker, within a bound."""
    known = _known
    if len(known) > REMEMBERED:
        known.clear()
    found = [known.get(w) for w in words]
    if None in found:
        digest = xxhash.xxh64_intdigest
        for i, h in enumerate(found):
            if h is None:
                w = words[i]
                h = known.get(w)
                if h is None:
                    h = known[w] = digest(w)
                found[i] = h
    return np.array(found, np.uint64)


def rolled(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hashes of all runs of ``size`` values: sums of value times power of ``base``, mod 2**64."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    # Doubling: the hash of a run of 2k values from those of two runs of k.
    done, total, made = 0, np.zeros(len(h) - size + 1, np.uint64), h
    length = 1
    while done < size:
        if (size >> (length.bit_length() - 1)) & 1:
            left = size - done - length
            total = total + made[done : done + len(total)] * np.uint64(pow(base, left, 1 << 64))
            done += length
        if done < size:
            made = made[: len(made) - length] * np.uint64(pow(base, length, 1 << 64)) + made[length:]
            length *= 2
    return _mixed(total)


def _sliding(v: np.ndarray, size: int, best) -> np.ndarray:
    """Best of every run of ``size`` values, by doubling."""
    length = 1
    while 2 * length <= size:
        v = best(v[: len(v) - length], v[length:])
        length *= 2
    rest = size - length
    return best(v[: len(v) - rest], v[rest:]) if rest else v


def anchored(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: word hashes, each word's text, gram hashes, and per window start its anchor.

    Windows and grams that would cross from one text into the next get an anchor of zero.
    """
    split = [t.split() if t else [] for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    words = _hashed([w for s in split for w in s])
    owner = np.repeat(np.arange(len(texts)), sizes)
    if len(words) < WINDOW:
        return words, owner, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = np.maximum(rolled(words, GRAM, _MULTIPLIER), np.uint64(1))
    anchors = _sliding(grams, WINDOW - GRAM + 1, np.minimum)
    whole = owner[: len(anchors)] == owner[WINDOW - 1 :]
    return words, owner, grams, np.where(whole, anchors, np.uint64(0))


def marked(grams: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Hashes of all grams that are the anchor of a window over them, once per place.

    A gram is one if the highest anchor among the windows over it is its own hash, for no
    such anchor can be higher. So equal grams side by side all count.
    """
    reach = WINDOW - GRAM
    padded = np.concatenate([np.zeros(reach, np.uint64), anchors, np.zeros(reach, np.uint64)])
    return grams[_sliding(padded, reach + 1, np.maximum)[: len(grams)] == grams]


def _cells(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    """The anchor's cell in every row."""
    rows = [anchors]
    while len(rows) < DEPTH:
        rows.append(_mixed(rows[-1] + np.uint64(_OTHER)))
    return [(r >> np.uint64(64 - bits)).astype(np.int64) for r in rows]


def _touched(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells and whether they were met twice or more."""
    found, times = np.unique(cells, return_counts=True)
    return found, times > 1


def _packed(cells: np.ndarray, twice: np.ndarray) -> bytes:
    """Ascending cells of a slice, as steps with a bit for those met twice."""
    steps = (np.diff(cells, prepend=0) << 1 | twice).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    steps = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    return np.cumsum(steps >> 1), steps & 1 == 1


def sketch(texts: DataFrame, bits: int) -> list[np.ndarray]:
    """Per row of the merged sketch, a bit for every cell: counted twice or more.

    Tasks hand on the cells they touched, slice by slice, some ``GATHERED`` anchors at a time; a
    slice's parts meet in one task, which counts each cell up to two, and come to the driver as bits:
    ``DEPTH * 2**bits / 8`` bytes, at most 128 MB, the bound also of what is then broadcast.
    """
    cut = min(SLICE_BITS, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for d, cells in enumerate(_cells(np.concatenate(held), bits)):
                found, twice = _touched(cells)
                at = found >> cut
                first = np.flatnonzero(np.diff(at, prepend=-1))
                ends = [*first[1:], len(found)]
                parts = [_packed(found[a:b] & ((1 << cut) - 1), twice[a:b]) for a, b in zip(first, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array((d << 40) + at[first]), pa.array(parts, pa.binary())], names=["slice", "cells"])

        for batch in batches:
            for _, bodies in pieces(batch, "body"):
                _, _, grams, anchors = anchored(bodies)
                if len(anchors):
                    held.append(marked(grams, anchors))
                    met += len(held[-1])
                    if met > GATHERED:
                        yield from flush()
                        held, met = [], 0
        if met:
            yield from flush()

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in parts:
            for s, data in zip(batch.column("slice").to_pylist(), batch.column("cells"), strict=True):
                cells, twice = _unpacked(data.as_py())
                counts = held.setdefault(s, np.zeros(1 << cut, np.uint8))
                counts[cells] = np.minimum(counts[cells] + 1 + twice, 2)
        for s, counts in held.items():
            bits_of = zstandard.ZstdCompressor(level=1).compress(np.packbits(counts > 1).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([bits_of], pa.binary())], names=["slice", "cells"])

    schema = "slice bigint, cells binary"
    # All parts of a slice meet in one task, which holds a byte for each of its cells.
    spread = max(8, min(4096, DEPTH << (bits - cut)))
    merged = texts.mapInArrow(count, schema).repartition(spread, "slice").mapInArrow(merge, schema)
    twice = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in range(DEPTH)]
    wide = max(1, (1 << cut) // 8)
    for row in merged.toLocalIterator():
        d, s = row.slice >> 40, row.slice & ((1 << 40) - 1)
        twice[d][s * wide : (s + 1) * wide] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row.cells)), np.uint8)
    return twice


def _repeated(cells: np.ndarray, row: np.ndarray) -> np.ndarray:
    return (row[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1


#: Candidate windows a task holds at once.
HELD = 1 << 18
#: A window's hash: 96 bits.
HASH = np.dtype([("h", "<i8"), ("g", "<i4")])
#: First word of a row of hashes that a task met twice or more, which belong to no text.
ALL = -1
COLUMNS = ["anchor", "ka", "kb", "at", "run", "hashes"]


def _cut(*changes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal rows begin and end."""
    new = np.ones(len(changes[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in changes], axis=0)
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(new))


def _rows(anchor, ka, kb, at, run, hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Rows of which each holds a stretch of the hashes."""
    offsets = np.append(first, end[-1] if len(end) else 0) * HASH.itemsize
    data = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(hashes.tobytes())])
    columns = [pa.array(anchor, pa.int64()), pa.array(ka, pa.int64()), pa.array(kb, pa.int64()), pa.array(at, pa.int32()), pa.array(run, pa.int32())]
    return pa.RecordBatch.from_arrays([*columns, data.cast(pa.binary())], names=COLUMNS)


def _settled(ka, kb, at, anchor, windows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a task hands on of its candidate windows, which come in the order of the texts.

    Windows side by side with one anchor travel as one row: where they begin, and their hashes. A
    hash that the task met more than once is settled: it goes on alone, once, for other tasks to
    see, and its places as runs of windows, each text once. So however often a window occurs, a
    task hands on its hash once.
    """
    order = np.lexsort((windows["g"], windows["h"]))
    first, end = _cut(windows["h"][order], windows["g"][order])
    many = np.empty(len(order), bool)
    many[order] = np.repeat(end - first > 1, end - first)
    one = np.flatnonzero(~many)
    if len(one):
        a, b = _cut(ka[one], kb[one], anchor[one], at[one] - np.arange(len(one)))
        yield _rows(anchor[one][a], ka[one][a], kb[one][a], at[one][a], np.zeros(len(a)), windows[one], a, b)
    if len(one) == len(order):
        return
    heads = order[first[end - first > 1]]
    heads = heads[np.argsort(anchor[heads], kind="stable")]
    a, b = _cut(anchor[heads])
    none = np.zeros(len(a), np.int64)
    yield _rows(anchor[heads][a], none, none, none + ALL, none, windows[heads], a, b)
    places = np.flatnonzero(many)
    places = places[np.lexsort((at[places], kb[places], ka[places]))]
    a, _ = _cut(ka[places], kb[places], at[places])
    places = places[a]
    a, b = _cut(ka[places], kb[places], at[places] - np.arange(len(places)))
    none = np.zeros(len(a), np.int64)
    yield _rows(ka[places][a], ka[places][a], kb[places][a], at[places][a], b - a, windows[:0], none, none)


def candidates(rows: DataFrame, twice: list[np.ndarray], bits: int) -> DataFrame:
    """Windows estimated repeated, by anchor: the text ``ka, kb`` and the first word ``at`` of some side
    by side with their ``hashes``, or, with ``run``, so many that are known to repeat."""
    shared = rows.sparkSession.sparkContext.broadcast(twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        for batch in batches:
            ka, kb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ka", "kb"))
            for first, bodies in pieces(batch, "body"):
                words, owner, _, anchors = anchored(bodies)
                fine = anchors != 0
                for row, cells in zip(shared.value, _cells(anchors, bits), strict=True):
                    fine &= _repeated(cells, row)
                at = np.flatnonzero(fine)
                if not len(at):
                    continue
                text, windows = owner[at], np.empty(len(at), HASH)
                windows["h"] = rolled(words, WINDOW, _MULTIPLIER)[at].view(np.int64)
                windows["g"] = (rolled(words, WINDOW, _OTHER)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                held.append((ka[first + text], kb[first + text], at - np.searchsorted(owner, text), anchors[at].view(np.int64), windows))
                count += len(at)
                if count >= HELD:
                    yield from _settled(*[np.concatenate(c) for c in zip(*held, strict=True)])
                    held, count = [], 0
        if held:
            yield from _settled(*[np.concatenate(c) for c in zip(*held, strict=True)])

    return rows.mapInArrow(run, "anchor bigint, ka bigint, kb bigint, at int, run int, hashes binary")


def _decided(rows: pa.Table) -> pa.RecordBatch:
    """Of rows with all that tasks met under their anchors: the texts' runs of repeated windows, as
    ``place``: first word and number of windows."""
    ka, kb, at, run = (rows.column(c).to_numpy() for c in ("ka", "kb", "at", "run"))
    data = rows.column("hashes").combine_chunks()
    data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
    windows = np.frombuffer(b"".join(x.as_py() for x in data), HASH)
    lengths = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64) // HASH.itemsize
    owner = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((windows["g"], windows["h"]))
    again = np.zeros(len(windows), bool)
    if len(order):
        first, end = _cut(windows["h"][order], windows["g"][order])
        times = np.add.reduceat(np.where(at[owner[order]] == ALL, 2, 1), first)
        again[order] = np.repeat(times > 1, end - first)
    mine = np.flatnonzero(again & (at[owner] != ALL))
    known = np.flatnonzero(run > 0)
    text, place = owner[mine], mine - (np.cumsum(lengths) - lengths)[owner[mine]] + at[owner[mine]]
    if len(mine):
        a, b = _cut(text, place - np.arange(len(place)))
        text, place, size = text[a], place[a], b - a
    else:
        size = place
    text, place, size = (np.concatenate(x).astype(np.int64) for x in ((text, known), (place, at[known]), (size, run[known])))
    return pa.RecordBatch.from_arrays([pa.array(ka[text]), pa.array(kb[text]), pa.array((place << 32) + size)], names=["ka", "kb", "place"])


def decided(rows: DataFrame) -> DataFrame:
    """``ka, kb, place`` of candidates, dealt by anchor: a window repeats if tasks met its hash more than
    once in all. A task hands on a hash once at most, so an anchor has no more of each than there
    are tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows come by anchor; the last one's may go on in the next batch.
            anchor = batch.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))
            goes_on = held and not cut and held[-1].column("anchor")[0].as_py() == anchor[-1]
            if not goes_on and (held or cut):
                yield _decided(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield _decided(pa.Table.from_batches(held))

    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "ka bigint, kb bigint, place bigint")


def repeats(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list]:
    """Per text with repeated windows its key ``ka, kb`` and ``places``, written to the shared
    folder; and the key as columns of ``docs``. Texts are told apart by 96 bits, NULL being empty."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    key = [F.xxhash64(body), F.crc32(body)]
    keyed = docs.select(key[0].alias("ka"), key[1].alias("kb"), body.alias("body"))
    size = keyed.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    # About one anchor per 14 words of some six bytes, and four cells for each.
    bits = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(max(1, size / 20))))))
    found = decided(candidates(keyed, sketch(keyed.select("body"), bits), bits))
    places = found.groupBy("ka", "kb").agg(F.collect_set("place").alias("places"))
    return written(places, "repeats"), key


def without_repeats(docs: DataFrame, keep: list[str], text: str = "text", outputs: tuple[str, ...] = ("kept",)) -> DataFrame:
    """``keep``, ``n_words``, ``n_removed`` and the wanted ones of ``kept`` (the words left, joined
    by blanks) and ``kept_sha256``, per row.

    A word goes if a window of 35 words over it also starts anywhere else, the same text
    included; windows are judged on the input. NULL and short texts lose nothing; of equal
    texts, as of repeated rows, all lose all repeated windows. An empty table gives no rows.

    Only windows that the sketch takes for repeated move, as hashes, and texts once, in a
    join whose skewed partitions (many copies of one text) Spark splits.
    """
    places, key = repeats(docs, text)
    mine = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("binary").alias("body"), key[0].alias("a"), key[1].alias("b"))
    joined = mine.join(places, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")), "left").select("row", "body", "places")
    schema = joined.select(
        "row",
        F.lit(0).cast("bigint").alias("n_words"),
        F.lit(0).cast("bigint").alias("n_removed"),
        *[F.lit(None).cast("string").alias(o) for o in outputs],
    ).schema

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {"kept": lambda k: k.decode(), "kept_sha256": lambda k: hashlib.sha256(k).hexdigest()}
        for batch in batches:
            for first, bodies in pieces(batch, "body"):
                totals, gone, kept = [], [], []
                marks = batch.column("places").slice(first, len(bodies))
                for t, found in zip(bodies, marks, strict=True):
                    words = t.split() if t else []
                    totals.append(len(words))
                    if found.is_valid:
                        place = found.values.to_numpy()
                        at, length = place >> 32, np.maximum(place & 0xFFFFFFFF, 1)
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, at, 1)
                        np.add.at(change, at + length - 1 + WINDOW, -1)
                        words = list(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))
                    gone.append(totals[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(first, len(bodies)), pa.array(totals, pa.int64()), pa.array(gone, pa.int64())]
                    + [pa.array([made[o](k) for k in kept], pa.string()) for o in outputs],
                    names=["row", "n_words", "n_removed", *outputs],
                )

    return joined.mapInArrow(finish, schema).select("row.*", "n_words", "n_removed", *outputs)
