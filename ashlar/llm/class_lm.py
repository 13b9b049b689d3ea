"""Brown class-based bigram model: words are exchanged between classes, texts scored by them.

A word's probability is that of its class after the class before it, times that of the word within
its class. Classes are found by exchange: a word goes where the likelihood of all bigrams of
classes gains most. Everything is counted over all training texts:

* words, once; those of the head (the most frequent, of bounded number) get numbers;
* neighbours: for every word of the head, which others of the head stand beside it how often, in
  blocks of words, so that a task has all that decides about its words. Rounds of exchange read
  these blocks; only classes of head words and one matrix of classes pass the driver;
* words beyond the head take one step of the same exchange, each by all its own neighbours;
* texts become rows of classes, of which the final bigrams are counted and scores made.

Words met once share one class with the words never met, by Good and Turing's shares.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import pieces, written

#: Classes found by exchange. Two more are fixed: rare or unknown words, and the end of a text.
CLASSES = 64
#: Words with numbers, whose classes are broadcast; all others are joined.
HEAD = 1 << 18
#: Words get their first class in waves, each as many times larger than the one before.
WAVE = 4
#: Rounds of exchange after that; in each, every second word may move.
ROUNDS = 4
#: Transitions are blended with the classes' own shares as if seen so many times, per class.
BLEND = 1.0
#: A class is a byte; this one stands for a word beyond the head until it is known.
OPEN = 255
#: Words of a task held before their counts are handed on.
HELD = 600_000
#: Pairs of neighbours held before they are counted and handed on, and bytes of text per block of them.
PAIRS, BLOCK_BYTES, MOST_BLOCKS = 1 << 22, 4_000_000, 1 << 14
#: Counts from here on are grouped by 64ths of their logarithm when the head is chosen.
EXACT_COUNTS = 4096


def lowered(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text, A-Z lowered."""
    return text.lower().split() if text else []


@dataclass
class Head:
    """Numbered words by falling count, and what is known of all others together."""

    words: list[bytes]
    counts: np.ndarray
    #: Of the training texts: tokens with ends, distinct tokens, texts, words met once and twice.
    tokens: int
    distinct: int
    texts: int
    once: int
    twice: int

    @property
    def unknown(self) -> float:
        """Share of never met words among the rare ones."""
        return (self.once + 0.5) / (self.once + 2 * self.twice + 1)


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over all rows of ``body``, added up in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for body in batch.column("body"):
                held.update(lowered(body.as_py()))
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def chosen(counts: DataFrame, texts: int, most: int) -> Head:
    """The head: words met twice or more, of the highest counts, ``most`` at most.

    Counts of counts say from which count on there are no more than that, so nothing is sorted.
    """
    n = F.col("n")
    level = F.when(n < EXACT_COUNTS, n).otherwise(F.lit(EXACT_COUNTS) + F.floor(64 * F.log2(n / EXACT_COUNTS)))
    levels = sorted(tuple(r) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)), F.sum("n"), F.min("n")).collect())
    room, from_count = most, None
    for lv, k, _, low in reversed(levels):
        if k > room or low < 2:
            break
        room, from_count = room - k, low
    rows = [] if from_count is None else counts.filter(n >= from_count).collect()
    rows = sorted(((bytes(r.word), r.n) for r in rows), key=lambda r: (-r[1], r[0]))
    met = {lv: k for lv, k, _, _ in levels}
    return Head(
        [w for w, _ in rows], np.array([k for _, k in rows], np.int64),
        sum(total for _, _, total, _ in levels) + texts, sum(k for _, k, _, _ in levels) + (texts > 0), texts, met.get(1, 0), met.get(2, 0),
    )


def _numbered(bodies: list[bytes | None], numbers: dict[bytes, int]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of some texts, all their numbers (-1 beyond the head), and where each text starts."""
    split = [lowered(b) for b in bodies]
    get = numbers.get
    ids = np.array([get(w, -1) for s in split for w in s], np.int64)
    return split, ids, np.cumsum([0, *[len(s) for s in split]])


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys with counts."""
    steps = np.diff(keys, prepend=0).astype("<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(np.frombuffer(steps, np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    half = raw[: len(raw) // 2], raw[len(raw) // 2 :]
    steps, counts = (np.ascontiguousarray(h.reshape(8, -1).T).view("<i8").ravel() for h in half)
    return np.cumsum(steps), counts


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def neighbours(texts: DataFrame, shared, head: Head, blocks: int) -> DataFrame:
    """``block, data``: for the words of a block (number modulo ``blocks``) their neighbours with
    counts, packed. Neighbours are head words, any word beyond the head, or the text's end, before
    or behind: a key is ``(word * 2 + behind) * (head size + 2) + neighbour``."""
    size = len(head.words)
    wide = size + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, met = shared.value[0], [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            block = (keys // (2 * wide)) % blocks
            order = np.argsort(block, kind="stable")
            keys, counts, block = keys[order], counts[order], block[order]
            first = np.flatnonzero(np.diff(block, prepend=-1))
            cuts = zip(first, np.append(first[1:], len(block)), strict=True)
            data = [_packed(keys[a:b], counts[a:b]) for a, b in cuts]
            return pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(data, pa.binary())], names=["block", "data"])

        for batch in batches:
            for _, bodies in pieces(batch, "body"):
                _, ids, starts = _numbered(bodies, numbers)
                # Each text between two ends.
                line = np.insert(np.where(ids < 0, size, ids), starts[1:], size + 1)
                line = np.concatenate([[size + 1], line])
                one, two = line[:-1], line[1:]
                for word, other, behind in ((one, two, 1), (two, one, 0)):
                    fine = word < size
                    if fine.any():
                        held.append((word[fine] * 2 + behind) * wide + other[fine])
                        met += len(held[-1])
                if met > PAIRS:
                    yield flush()
                    held, met = [], 0
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, met = None, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([_packed(*_summed(parts))], pa.binary())], names=["block", "data"])

        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                if block != at and parts:
                    yield flush()
                    parts, met = [], 0
                at = block
                parts.append(_unpacked(data.as_py()))
                met += len(parts[-1][0])
                if met > PAIRS and len(parts) > 1:
                    parts = [_summed(parts)]
                    met = len(parts[0][0])
        if parts:
            yield flush()

    schema = "block bigint, data binary"
    parts = texts.mapInArrow(count, schema)
    return written(parts.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(merge, schema), "neighbours")


def _log(x: np.ndarray) -> np.ndarray:
    """x ln x, 0 at 0."""
    return x * np.log(np.maximum(x, 1.0))


def gains(n: np.ndarray, own: np.ndarray, behind: np.ndarray, before: np.ndarray, itself: np.ndarray, classes: int) -> np.ndarray:
    """What the log likelihood of all bigrams of classes gains by each word in each class.

    ``n`` holds bigrams of classes as they stand, ``own`` the words' classes, ``behind`` and ``before``
    their neighbours by class (themselves as of their class) and ``itself`` how often a word follows
    itself. A word is taken out of its class first; gains are those of putting it back or elsewhere.
    """
    m, c = behind.shape
    rows = np.arange(m)
    r, l = behind.astype(float), before.astype(float)  # noqa: E741
    total_r, total_l = r.sum(axis=1), l.sum(axis=1)
    r[rows, own] -= itself
    l[rows, own] -= itself
    made = np.zeros((m, classes))
    every = np.arange(classes)
    for own_side, other_side, table in ((r, l, n), (l, r, n.T)):
        # table[b, d]: class b with neighbour class d on this side.
        w, d = np.nonzero(own_side)
        v = own_side[w, d][:, None]
        x = table[:classes, :].T[d].astype(float)
        # The word's own class without it, as a neighbour and as a place.
        at = np.flatnonzero(d == own[w])
        x[at] -= other_side[w[at]][:, :classes]
        inside = np.flatnonzero(own[w] < classes)
        x[inside, own[w[inside]]] = table[own[w[inside]], d[inside]] - own_side[w[inside], d[inside]]
        step = _log(x + v) - _log(x)
        step[d[:, None] == every] = 0  # pairs within one class are counted below
        first = np.flatnonzero(np.diff(w, prepend=-1))
        if len(first):
            made[w[first]] += np.add.reduceat(step, first, axis=0)
    pair = r[:, :classes] + l[:, :classes] + itself[:, None]
    same = np.tile(np.diag(n)[:classes].astype(float), (m, 1))
    mine = np.flatnonzero(own < classes)
    same[mine, own[mine]] -= pair[mine, own[mine]]
    made += _log(same + pair) - _log(same)
    for total, sums in ((total_r, n.sum(axis=1)), (total_l, n.sum(axis=0))):
        x = np.tile(sums[:classes].astype(float), (m, 1))
        x[mine, own[mine]] -= total[mine]
        made -= _log(x + total[:, None]) - _log(x)
    return made


def _sides(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: words with their sides, neighbours, counts."""
    keys, counts = _unpacked(data)
    side = keys // (size + 2)
    return side, keys - side * (size + 2), counts


def _by_class(data: bytes, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: its words, their neighbours behind and before by class, and repeats of themselves."""
    side, other, counts = _sides(data, size)
    word, behind = side >> 1, side & 1 == 1
    words, at = np.unique(word, return_inverse=True)
    c = int(of.max()) + 1
    tables = []
    for pick in (behind, ~behind):
        cells = np.bincount(at[pick] * c + of[other[pick]], weights=counts[pick], minlength=len(words) * c)
        tables.append(cells.reshape(len(words), c))
    selves = np.bincount(at, weights=np.where(behind & (other == word), counts, 0), minlength=len(words))
    return words, tables[0], tables[1], selves


def bigrams(table: DataFrame, of: np.ndarray, size: int) -> np.ndarray:
    """Bigrams of classes of which one side at least is a head word; ``of`` has the classes of all
    neighbours. Others, of words beyond the head and ends, are the same whatever moves."""
    sc = table.sparkSession.sparkContext
    shared, c = sc.broadcast(of), int(of.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(c * c, np.int64)
        of = shared.value
        for batch in batches:
            for data in batch.column("data"):
                side, other, counts = _sides(data.as_py(), size)
                word, behind = of[side >> 1], side & 1 == 1
                # What is before a head word, if no head word itself: those are counted as behind it.
                first = ~behind & (other >= size)
                for one, two, pick in ((word, of[other], behind), (of[other], word, first)):
                    n += np.bincount(one[pick] * c + two[pick], weights=counts[pick], minlength=c * c).astype(np.int64)
        yield _cells(n)

    return _matrix(table.mapInArrow(run, "cell int, n bigint"), c)


def _cells(n: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n.ravel()[at], pa.int64())], names=["cell", "n"])


def _matrix(cells: DataFrame, c: int) -> np.ndarray:
    n = np.zeros(c * c, np.int64)
    for cell, k in cells.groupBy("cell").agg(F.sum("n")).collect():
        n[cell] = k
    return n.reshape(c, c)


def exchanged(table: DataFrame, size: int, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all head words, and the bigrams of classes they lead to.

    The most frequent words start a class each. Waves of others follow, by falling count; then in
    every round each second word may move to where it gains most by the counts as they stand.
    Words without a class yet count as rare ones.
    """
    sc = table.sparkSession.sparkContext
    of = np.full(size + 2, classes, np.int64)
    of[size + 1] = classes + 1
    first = min(classes, size)
    of[:first] = np.arange(first)
    if not size:
        return of, np.zeros((classes + 2, classes + 2), np.int64)
    waves, reach = [], first
    while reach < size:
        start, reach = reach, min(size, reach * WAVE)
        waves.append((start, reach, None))
    for start, end, parity in waves + [(0, size, k % 2) for k in range(rounds)]:
        state = sc.broadcast((of, bigrams(table, of, size)))

        def move(batches: Iterator[pa.RecordBatch], state=state, start=start, end=end, parity=parity) -> Iterator[pa.RecordBatch]:
            of, n = state.value
            for batch in batches:
                for data in batch.column("data"):
                    words, behind, before, selves = _by_class(data.as_py(), of, size)
                    turn = (words >= start) & (words < end)
                    if parity is not None:
                        turn &= ((words * 0x9E3779B1) >> 16) % 2 == parity
                    chosen = np.flatnonzero(turn)
                    for part in (chosen[i : i + 512] for i in range(0, len(chosen), 512)):
                        own = of[words[part]]
                        found = gains(n, own, behind[part], before[part], selves[part], classes)
                        # A word stays where it gains as much.
                        stay = np.flatnonzero(own < classes)
                        found[stay, own[stay]] += 1e-6
                        yield pa.RecordBatch.from_arrays([pa.array(words[part], pa.int64()), pa.array(found.argmax(axis=1), pa.int64())], names=["word", "class"])

        moved = table.mapInArrow(move, "word bigint, class bigint").collect()
        of = of.copy()
        if moved:
            at, to = np.array([tuple(r) for r in moved], np.int64).T
            of[at] = to
    return of, bigrams(table, of, size)


def encoded(rows: DataFrame, shared, head: Head, of: np.ndarray) -> DataFrame:
    """Every text as a byte per word: its class, or OPEN beyond the head, of which ``tail`` tells the
    words; with the number of words and sums over head words of log10 (n + 0.5) and log10 n."""
    classes = of.astype(np.uint8)
    counts = np.maximum(head.counts, 1)
    logs = np.log10(counts + 0.5), np.log10(counts)
    tail_type = "array<struct<word:binary,at:int,before:tinyint,behind:tinyint>>"
    schema = rows.select(
        "uid", "row", "learn", F.lit(0).cast("bigint").alias("n_words"), F.lit(0.0).alias("base"), F.lit(0.0).alias("inner"),
        F.lit("").cast("binary").alias("classes"), F.lit(None).cast(tail_type).alias("tail"),
    ).schema
    listed = pa.list_(pa.struct([("word", pa.binary()), ("at", pa.int32()), ("before", pa.int8()), ("behind", pa.int8())]))
    rare, end = int(of[-2]), int(of[-1])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value[0]
        for batch in batches:
            for first, bodies in pieces(batch, "body"):
                split, ids, starts = _numbered(bodies, numbers)
                beyond = ids < 0
                made = np.where(beyond, OPEN, classes[ids]).astype(np.uint8) if len(ids) else np.zeros(0, np.uint8)
                owner = np.repeat(np.arange(len(split)), np.diff(starts))
                inside = np.flatnonzero(~beyond)
                sums = [np.bincount(owner[inside], weights=log[ids[inside]], minlength=len(split)).astype(float) for log in logs]
                codes = [made[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                # Words beyond the head, with the classes beside them.
                at = np.flatnonzero(beyond)
                text, near = owner[at], np.where(beyond, rare, made)
                before = np.where(at > starts[text], near[at - 1], end)
                behind = np.where(at + 1 < starts[text + 1], near[np.minimum(at + 1, len(near) - 1)], end)
                place = at - starts[text]
                words = [split[t][k] for t, k in zip(text.tolist(), place.tolist(), strict=True)]
                flat = [pa.array(words, pa.binary()), pa.array(place, pa.int32()), pa.array(before, pa.int8()), pa.array(behind, pa.int8())]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(split)))])
                tail = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(flat, fields=list(listed.value_type)))
                kept = [batch.column(c).slice(first, len(bodies)) for c in ("uid", "row", "learn")]
                columns = [*kept, pa.array(np.diff(starts)), pa.array(sums[0]), pa.array(sums[1]), pa.array(codes, pa.binary()), tail]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return written(rows.mapInArrow(run, schema), "encoded")


def placed(tails: DataFrame, n: np.ndarray, classes: int) -> DataFrame:
    """``word, n, class`` of training words beyond the head, by one step of the exchange each; words met
    once are rare ones. ``tails`` has a row per occurrence with the classes beside it."""
    cells = tails.groupBy("word", "before", "behind").agg(F.count(F.lit(1)).alias("k"))
    each = cells.groupBy("word").agg(F.sum("k").alias("n"), F.collect_list(F.struct("before", "behind", "k")).alias("near"))
    c = classes + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                near = part.column("near")
                flat = near.flatten()
                owner = np.repeat(np.arange(len(near)), np.diff(near.offsets.to_numpy()))
                k = flat.field("k").to_numpy()
                sides = [np.bincount(owner * c + flat.field(f).to_numpy(), weights=k, minlength=len(near) * c).reshape(-1, c) for f in ("behind", "before")]
                place = np.full(len(near), classes)
                more = np.flatnonzero(part.column("n").to_numpy() > 1)
                if len(more):
                    place[more] = gains(n, place[more], *(s[more] for s in sides), np.zeros(len(more)), classes).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array(place, pa.int32())], names=["word", "n", "class"])

    return written(each.select("word", "n", "near").mapInArrow(run, "word binary, n bigint, class int"), "beyond")


def classed(coded: DataFrame, beyond: DataFrame, head: Head, rare: int) -> DataFrame:
    """``row, learn, n_words, classes`` with all classes known, ``n_known`` words, ``n_rare`` of these met
    once, and the sums over all words: ``base`` of log10 (n + 0.5), ``inner`` of log10 n of the others."""
    found = (
        coded.filter(F.size("tail") > 0)
        .select("uid", F.inline("tail"))
        .select("uid", "word", "at")
        .join(beyond, "word", "left")
        .groupBy("uid")
        .agg(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(rare)).alias("class"))).alias("tail"))
    )
    columns = ["row", "learn", "n_words", "base", "inner", "classes"]
    open_ = coded.filter(F.size("tail") > 0).select("uid", *columns).join(found, "uid").select(*columns, "tail")
    empty = F.array().cast(found.schema["tail"].dataType)
    closed = coded.filter(F.size("tail") <= 0).select(*columns, empty.alias("tail"))
    schema = closed.select(*columns, F.lit(0).cast("bigint").alias("n_known"), F.lit(0).cast("bigint").alias("n_rare")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tail = batch.column("tail")
            flat = tail.flatten()
            lengths = np.diff(tail.offsets.to_numpy())
            at, n, to = (flat.field(f).to_numpy() for f in ("at", "n", "class"))
            owner = np.repeat(np.arange(len(lengths)), lengths)
            add = lambda v: np.bincount(owner, weights=v, minlength=len(lengths))  # noqa: E731, B023
            base = batch.column("base").to_numpy() + add(np.log10(n + 0.5))
            inner = batch.column("inner").to_numpy() + add(np.where(n > 1, np.log10(np.maximum(n, 1)), 0.0))
            words = batch.column("n_words").to_numpy()
            known, once = words - add(n == 0).astype(np.int64), add(n == 1).astype(np.int64)
            codes, ends = [], np.cumsum(lengths)
            for line, length, stop in zip(batch.column("classes"), lengths.tolist(), ends.tolist(), strict=True):
                if length:
                    full = np.frombuffer(line.as_py(), np.uint8).copy()
                    full[at[stop - length : stop]] = to[stop - length : stop]
                    codes.append(full.tobytes())
                else:
                    codes.append(line.as_py())
            columns = [batch.column("row"), batch.column("learn"), pa.array(words), pa.array(base), pa.array(inner)]
            columns += [pa.array(codes, pa.binary()), pa.array(known), pa.array(once)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return written(open_.unionAll(closed).mapInArrow(run, schema), "classed")


def transitions(texts: DataFrame, classes: int) -> np.ndarray:
    """Bigrams of classes of the training texts, ends included."""
    c = classes + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(c * c, np.int64)
        for batch in batches:
            for line in batch.column("classes"):
                codes = np.frombuffer(line.as_py(), np.uint8).astype(np.int64)
                codes = np.concatenate([[c - 1], codes, [c - 1]])
                n += np.bincount(codes[:-1] * c + codes[1:], minlength=c * c)
        yield _cells(n)

    return _matrix(texts.mapInArrow(run, "cell int, n bigint"), c)


def smoothed(n: np.ndarray) -> np.ndarray:
    """Probabilities of a class (column) after a class (row), blended with the classes' own shares.
    Classes without words have none."""
    seen = n.sum(axis=0)
    open_ = (seen > 0) | (np.arange(len(n)) >= len(n) - 2)
    share = (seen + 0.5 * open_) / (seen.sum() + 0.5 * open_.sum())
    weight = BLEND * len(n)
    return (n + weight * share) / (n.sum(axis=1, keepdims=True) + weight)


def scored(
    docs: DataFrame, keep: list[str], learn: Column, text: str = "text", classes: int = CLASSES, head_size: int = HEAD, rounds: int = ROUNDS
) -> DataFrame:
    """Per row ``row`` (the columns ``keep``), ``n_tokens`` (words and one end), ``n_known`` of them met in
    training, ``train_tokens``, ``base_score`` (log10 of the text by single tokens, 0.5 added to each
    count), ``score`` (log10 of the text by the class model) and ``perplexity`` by it.

    The model learns from the rows where ``learn`` is true, all of them. Up to ``head_size`` words and
    their classes are broadcast; occurrences of words beyond these are joined, by word and then by
    row, so vocabularies may grow without bound. NULL and empty texts are an end; repeated rows count
    again; without training rows all tokens are unknown; an empty table gives no rows. The
    caller's columns stay in ``row``, so none can clash.
    """
    if not 1 <= classes <= 120:
        raise ValueError("classes must be between 1 and 120")
    sc = docs.sparkSession.sparkContext
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.struct(*keep).alias("row"),
        F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text).cast("binary").alias("body"),
    )
    training = rows.filter("learn").select("body")
    texts, size = training.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
    head = chosen(written(word_counts(training), "words"), texts, head_size)
    shared = sc.broadcast(({w: i for i, w in enumerate(head.words)},))
    blocks = int(min(MOST_BLOCKS, max(8, size // BLOCK_BYTES)))
    of, n = exchanged(neighbours(training, shared, head, blocks), len(head.words), classes, rounds)
    coded = encoded(rows, shared, head, of)
    tails = coded.filter(F.col("learn") & (F.size("tail") > 0)).select(F.inline("tail")).select("word", "before", "behind")
    whole = classed(coded, placed(tails, n, classes), head, classes)
    counts = transitions(whole.filter("learn").select("classes"), classes)
    return _probabilities(whole, counts, head, classes)


def _probabilities(whole: DataFrame, counts: np.ndarray, head: Head, classes: int) -> DataFrame:
    rare, c = classes, classes + 2
    step = np.log10(np.maximum(smoothed(counts), 1e-300))
    # Within a class words share by count; rare ones by Good and Turing, the end is alone.
    within = -np.log10(np.maximum(counts.sum(axis=0), 1).astype(float))
    within[rare:] = 0.0
    known_rare = np.log10((1 - head.unknown) / max(head.once, 1)) if head.once else 0.0
    unknown = float(np.log10(head.unknown))
    total = head.tokens + 0.5 * (head.distinct + 1)
    end = float(np.log10(head.texts + 0.5))
    names = ["row", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    schema = whole.select(
        "row", *[F.lit(0).cast("bigint").alias(x) for x in names[1:4]], *[F.lit(0.0).alias(x) for x in names[4:]]
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, known, once, base, inner = (batch.column(x).to_numpy() for x in ("n_words", "n_known", "n_rare", "base", "inner"))
            tokens = words + 1
            base = base + end - tokens * np.log10(total)
            score = inner + once * known_rare + (words - known) * unknown
            moves = []
            for line in batch.column("classes"):
                codes = np.frombuffer(line.as_py(), np.uint8).astype(np.int64)
                full = np.concatenate([[c - 1], codes, [c - 1]])
                moves.append(step[full[:-1], full[1:]].sum() + within[codes].sum())
            score = score + np.array(moves)
            columns = [batch.column("row"), pa.array(tokens), pa.array(known + (head.texts > 0)), pa.array(np.full(len(tokens), head.tokens))]
            columns += [pa.array(base), pa.array(score), pa.array(10 ** (-score / tokens))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return whole.mapInArrow(run, schema)
