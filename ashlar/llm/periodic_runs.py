"""Periodic runs of words, by a suffix automaton with link-cut access.

The automaton grows word by word. Its link tree is kept as preferred paths (splay trees of a
link-cut forest); all strings on a path last ended at the same place. Access from a new prefix to
the root recolours the path segments it crosses: a segment whose strings of up to L words last
ended d words ago shows that the L + d words up to here have period d. With d <= L that is a
square; L is the longest such string, so it also says where the stretch of that period begins,
and the last word at which it is met is its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import pieces, words_of

#: A run has at least so many words and so many times its period.
LEAST = 6
TIMES = 4
#: Rounds of cutting texts at words that no run can hold; whatever is left goes to the automaton.
ROUNDS = 12


class LinkTree:
    """The link tree of a suffix automaton as preferred paths; node 0 is none.

    ``left`` and ``right`` lead to the higher and lower nodes of a path, ``up`` to the splay parent
    or, from the top of a splay tree, to the tree node above the path. ``last`` is where the strings
    of a path last ended; it is kept at the top of its splay tree only.
    """

    def __init__(self) -> None:
        self.left, self.right, self.up, self.last = [0], [0], [0], [-1]

    def add(self, above: int) -> int:
        """A new leaf below a node, a path of its own that has not ended anywhere yet."""
        for column, value in ((self.left, 0), (self.right, 0), (self.up, above), (self.last, -1)):
            column.append(value)
        return len(self.up) - 1

    def insert_above(self, node: int) -> int:
        """A new node between a node and the one above it, on the node's path."""
        new = self.add(node)
        self._splay(node)
        higher = self.left[node]
        self.left[new], self.left[node] = higher, new
        if higher:
            self.up[higher] = new
        return new

    def _splay(self, x: int) -> None:
        left, right, up, last = self.left, self.right, self.up, self.last
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                last[x] = last[z]
                order = (y, x) if (left[z] == y) == (left[y] == x) else (x, x)
            else:
                last[x] = last[y]
                order = (x,)
            for v in order:
                b = up[v]
                a = up[b]
                if left[a] == b:
                    left[a] = v
                elif right[a] == b:
                    right[a] = v
                up[v] = a
                if left[b] == v:
                    moved = left[b] = right[v]
                    right[v] = b
                else:
                    moved = right[b] = left[v]
                    left[v] = b
                up[b] = v
                if moved:
                    up[moved] = b

    def access(self, node: int, end: int) -> list[tuple[int, int]]:
        """Make the path from a node to the root one that ends here; the segments that it had,
        as (lowest node, where it last ended), from the lowest up."""
        right, up, last, splay = self.right, self.up, self.last, self._splay
        met, below, w = [], 0, node
        while w:
            splay(w)
            met.append((w, last[w]))
            if cut := right[w]:
                last[cut] = last[w]
            right[w] = below
            below, w = w, up[w]
        last[below] = end
        return met


def runs(words: Sequence[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` by start, then period: stretches of smallest period q and at
    least ``max(least, times * q)`` words that neither neighbour extends. ``times`` is 2 or more."""
    tree = LinkTree()
    root = tail = tree.add(0)
    size, link, nexts = [0, 0], [0, 0], [{}, {}]
    ends: dict[tuple[int, int], int] = {}
    for i, word in enumerate(words):
        size.append(size[tail] + 1)
        nexts.append({})
        state, p = len(size) - 1, tail
        link.append(root)
        tree.add(root)
        while p and word not in nexts[p]:
            nexts[p][word] = state
            p = link[p]
        if p:
            q = nexts[p][word]
            if size[q] != size[p] + 1:
                copy = tree.insert_above(q)
                size.append(size[p] + 1)
                nexts.append(nexts[q].copy())
                link.append(link[q])
                link[q] = copy
                while p and nexts[p].get(word) == q:
                    nexts[p][word] = copy
                    p = link[p]
                q = copy
            link[state] = tree.up[state] = q
        tail = state
        for node, before in tree.access(state, i):
            if before >= 0:
                length, period = size[node], i - before
                if length >= (times - 1) * period and length + period >= least:
                    ends[i + 1 - period - length, period] = i
    return sorted((start, end + 1 - start, period) for (start, period), end in ends.items())


def stretches(words: np.ndarray, owner: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Where runs can be, as (first, end): parts of one text whose words stand ``times`` times in them.

    A run holds each of its words that often, so no run crosses a word that is rarer. Cut there,
    words grow rarer within the parts, which are cut again.
    """
    at, part = np.arange(len(words)), owner
    for _ in range(ROUNDS):
        if not len(at):
            return []
        _, inverse, counts = np.unique(part * (int(words.max()) + 1) + words[at], return_inverse=True, return_counts=True)
        often = counts[inverse] >= times
        at, part = at[often], part[often]
        start = np.ones(len(at), bool)
        start[1:] = (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])
        part = np.cumsum(start) - 1
        enough = np.bincount(part)[part] >= max(least, times) if len(at) else often[:0]
        at, part = at[enough], part[enough]
        if often.all() and enough.all():
            break
    firsts = np.flatnonzero(np.diff(part, prepend=-1))
    if not len(firsts):
        return []
    return [(int(at[f]), int(at[e - 1]) + 1) for f, e in zip(firsts, np.append(firsts[1:], len(at)), strict=True)]


def _text_runs(bodies: list[bytes | None], least: int, times: int) -> tuple[list[list[bytes]], list[list[tuple]]]:
    """The words of some texts and their runs."""
    split = [words_of(b) for b in bodies]
    ids: dict[bytes, int] = {}
    words = np.array([ids.setdefault(w, len(ids)) for s in split for w in s], np.int64)
    owner = np.repeat(np.arange(len(split)), [len(s) for s in split])
    firsts = np.cumsum([0, *[len(s) for s in split]])
    found: list[list[tuple]] = [[] for _ in split]
    for first, end in stretches(words, owner, least, times):
        text = int(owner[first])
        shift = first - int(firsts[text])
        found[text] += [(start + shift, length, period) for start, length, period in runs(words[first:end].tolist(), least, times)]
    return split, found


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length over period; of equal ones the first, then that of least period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]


def periodic(
    docs: DataFrame, keep: list[str], text: str = "text", least: int = LEAST, times: int = TIMES, outputs: tuple[str, ...] = ("runs", "collapsed")
) -> DataFrame:
    """Per row ``row`` (the columns ``keep``), ``n_runs``, the strongest run's ``start, length, period, exponent_milli`` (NULL
    without runs) and the wanted ones of ``runs`` (start, length, period), ``collapsed`` (the words
    left, joined by blanks) and the SHA-256 of both, ``runs_sha256`` and ``collapsed_sha256``.

    Nothing moves: rows are worked where they are read, with memory in proportion to the longest
    text. NULL, empty and short texts have no runs and collapse to their words; repeated rows get
    equal results, an empty table none. The caller's columns stay in ``row``, so none can clash.
    """
    inputs = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("binary").alias("body"))
    run_type = "array<struct<start:bigint,length:bigint,period:bigint>>"
    kinds = {"runs": run_type, "collapsed": "string", "runs_sha256": "string", "collapsed_sha256": "string"}
    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]
    schema = inputs.select(
        "row", *[F.lit(None).cast("bigint").alias(n) for n in numbers], *[F.lit(None).cast(kinds[o]).alias(o) for o in outputs]
    ).schema
    listed = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, bodies in pieces(batch, "body"):
                split, found = _text_runs(bodies, least, times)
                best = [strongest(f) or (None, None, None) for f in found]
                columns = [batch.column("row").slice(first, len(bodies)), pa.array([len(f) for f in found], pa.int64())]
                columns += [pa.array([b[i] for b in best], pa.int64()) for i in range(3)]
                columns.append(pa.array([None if b[0] is None else 1000 * b[1] // b[2] for b in best], pa.int64()))
                for o in outputs:
                    if o == "runs":
                        columns.append(pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found], listed))
                    elif o == "runs_sha256":
                        lines = ["".join(f"{s},{k},{q}\n" for s, k, q in f) for f in found]
                        columns.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lines], pa.string()))
                    else:
                        left = [b" ".join(collapsed(w, f)) for w, f in zip(split, found, strict=True)]
                        columns.append(pa.array([x.decode() if o == "collapsed" else hashlib.sha256(x).hexdigest() for x in left], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["row", *numbers, *outputs])

    return inputs.mapInArrow(run, schema)
