"""Byte-pair encoding and decoding: propose, verify, and merge exactly only where needed.

A proposal splits every distinct piece by greedy longest match. A token sequence is what the
merges give exactly if each token, merged from its own symbols, gives itself, and no merge
crosses the border of two neighbours. The second is checked for all neighbours of a batch at
once; pieces with a failing pair are merged by rank.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"
IDS = pa.list_(pa.int32())
NEVER = np.int64(1 << 40)
NO_MERGE = (1 << 40, -1)
#: Symbols up to which a plain search for the best merge is faster than a heap.
SHORT = 32
#: White space that separates pieces, as code points.
SPACES = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
#: How text is cut into pieces before merging; white space is dropped, but for new lines.
PIECE = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}" + "".join(map(chr, SPACES)) + "]+|\n"
)
#: The same for lower-case ASCII.
ASCII_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^a-z0-9\t-\r ]+|\n")
#: Runs without blanks that a worker remembers, in two generations of half as many each; of
#: the pieces in them it remembers half as many. Arrow arrays hold them, some 30 bytes each.
REMEMBERED = 400_000
#: Bytes of the longest entry that is remembered.
ENTRY_BYTES = 400
#: Bytes of text that is cut and looked up together, as Arrow arrays.
RUN_BYTES = 1 << 22
#: Unknown runs or pieces that are Python strings at once, and bytes of them.
STRINGS, STRING_BYTES = 1 << 14, 1 << 18
#: Tokens whose texts are made at once.
SHOWN = 1 << 17
#: What ``encode`` can return besides the row.
OUTPUTS = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


def _byte_letters() -> list[str]:
    """One printable character per byte, as byte-level vocabularies are written: printable
    Latin-1 stands for itself, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


LETTERS = dict(enumerate(_byte_letters()))


def _lowered(text: str) -> str:
    """Normal form and lower case, character by character: a capital sigma is never a final one."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _pieces_in(lowered: str) -> list[str]:
    return (ASCII_PIECE if lowered.isascii() else PIECE).findall(lowered)


def _letters(piece: str) -> str:
    """A piece as byte letters."""
    return piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(LETTERS)


@dataclass
class Vocabulary:
    """Tables of one tokenizer file; plain data, so that executors get it by broadcast."""

    ids: dict[str, int]
    texts: dict[int, str]
    special: dict[str, int]
    ranks: dict[tuple[int, int], tuple[int, int]]  # pair -> rank, product
    rank: np.ndarray  # of the merge that makes a token; -1: a symbol
    left: np.ndarray
    right: np.ndarray
    keys: np.ndarray  # pairs as single numbers, sorted
    key_rank: np.ndarray
    sound: np.ndarray  # merged from its own symbols, the token is itself
    reach: dict[str, int]  # first letters, three at most -> letters of the longest token with them

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a ``tokenizers`` file of BPE with word ends."""
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, special = whole["model"], {t["content"]: t["id"] for t in whole["added_tokens"]}
        if model.get("end_of_word_suffix") != END or model.get("ignore_merges") or whole.get("decoder"):
            raise ValueError("only BPE with word ends, merges in use and no decoder is read here")
        ids = model["vocab"]
        size = max([*ids.values(), *special.values()]) + 1
        rank, left, right = (np.full(size, -1, np.int64) for _ in range(3))
        ranks = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made = ids[a + b]
            ranks[ids[a], ids[b]] = r, made
            if rank[made] < 0:
                rank[made], left[made], right[made] = r, ids[a], ids[b]
        keys = np.array([a * size + b for a, b in ranks], np.int64)
        order = np.argsort(keys)
        key_rank = np.array([r for r, _ in ranks.values()], np.int64)[order]
        texts = {i: t for t, i in ids.items()} | {i: t for t, i in special.items()}
        reach: dict[str, int] = {}
        for stem in (t.removesuffix(END) for t in ids):
            reach[stem[:3]] = max(reach.get(stem[:3], 0), len(stem))
        made = cls(ids, texts, special, ranks, rank, left, right, keys[order], key_rank, np.zeros(size, bool), reach)
        for token, i in ids.items():
            made.sound[i] = made.merged(made.symbols(token.removesuffix(END), token.endswith(END))) == [i]
        return made

    def symbols(self, word: str, ends: bool = True) -> list[int]:
        letters = list(word)
        if ends and letters:
            letters[-1] += END
        elif ends:
            letters = list(END)
        return [self.ids[x] for x in letters]

    def merged(self, tokens: list[int]) -> list[int]:
        """Merge by rank, the leftmost first among equals; a heap keeps long words cheap."""
        n = len(tokens)
        if n <= SHORT:
            return self._merged_short(list(tokens))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        heap = [(ranks[p][0], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in ranks]
        heapq.heapify(heap)
        tokens = list(tokens)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if tokens[i] < 0 or j >= n:
                continue
            found = ranks.get((tokens[i], tokens[j]))
            if found is None or found[0] != r:
                continue
            tokens[i], tokens[j] = found[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := ranks.get((tokens[i], tokens[k]))) is not None:
                    heapq.heappush(heap, (p[0], i))
            if (h := before[i]) >= 0 and (p := ranks.get((tokens[h], tokens[i]))) is not None:
                heapq.heappush(heap, (p[0], h))
        return [t for t in tokens if t >= 0]

    def _merged_short(self, tokens: list[int]) -> list[int]:
        known = self.ranks.get
        pairs = [known(p, NO_MERGE) for p in zip(tokens, tokens[1:])]
        while pairs and (best := min(pairs)) is not NO_MERGE:
            i = pairs.index(best)
            tokens[i : i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = known((tokens[i - 1], tokens[i]), NO_MERGE)
            if i < len(pairs):
                pairs[i] = known((tokens[i], tokens[i + 1]), NO_MERGE)
        return tokens

    def proposed(self, word: str) -> list[int]:
        """Greedy longest match; the last token must carry the word's end."""
        ids, reach, n, i, found = self.ids, self.reach, len(word), 0, []
        while i < n:
            j = min(n, i + reach.get(word[i : i + 3], 2))
            while True:
                token = ids.get(word[i:j] + END if j == n else word[i:j])
                if token is not None:
                    break
                j -= 1
            found.append(token)
            i = j
        return found

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Per pair of neighbours, whether no merge crosses their border.

        The parts at the border are followed backwards, the latest made being split first.
        A part lives until its own parent is made. Two parts that meet are merged across
        the border if that has a lower rank than both parents, or the same rank as the right
        one's, for the leftmost of equal merges comes first.
        """
        size, fine = len(self.rank), np.ones(len(a), bool)
        live, x, y = np.arange(len(a)), a.copy(), b.copy()
        px, py = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(live):
            key = x * size + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            r = np.where(self.keys[at] == key, self.key_rank[at], NEVER)
            crossed = (r < px) & (r <= py) & (r < NEVER)
            fine[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~crossed & (np.maximum(rx, ry) >= 0)
            live, x, y, px, py, rx, ry = (v[on] for v in (live, x, y, px, py, rx, ry))
            first = rx > ry
            px, py = np.where(first, rx, px), np.where(first, py, ry)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return fine

    def words(self, words: Sequence[str]) -> list[list[int]]:
        """Tokens of byte-letter words: proposals, checked together, merged exactly if they fail."""
        found = [self.proposed(w) for w in words]
        if not found:
            return found
        flat = np.fromiter((t for f in found for t in f), np.int64)
        ends = np.cumsum([len(f) for f in found], dtype=np.int64)
        failing = ~self.sound[flat]
        if len(flat) > 1:
            inner = np.ones(len(flat) - 1, bool)
            inner[ends[:-1] - 1] = False
            at = np.flatnonzero(inner)
            pairs, back = np.unique(flat[at] * len(self.rank) + flat[at + 1], return_inverse=True)
            fine = self.compatible(pairs // len(self.rank), pairs % len(self.rank))
            failing[at] |= ~fine[back]
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(failing), side="right")):
            found[k] = self.merged(self.symbols(words[k]))
        return found

    def pieces_of(self, chunks: Sequence[str]) -> list[str]:
        """Pieces and special tokens of runs of text without ASCII blanks, a new line after each run.

        All runs are brought to normal form and lower case as one text; the new lines keep them
        apart. A special token has a new line before its text.
        """
        whole = "\n".join(chunks) + "\n"
        if any(s in whole for s in self.special):
            return [p for c in chunks for p in [*self._with_special(c), "\n"]]
        return _pieces_in(_lowered(whole))

    def _with_special(self, chunk: str) -> Iterator[str]:
        for part in regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", chunk):
            if part in self.special:
                yield "\n" + part
            elif part:
                yield from _pieces_in(_lowered(part))

    def tokens_of(self, pieces: Sequence[str]) -> list[list[int]]:
        """Tokens of pieces and special tokens as ``pieces_of`` gives them."""
        plain = iter(self.words([_letters(p) for p in pieces if p[0] != "\n"]))
        return [[self.special[p[1:]]] if p[0] == "\n" else next(plain) for p in pieces]

    def decoded(self, ids: Iterable[int]) -> str:
        """Token texts joined by a blank; word ends stay visible, as there is no decoder."""
        return " ".join([self.texts[i] for i in ids])


def _listed(lists: Sequence[Sequence[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    flat = np.fromiter((t for f in lists for t in f), np.int32, ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _parts(strings: pa.Array) -> Iterator[pa.Array]:
    """Slices of few strings and bytes each; a long string is a slice of its own."""
    ends = np.cumsum(pc.binary_length(strings).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(strings):
        most = (ends[first - 1] if first else 0) + STRING_BYTES
        after = max(first + 1, min(first + STRINGS, int(np.searchsorted(ends, most, side="right"))))
        yield strings.slice(first, after - first)
        first = after


class Recent:
    """Strings -> ids, a bounded map in two generations: when the newer is full, the older is
    forgotten, but for what was looked up meanwhile. Both are Arrow arrays."""

    def __init__(self, most: int, kind: pa.DataType):
        self.half = most // 2
        self.none = pa.RecordBatch.from_arrays([pa.array([], kind), pa.array([], IDS)], names=["name", "ids"])
        self.new = self.old = self.none

    def look_up(self, names: pa.Array, make: Callable[[pa.Array], pa.ListArray]) -> pa.ListArray:
        """The ids of different strings; ``make`` gives those of unknown ones."""
        in_new = pc.index_in(names, self.new.column("name"))
        rest = names.filter(in_new.is_null())
        in_old = pc.index_in(rest, self.old.column("name"))
        unknown = rest.filter(in_old.is_null())
        made = [make(part) for part in _parts(unknown)]
        found = pa.concat_arrays([self.old.column("ids"), *made])
        nth = pc.cumulative_sum(in_old.is_null().cast(pa.int32()))
        found = found.take(pc.if_else(in_old.is_null(), pc.add(nth, len(self.old) - 1), in_old))
        nth = pc.cumulative_sum(in_new.is_null().cast(pa.int32()))
        at = pc.if_else(in_new.is_null(), pc.add(nth, len(self.new) - 1), in_new)
        known = pa.concat_arrays([self.new.column("ids"), found]).take(at)
        self.keep(rest, found)
        return known

    def keep(self, names: pa.Array, ids: pa.ListArray) -> None:
        size = pc.add(pc.binary_length(names), pc.multiply(pc.list_value_length(ids).cast(pa.int64()), 4))
        found = pa.RecordBatch.from_arrays([names, ids], names=["name", "ids"]).filter(pc.less_equal(size, ENTRY_BYTES))
        if len(self.new) + len(found) > self.half:
            self.old, self.new = self.new, self.none
        if len(found) <= self.half:
            self.new = pa.concat_batches([self.new, found])


class Memory(Recent):
    """Tokens met before, for one worker process: of runs without blanks and of their pieces."""

    def __init__(self, vocabulary: Vocabulary, most: int = REMEMBERED):
        super().__init__(most, pa.binary())
        self.vocabulary, self.words = vocabulary, Recent(most // 2, pa.string())
        size = range(len(vocabulary.rank))
        self.decimals = pa.array([f"{i} ".encode() for i in size], pa.large_binary())
        self.texts = pa.array([(vocabulary.texts.get(i, "") + " ").encode() for i in size], pa.large_binary())

    def learn(self, texts: pa.ListArray | Iterable[list[bytes]]) -> pa.ListArray:
        """The ids of every run in these texts, in order."""
        runs = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.list_(pa.binary()))).flatten()
        coded = runs.view(pa.binary()).dictionary_encode()
        return self.look_up(coded.dictionary, self._merged).take(coded.indices)

    def _merged(self, runs: pa.Array) -> pa.ListArray:
        pieces = pa.array(self.vocabulary.pieces_of([r.decode() for r in runs.to_pylist()]), pa.string())
        closing = pc.equal(pieces, "\n")
        coded = pieces.filter(pc.invert(closing)).dictionary_encode()
        ids = self.words.look_up(coded.dictionary, lambda p: _listed(self.vocabulary.tokens_of(p.to_pylist()))).take(coded.indices)
        last = np.flatnonzero(closing.to_numpy(zero_copy_only=False)) - np.arange(len(runs))
        ends = ids.offsets.to_numpy()[np.concatenate([[0], last])]
        return pa.ListArray.from_arrays(pa.array(ends), ids.values)


_memories: dict[tuple, Memory] = {}


def _memory(name: tuple, shared: Broadcast) -> Memory:
    """This worker process's memory; it lasts from task to task. A later query's tables are not
    read beside those it has."""
    if name not in _memories:
        _memories.clear()
        _memories[name] = Memory(shared.value)
    return _memories[name]


def _in_runs(batch: pa.RecordBatch, memory: Memory) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The ids of a batch's texts, a run of texts at a time, with the run's first row. A long
    text is a run of its own."""
    bodies = batch.column("body").cast(pa.binary()).fill_null(b"")
    ends = np.cumsum(pc.binary_length(bodies).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(bodies):
        most = (ends[first - 1] if first else 0) + RUN_BYTES
        after = max(first + 1, int(np.searchsorted(ends, most, side="right")))
        texts = pc.ascii_split_whitespace(bodies.slice(first, after - first).view(pa.string()))
        ids = memory.learn(texts)
        at = ids.offsets.to_numpy()[texts.offsets.to_numpy()]
        flat = ids.values.to_numpy()
        yield first, [flat[a:b] for a, b in zip(at, at[1:])]
        first = after


def _hashes(found: Sequence[np.ndarray], shown: pa.Array) -> pa.Array:
    """SHA-256 of every text's shown tokens without the last one's blank; of few tokens at once,
    however long a text is."""
    flat, ends = np.concatenate(found), np.cumsum([0, *map(len, found)])
    made = [hashlib.sha256() for _ in found]
    for first in range(0, len(flat), SHOWN):
        strings = shown.take(pa.array(flat[first : first + SHOWN]))
        data, at = memoryview(strings.buffers()[2]), np.frombuffer(strings.buffers()[1], np.int64)
        after = min(first + SHOWN, len(flat))
        for k in range(np.searchsorted(ends, first, side="right") - 1, np.searchsorted(ends, after)):
            a, b = max(ends[k], first), min(ends[k + 1], after)
            if a < b:
                made[k].update(data[at[a - first] : at[b - first] - (b == ends[k + 1])])
    return pa.array([m.hexdigest() for m in made], pa.string())


def encode(docs: DataFrame, path: str, keep: Sequence[str], outputs: Sequence[str] = ("ids",), text: str = "text") -> DataFrame:
    """``keep`` and the wanted ones of ``ids``, ``n_tokens``, ``ids_sha256`` (of the decimal ids
    joined by a blank) and ``decoded_sha256`` (of ``decode``'s text) per row; no shuffle.

    Whole texts count, NULL as the empty one, which has no tokens. Special tokens' strings in a
    text become these tokens. Every row is on its own: ties and repeated rows get equal tokens.
    ``path`` is read on the driver; its tables are broadcast, a few MB whatever the corpus.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.read(path))
    inputs = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("binary").alias("body"))
    schema = inputs.select("row", *[F.lit(None).cast(OUTPUTS[o]).alias(o) for o in outputs]).schema
    mine = (spark.sparkContext.applicationId, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(mine, shared)
        for batch in batches:
            for first, found in _in_runs(batch, memory):
                made = {"row": batch.column("row").slice(first, len(found))}
                if "ids" in outputs:
                    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                    made["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                if "n_tokens" in outputs:
                    made["n_tokens"] = pa.array([len(f) for f in found], pa.int64())
                for name, shown in (("ids_sha256", memory.decimals), ("decoded_sha256", memory.texts)):
                    if name in outputs:
                        made[name] = _hashes(found, shown)
                yield pa.RecordBatch.from_arrays([made["row"], *[made[o] for o in outputs]], names=["row", *outputs])
                pa.default_memory_pool().release_unused()  # else a worker holds it until it ends

    return inputs.mapInArrow(run, schema).select("row.*", *outputs)


def decode(rows: DataFrame, path: str, keep: Sequence[str], ids: str = "ids") -> DataFrame:
    """``keep`` and ``decoded``: token texts joined by a blank (NULL or no ids: empty text)."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.read(path).texts)
    inputs = rows.select(F.struct(*keep).alias("row"), F.col(ids).alias("ids"))
    schema = inputs.select("row", F.lit("").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = shared.value
        for batch in batches:
            joined = [" ".join([texts[i] for i in row or ()]) for row in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(joined, pa.string())], names=["row", "decoded"])

    return inputs.mapInArrow(run, schema).select("row.*", "decoded")
