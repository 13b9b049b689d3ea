"""Column expressions for messy text: unquoting, lenient numbers, look-alike text."""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# What tasks run travels with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEPARATOR = ","
SENTINEL = "No Data"
QUOTES = "['\"]"
# Every finite number that Spark's cast to double accepts, and little else. "nan" and "inf" are
# words first: a name among them must not turn a text column into numbers.
NUMBER = (
    r"(?i)^[\s\p{Cntrl}]*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?[df]?|0x\S+)[\s\p{Cntrl}]*$"
)
CHUNK = 16
#: Bytes of text whose characters are replaced at once; more than two chunks.
WINDOW = 1 << 19

# The 32 characters of readable labels; the first 24 are letters.
ALPHABET = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"
LETTERS = 24


def unquote(text: Column) -> Column:
    """Blank every quote and turn commas inside a quoted stretch into underscores.

    Both quote characters toggle the same state, so every second piece between quotes is
    a quoted one. Lines without any quote, nearly all of them in practice, skip the split.
    """
    pieces = F.split(text, QUOTES)
    cleaned = F.transform(
        pieces,
        lambda piece, i: F.when(i % 2 == 1, F.translate(piece, SEPARATOR, "_")).otherwise(piece),
    )
    quoted = text.contains("'") | text.contains('"')
    return F.when(quoted, F.array_join(cleaned, " ")).otherwise(text)


def fields(text: Column) -> Column:
    """Split a line at commas, keeping trailing blanks."""
    return F.split(text, SEPARATOR)


def field_count(text: Column) -> Column:
    """Fields in a line: its commas and one, counted without building the fields."""
    without = F.replace(text, F.lit(SEPARATOR))
    return (F.octet_length(text) - F.octet_length(without) + 1).cast("int")


def parsed_double(value: Column) -> Column:
    """The number in a text, or NULL where there is none (never an ANSI cast error).

    A failing cast throws and catches an exception inside Spark, some ten times slower
    than the pattern that keeps ordinary words and dates away from it.
    """
    return F.when(value.rlike(NUMBER), value.try_cast("double"))


def lenient_double(value: Column) -> Column:
    """The number in a text, or 0.0 where there is none."""
    return F.coalesce(parsed_double(value), F.lit(0.0))


def digest_text(text: Column) -> Column:
    """The 16 bytes of the MD5 digest as a 16-character Latin-1 string.

    ``ascii(substring(..., i, 1))`` then reads one byte without parsing hex digits.
    """
    return F.decode(F.unhex(F.md5(text)), "ISO-8859-1")


def digest_byte(digest: Column, position: int) -> Column:
    """Byte ``position`` (from 0) of a :func:`digest_text` value, as 0..255."""
    return F.ascii(F.substring(digest, position + 1, 1))


def _substituted(text: pa.Array, salt: bytes) -> pa.Array:
    """Look-alikes of a batch of texts, on its UTF-8 bytes: only letters and digits of ASCII change,
    so bytes and offsets stay. Bytes are taken a window at a time, which bounds the working arrays
    however large a batch or a text is."""
    text = text.cast(pa.large_string()) if text.offset == 0 else pa.concat_arrays([text.cast(pa.large_string())])
    valid, offsets, data = text.buffers()
    count = len(text)
    if data is None or not count:
        return text.cast(pa.string())
    ends = np.frombuffer(offsets, np.int64)[: count + 1]
    raw = np.frombuffer(data, np.uint8)[: ends[-1]]
    made, view, at = raw.copy(), memoryview(data), 0
    while at < len(raw):
        # A window begins with a chunk of whichever text; the others begin inside.
        end = min(at + WINDOW, len(raw))
        inside = slice(*np.searchsorted(ends, [at + 1, end]))
        at += _replaced(raw[at:end], ends[inside] - at, view[at:end], salt, made[at:], end == len(raw))
    return pa.Array.from_buffers(pa.large_string(), count, [valid, offsets, pa.py_buffer(made)]).cast(pa.string())


def _replaced(raw: np.ndarray, texts: np.ndarray, view: memoryview, salt: bytes, made: np.ndarray, last: bool) -> int:
    """Look-alikes of a window's whole chunks into ``made``; how many bytes these are. ``texts``
    begin in the window; its last chunk may go on, unless it is the ``last`` window."""
    first = (raw & 0xC0) != 0x80
    # A character's number in its text, or since the window's begin, and whether it begins a chunk.
    place = np.cumsum(first, dtype=np.int32) - 1
    cuts = np.unique(np.concatenate([[0], texts]))
    place -= np.repeat(place[cuts], np.diff(cuts, append=len(raw)))
    place %= CHUNK
    begins = first & (place == 0)
    starts = np.flatnonzero(begins)
    size = len(raw) if last else int(starts[-1])
    edges, digest = [*starts[starts < size].tolist(), size], hashlib.md5
    digests = b"".join([digest(salt + view[a:b]).digest() for a, b in zip(edges, edges[1:])])  # noqa: B905
    place += (np.cumsum(begins, dtype=np.int32) - 1) * 16
    drawn = np.frombuffer(digests, np.uint8)[place[:size]] ^ 128  # shifted by 128
    for low, high in ((b"a", b"z"), (b"A", b"Z"), (b"0", b"9")):
        at = np.flatnonzero((raw[:size] >= low[0]) & (raw[:size] <= high[0]))
        made[at] = low[0] + drawn[at] % (high[0] - low[0] + 1)
    return size


def look_alike(text: Column, salt: str = "") -> Column:
    """Replace letters and digits by others drawn from the text's own MD5 digests.

    Every 16-character chunk is digested once. Character i takes byte i of that digest,
    shifted by 128: A-Z and a-z move within their alphabet, 0-9 within the digits, all
    else stays. Equal inputs give equal outputs on every executor. A secret ``salt`` goes
    before every chunk that is digested, so that guessed inputs cannot be confirmed without it.
    The characters of a window of bytes are replaced at once, in Arrow's own buffers.
    """
    head = salt.encode()

    @F.arrow_udf("string")
    def substituted(batch: pa.Array) -> pa.Array:
        return _substituted(batch, head)

    return substituted(text)


def readable_label(digest: Column, length: Column, longest: int) -> Column:
    """A label of ``length`` characters, the low five bits of each byte picking one.

    The first character is always a letter, so that no label can read as a number.
    """
    picks = []
    for position in range(longest):
        index = digest_byte(digest, position).bitwiseAND(31)
        if position == 0:
            index = F.when(index >= LETTERS, index - LETTERS).otherwise(index)
        picks.append(F.substring(F.lit(ALPHABET), index + 1, F.lit(1)))
    return F.substring(F.concat(*picks), F.lit(1), length)
