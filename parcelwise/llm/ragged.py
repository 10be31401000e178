"""Ragged text columns as numpy arrays: the common ground of the text operators.

A block of texts is one UTF-8 byte array with row offsets.  Words, tokens and
lines are ranges of that array, found by whole-array operations, so that no
Python object is made for a word before equal words have been brought together.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once inside a task.
BLOCK_BYTES = 3 << 20

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: The code points of Unicode's White_Space property (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def char_classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


@cache
def ascii_space_classes() -> np.ndarray:
    """SPACE for the six ASCII white-space characters, LETTER for all others."""
    table = np.full(0x110000, LETTER, np.uint8)
    table[[*range(0x09, 0x0E), 0x20]] = SPACE
    return table


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string or binary column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts or leaves batches so that each holds about `limit` bytes of text, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def take(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The given ranges of an array, one behind the other."""
    before = np.cumsum(lengths) - lengths
    return data[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


class Codes:
    """The code points of a block of texts, with the way back to bytes and rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.plain = not (data & 0x80).any()
        if self.plain:
            self.codes, self.at, self.rows = data.astype(np.uint32), None, offsets
        else:
            self.codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            lead = (data & 0xC0) != 0x80
            self.at = np.flatnonzero(lead)
            counts = np.zeros(len(data) + 1, np.int64)
            np.cumsum(lead, out=counts[1:])
            self.rows = counts[offsets]
        if self.at is not None and len(self.at) != len(self.codes):
            raise ValueError("a text is not valid UTF-8")
        self.first = np.zeros(len(self.codes) + 1, bool)
        self.first[self.rows[:-1]] = True
        self.first = self.first[:-1]

    def byte(self, index: np.ndarray) -> np.ndarray:
        """Byte positions of code indexes; the number of codes stands for the end."""
        if self.at is None:
            return index
        return np.append(self.at, len(self.data))[index]


def byte_level_starts(text: Codes) -> np.ndarray:
    """Where the byte-level pattern ('s|'t|…| ?\\p{L}+| ?\\p{N}+|…|\\s+(?!\\S)|\\s+) starts a match."""
    codes, first = text.codes, text.first
    kind = char_classes()[codes]
    n = len(codes)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= first
    space = kind == SPACE
    # the last white space before a word: alone, or as its head if it is a plain space
    word = np.flatnonzero(start & ~space & ~first)
    word = word[space[word - 1]]
    start[word - 1] = True
    start[word[codes[word - 1] == 0x20]] = False
    contractions(codes, first, start)
    return start


def contractions(codes: np.ndarray, first: np.ndarray, start: np.ndarray) -> None:
    """Joins 's 't 'm 'd 're 've 'll to one match, in place, where a match starts at the apostrophe."""
    n = len(codes)
    mark = np.flatnonzero((codes == 0x27) & start)
    mark = mark[mark + 1 < n]
    mark = mark[~first[mark + 1]]
    one = mark[np.isin(codes[mark + 1], [ord(x) for x in "stmd"])]
    start[one + 1] = False
    start[(one + 2)[one + 2 < n]] = True
    two = mark[mark + 2 < n]
    two = two[~first[two + 2]]
    pair = codes[two + 1].astype(np.int64) << 32 | codes[two + 2]
    two = two[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]
    start[two + 1] = False
    start[two + 2] = False
    start[(two + 3)[two + 3 < n]] = True


def runs(text: Codes, kind: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Code ranges (start, end) of the runs of one class, cut at rows."""
    inside = kind == keep
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    next_first = np.concatenate([text.first[1:], [True]])
    return np.flatnonzero(inside & (~before | text.first)), np.flatnonzero(inside & (~after | next_first)) + 1


@cache
def _powers(n: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=np.uint64)
    return mix(x * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_ranges(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty byte range."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    bound = int(lengths.max())
    size = 64
    while size < bound:
        size *= 2
    before = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
    values = (data[np.repeat(starts, lengths) + place].astype(np.uint64) + np.uint64(1)) * _powers(size)[place]
    return mix(np.add.reduceat(values, before) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def distinct(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal ranges brought together: (an index of a range for each distinct one, the distinct one of each range).

    Ranges meet by a 64-bit hash and are then compared byte by byte; should two
    different ones ever share a hash, a dictionary of the bytes decides instead.
    """
    hashes = hash_ranges(data, starts, lengths)
    _, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
    same = lengths[sample][which] == lengths
    if same.all():
        same = take(data, starts[sample][which], lengths) == take(data, starts, lengths)
    if not same.all():
        seen: dict[bytes, int] = {}
        raw = data.tobytes()
        which = np.fromiter((seen.setdefault(raw[s : s + n], len(seen)) for s, n in zip(starts, lengths, strict=True)), np.int64, len(starts))
        _, sample = np.unique(which, return_index=True)
    return sample, which


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row in which each position lies."""
    return np.searchsorted(offsets, starts, "right") - 1


def binaries(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column from its joined bytes and the row offsets."""
    raw = np.ascontiguousarray(raw).view(np.uint8) if len(raw) else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
