"""Best-fit packing of token pieces into sequences, by exact complements.

Only the number of pieces of each length matters to the packing, so the plan is
made from that histogram (at most `size` rows, whatever the corpus): for each
length from the longest down, a single length, or a pair or triple found by its
sum in an index, fills the gap exactly, as often as pieces of them are left.
What stays over is packed by best fit.  The plan is a few thousand patterns with
counts; each piece then finds its place by its rank among the pieces of its
length, which is counted in groups of some hundred pieces that have nothing in
common, so no length and no row, however common, meets in one task.  A piece of
full length is a sequence by itself.

Defined results: a null or empty text is one piece that holds the end id alone;
repeated rows are each packed; other columns play no part; an empty table gives
no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelwise.llm import ragged
from parcelwise.llm.merges import byte_level_ids, merge_file
from parcelwise.session import stored

#: Pieces of one length whose ranks are counted in one group.
GROUP_ROWS = 500

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than `size` if there are more."""
    first = (length - 1) % size + 1
    return [(0, first), *((at, size) for at in range(first, length, size))]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, end_id: int) -> Iterator[pa.RecordBatch]:
    table, byte_ids, _, specials = merge_file(path)
    for batch in ragged.blocks(batches, "text"):
        ids, at = byte_level_ids(batch.column("text"), table, byte_ids, specials)
        at, docs = at + np.arange(len(at)), batch.column("doc_id").to_pylist()
        ids = np.insert(ids, at[1:] - np.arange(1, len(at)), end_id).astype("<u4")
        raw = memoryview(ids.tobytes())
        rows = [(doc, k, start, n, zlib.crc32(raw[4 * (at[i] + start) : 4 * (at[i] + start + n)])) for i, doc in enumerate(docs) for k, (start, n) in enumerate(cut(int(at[i + 1] - at[i]), size))]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, path: str, size: int, end_id: int = 0) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32."""
    columns = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    return columns.mapInArrow(partial(_pieces, path=path, size=size, end_id=end_id), _PIECES)


class Bins:
    """Sequences in the making: how many there are of each pattern of lengths, by the gap that is left."""

    def __init__(self) -> None:
        self.open: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
        self.full: list[tuple[tuple[int, ...], int]] = []

    def put(self, pattern: tuple[int, ...], count: int, gap: int) -> None:
        (self.open[gap] if gap else self.full).append((pattern, count))

    def take(self, gap: int, most: int) -> tuple[tuple[int, ...], int]:
        pattern, count = self.open[gap].pop()
        if count > most:
            self.open[gap].append((pattern, count - most))
        elif not self.open[gap]:
            del self.open[gap]
        return pattern, min(count, most)


class Sums:
    """An index of the sums of two lengths that occur, and what is left of each length.

    A gap is filled by one length, by a pair found under its sum, or by a triple:
    a length and the pair found under the rest.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.left = np.zeros(size + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        lengths = np.flatnonzero(self.left)
        # sum -> the longer lengths of its pairs, ascending, as the longest is tried first; and how many of them have not run out
        self.pairs = {int(t): a[self.left[t - a] > 0].astype(np.int32) for t in range(2, size) if len(a := lengths[(2 * lengths >= t) & (lengths < t)])}
        self.end = {t: len(a) for t, a in self.pairs.items()}

    def enough(self, pattern: tuple[int, ...]) -> bool:
        return all(self.left[x] >= pattern.count(x) for x in pattern)

    def pair(self, total: int, first: int = 0) -> tuple[int, int] | None:
        """A pair of that sum, beside one of length `first`; pairs that have run out leave the index."""
        if total not in self.pairs:
            return None
        longer, end = self.pairs[total], self.end[total]
        of = lambda k: (int(longer[k]), total - int(longer[k]))
        while end and not self.enough(of(end - 1)):
            end -= 1
        self.end[total] = end
        return next((of(k) for k in range(end - 1, -1, -1) if self.enough((first, *of(k)) if first else of(k))), None)

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths still available that fill `gap` exactly."""
        if self.left[gap]:
            return (gap,)
        if pair := self.pair(gap):
            return pair
        for a in np.flatnonzero(self.left[:gap])[::-1]:
            if pair := self.pair(gap - int(a), int(a)):
                return (int(a), *pair)
        return None


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each; together they use `counts` up."""
    bins = Bins()
    if full := counts.get(size, 0):
        bins.put((size,), full, 0)
    sums = Sums({length: n for length, n in counts.items() if length < size}, size)
    left = sums.left
    rest: dict[int, int] = {}
    for length in range(size - 1, 0, -1):
        while left[length]:
            left[length] -= 1
            others = sums.fill(size - length)
            left[length] += 1
            if others is None:
                rest[length] = int(left[length])
                left[length] = 0
                break
            pattern = (length, *others)
            times = min(int(left[x]) // pattern.count(x) for x in pattern)
            for x in pattern:
                left[x] -= times
            bins.put(pattern, times, 0)
    for length, n in sorted(rest.items(), reverse=True):
        while n:
            gap = min((g for g in bins.open if g >= length), default=None)
            if gap is not None:
                pattern, times = bins.take(gap, n)
                bins.put((*pattern, length), times, gap - length)
                n -= times
                continue
            each = size // length
            if n >= each:
                bins.put((length,) * each, n // each, size - each * length)
            if n % each:
                bins.put((length,) * (n % each), 1, size - n % each * length)
            n = 0
    return bins.full + [x for rows in bins.open.values() for x in rows]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, by rank among its pieces: (first ranks, the sequence of each first rank, the offset)."""
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, count in patterns:
        at = 0
        for length in pattern:
            rows[length].append((used[length], sequence, at))
            used[length] += count
            at += length
        sequence += count
    return {length: tuple(np.array(x, np.int64) for x in zip(*found, strict=True)) for length, found in rows.items()}


def _place(frames: Iterator[pd.DataFrame], where: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rank, lengths = frame.pop("rank").to_numpy(), frame["length"].to_numpy()
        sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            first, begin, at = where[int(lengths[part[0]])]
            k = np.searchsorted(first, rank[part], "right") - 1
            sequence[part], offset[part] = begin[k] + rank[part] - first[k], at[k]
        yield frame.assign(sequence_id=sequence, offset=offset)


def pack_pieces(found: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (`doc_id, piece, start, length, ids_crc32, row`; `row` is any number of a row's own)."""
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    # a full piece is a sequence by itself: it needs no rank, only a number that no pattern has
    full = found.filter(F.col("length") == size).select(*names, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    part = found.filter(F.col("length") < size)
    # groups of the pieces of a length, each counted alone; the groups before it give its first rank
    groups = F.greatest(F.lit(1), F.ceil(F.count("*") / GROUP_ROWS)).cast("int")
    shares = part.groupBy("length").agg(groups.alias("n_groups"))
    keyed = part.join(F.broadcast(shares), "length").withColumn("group", F.pmod(F.xxhash64("row"), F.col("n_groups")).cast("int")).drop("n_groups")
    sizes = keyed.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("length", "group", before.alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "group").orderBy("row"))
    ranked = keyed.withColumn("inner", inner).join(base, ["length", "group"])
    rows = ranked.select(*names, (F.col("before") + F.col("inner") - 1).alias("rank"))
    where = places(plan({length: n for length, n in counts.items() if length < size}, size))
    return rows.mapInPandas(partial(_place, where=where), _PIECES + ", sequence_id bigint, offset bigint").unionByName(full)


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """`doc_id`, `text` -> one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids, by the tokenizer file at `path` and then `end_id`, are one
    piece, or if there are more than `size`, pieces of `size` of which the first
    may be shorter.
    """
    return pack_pieces(stored(pieces(docs, path, size, end_id).withColumn("row", F.monotonically_increasing_id())), size)
