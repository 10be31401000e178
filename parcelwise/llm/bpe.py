"""Byte-level BPE: encoding and decoding whole text columns.

Each task cuts its texts into the pattern's matches and brings equal matches of
a block together (`ragged`).  The distinct words' byte arrays are then folded by
ranked merges with a constant rank map, and the ids flow back to the texts of
the block, in the same task: the whole job is narrow, without a shuffle.

The fold has two forms with the same ids.  `fold=True` is one of Spark's
higher-order functions; it takes some 60 microseconds a word, which is more than
the budget of the registered query allows (figures in the README), so that by
default all words of a block are merged at once by `merges.merge_ragged`.

The rank map lists, for every pair of ids whose joined bytes are a piece of the
vocabulary, that piece's id, which is also its rank.  The pairs lie in one array
in which the row of each left id is shifted so that no two clash:
`owner[base[left] + right] = left` if the pair exists, `merged` at the same
place has the id.  The three arrays are constants of the vocabulary; they stand
beside each block's words as columns, because the same arrays as literals inside
the lambda took 30 times as long for each access (3 against 0.1 microseconds).

Defined results: a null or empty text has no ids (and the hashes of no bytes);
repeated rows give repeated results; rows of one id are not brought together;
other columns of the input play no part, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import ragged
from parcelwise.llm.merges import byte_level_ids, rank_file

#: Text that is brought together at once; a block's distinct words are one row of Spark.
BLOCK_BYTES = 8 << 20
#: No pair: above every id.
NONE = 1 << 20

_BLOCK = "words array<array<int>>, rows array<struct<doc_id: bigint, word: binary>>, base array<int>, owner array<int>, merged array<int>"
_ENCODED = "doc_id bigint, ids binary"


def _split(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Blocks of texts as the byte arrays of their distinct words and, for each text, the places of
    its words among them, beside the rank map at `path`."""
    _, table, byte_ids = rank_file(path)
    ranks = [table.base, table.owner, np.where(table.owner >= 0, table.merged, NONE)]
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    ranks = [one(pa.array(x.astype(np.int32))) for x in ranks]
    for batch in ragged.blocks(batches, "text", limit):
        data, offsets = ragged.utf8(batch.column("text"))
        starts = np.zeros(0, np.int64)
        if len(data):
            text = ragged.Codes(data, offsets)
            starts = text.byte(np.flatnonzero(ragged.byte_level_starts(text)))
        lengths = np.diff(np.append(starts, len(data)))
        sample, which = ragged.distinct(data, starts, lengths)
        letters = byte_ids[ragged.take(data, starts[sample], lengths[sample])]
        words = pa.ListArray.from_arrays(pa.array(ragged.offsets_of(lengths[sample]).astype(np.int32)), pa.array(letters))
        bounds = np.searchsorted(starts, offsets) * 4
        place = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(which.astype("<i4"))]).cast(pa.binary())
        rows = pa.StructArray.from_arrays([batch.column("doc_id"), place], names=["doc_id", "word"])
        yield pa.RecordBatch.from_arrays([one(words), one(rows), *ranks], names=["words", "rows", "base", "owner", "merged"])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of each text, as little-endian unsigned 32-bit integers."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids = batch.column("ids").slice(k, 1).flatten()
            counts = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            begin = ragged.offsets_of(counts)
            rows = batch.column("rows").slice(k, 1).flatten()
            place, bounds = ragged.utf8(rows.field("word"))
            which = place.view("<i4") if len(place) else np.zeros(0, np.int32)
            out = ragged.take(flat, begin[which], counts[which])
            ends = ragged.offsets_of(counts[which])[bounds // 4] * 4
            column = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(out)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([rows.field("doc_id"), column], names=["doc_id", "ids"])


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fold(word: Column) -> Column:
    """The ids of one word (the ids of its bytes), folded by merging the leftmost pair of lowest rank.

    The state has one number for each piece: the rank of the pair that it begins
    with the next piece, where the piece starts, and its id, from the high bits
    down.  So the smallest number names the pair to merge, and a merge renews
    the ranks at its two sides only.  A word of n bytes takes at most n - 1
    steps; those after its last merge leave the state as it is.
    """

    def rank(left: Column, right: Column) -> Column:
        slot = F.get("base", left) + right
        return F.when(F.get("owner", slot) == left, F.get("merged", slot)).otherwise(F.lit(NONE))

    def packed(rank: Column, rest: Column) -> Column:
        return F.shiftleft(rank.cast("bigint"), 40).bitwiseOR(rest)

    rest = lambda x: x.bitwiseAND(F.lit((1 << 40) - 1))
    piece = lambda x: x.bitwiseAND(F.lit(0xFFFF)).cast("int")

    def merge(state: Column, low: Column, at: Column) -> Column:
        """Piece `at` (from 1) and the next become one, whose id is the rank in `low`."""
        merged = F.shiftright(low, 40).cast("int")
        before, after = F.get(state, at - 2), F.get(state, at + 1)
        head = F.when(at > 1, F.concat(F.slice(state, F.lit(1), at - 2), F.array(packed(rank(piece(before), merged), rest(before))))).otherwise(F.array().cast("array<bigint>"))
        own = packed(F.when(after.isNull(), F.lit(NONE)).otherwise(rank(merged, piece(after))), rest(low).bitwiseAND(F.lit(~0xFFFF)).bitwiseOR(merged.cast("bigint")))
        return F.concat(head, F.array(own), F.slice(state, at + 2, F.size(state)))

    def step(state: Column, _: Column) -> Column:
        return _bind(F.array_min(state), lambda low: F.when(low >= NONE << 40, state).otherwise(_bind(F.array_position(state, low).cast("int"), lambda at: merge(state, low, at))))

    size = F.size(word)
    start = F.transform(word, lambda x, i: packed(F.when(i + 1 < size, rank(x, F.get(word, i + 1))).otherwise(F.lit(NONE)), F.shiftleft(i.cast("bigint"), 16).bitwiseOR(x.cast("bigint"))))
    return F.when(size > 1, F.aggregate(F.sequence(F.lit(2), size), start, step, lambda s: F.transform(s, piece))).otherwise(word)


def encode(docs: DataFrame, path: str, fold: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`doc_id`, `text` -> `doc_id`, `ids` (binary: little-endian unsigned 32-bit ids), by the rank file at `path`.

    `fold` merges by Spark's higher-order functions instead of numpy; the ids are the same.
    """
    columns = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    if not fold:
        return columns.mapInArrow(partial(_encode, path=path), _ENCODED)
    split = columns.mapInArrow(partial(_split, path=path, limit=block_bytes), _BLOCK)
    return split.select("rows", F.transform("words", _fold).alias("ids")).mapInArrow(_join, _ENCODED)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    _, table, byte_ids = rank_file(path)
    for batch in ragged.blocks(batches, "text"):
        ids, at = byte_level_ids(batch.column("text"), table, byte_ids, {})
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ragged.binaries(ids.astype("<u4"), at * 4)], names=["doc_id", "ids"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds `decoded` (binary), the joined pieces of the ids, and keeps the columns of `encode`."""
    return encoded.mapInArrow(partial(_decoded, path=path, more=lambda ids, raw: {"decoded": raw}, kinds={"decoded": pa.binary()}), _ENCODED + ", decoded binary")


def _decoded(batches: Iterator[pa.RecordBatch], path: str, more: Callable[[bytes, bytes], dict], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    pieces = rank_file(path)[0]
    sizes = np.array([len(p) for p in pieces])
    begin, joined = ragged.offsets_of(sizes), np.frombuffer(b"".join(pieces), np.uint8)
    for batch in ragged.blocks(batches, "ids", 4 << 20):
        out: dict[str, list] = {k: [] for k in kinds}
        for raw in batch.column("ids"):
            raw = raw.as_py() or b""
            ids = np.frombuffer(raw, "<u4")
            for k, v in more(raw, ragged.take(joined, begin[ids], sizes[ids]).tobytes()).items():
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, kinds[k]) for k, v in out.items())], names=[*batch.schema.names, *out])


def _digests(ids: bytes, raw: bytes) -> dict:
    return {"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(raw).hexdigest()}


def _digested(batches: Iterator[pa.RecordBatch], path: str, encoded: bool) -> Iterator[pa.RecordBatch]:
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    for batch in _decoded(batches if encoded else _encode(batches, path), path, _digests, kinds):
        yield batch.select(["doc_id", *kinds])


def digest(docs: DataFrame, path: str, fold: bool = False) -> DataFrame:
    """Encodes and decodes `doc_id`, `text`: doc_id, n_tokens, and the SHA-256 of the ids and of the bytes decoded from them.

    The ids are hashed where they are made, so that a task needs one Python worker.
    """
    rows = encode(docs, path, fold=True) if fold else docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(partial(_digested, path=path, encoded=fold), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
