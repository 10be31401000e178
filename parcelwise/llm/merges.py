"""Pair merges of byte-pair vocabularies: the tables, and merging in ragged numpy arrays."""

from __future__ import annotations

import base64
import heapq
import json
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from parcelwise.llm import ragged
from parcelwise.llm.ragged import offsets_of

NEVER = np.int64(1) << 40


class PairTable:
    """(left id, right id) -> (rank, merged id), with constant-time lookup of whole arrays.

    The rows of the sparse matrix left x right are laid over one another without
    a clash: slot = base[left] + right, and the slot names the left id it
    belongs to.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, n_ids: int):
        order = np.lexsort((right, left))
        left, right, rank, merged = left[order], right[order], rank[order], merged[order]
        names, first, count = np.unique(left, return_index=True, return_counts=True)
        size = n_ids + 3 * len(left) + 1024
        taken = np.zeros(size + n_ids, bool)
        self.base = np.zeros(n_ids, np.int64)
        slots = np.empty(len(left), np.int64)
        draw = np.random.default_rng(0)
        for row in np.argsort(-count, kind="stable")[: int((count > 1).sum())]:
            cells = right[first[row] : first[row] + count[row]]
            while True:
                shift = draw.integers(0, size, 64)
                good = ~taken[shift[:, None] + cells].any(axis=1)
                if good.any():
                    break
            shift = int(shift[np.argmax(good)])
            taken[shift + cells] = True
            self.base[names[row]] = shift
            slots[first[row] : first[row] + count[row]] = shift + cells
        single = count == 1
        free = np.flatnonzero(~taken[n_ids:])[: int(single.sum())] + n_ids
        self.base[names[single]] = free - right[first[single]]
        slots[first[single]] = free
        length = int(slots.max(initial=0)) + n_ids + 1
        self.owner = np.full(length, -1, np.int32)
        self.rank = np.full(length, NEVER, np.int64)
        self.merged = np.full(length, -1, np.int32)
        self.owner[slots], self.rank[slots], self.merged[slots] = left, rank, merged

    def slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.base[left] + right

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        slot = self.slot(left, right)
        return np.where(self.owner[slot] == left, self.rank[slot], NEVER)


def merge_long(symbols: np.ndarray, table: PairTable) -> np.ndarray:
    """One long sequence by a heap of pairs over a linked list."""
    sym = symbols.tolist()
    n = len(sym)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    ranks = table.ranks(symbols[:-1], symbols[1:])
    heap = [(int(ranks[i]), int(i), sym[i], sym[i + 1]) for i in np.flatnonzero(ranks < NEVER)]
    heapq.heapify(heap)

    def push(i: int, j: int) -> None:
        slot = table.base[sym[i]] + sym[j]
        if table.owner[slot] == sym[i]:
            heapq.heappush(heap, (int(table.rank[slot]), i, sym[i], sym[j]))

    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if sym[i] != a or j < 0 or sym[j] != b:
            continue
        sym[i] = int(table.merged[table.base[a] + b])
        sym[j] = -1
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
            push(i, after[i])
        if before[i] >= 0:
            push(before[i], i)
    return np.array([x for x in sym if x >= 0], np.int32)


def merge_ragged(symbols: np.ndarray, lengths: np.ndarray, table: PairTable, long: int = 96) -> tuple[np.ndarray, np.ndarray]:
    """Rank-synchronous merging of many sequences: in each round every sequence merges its
    leftmost pair of lowest rank, all at once, until none has a pair left.

    Sequences of over `long` symbols would need as many rounds; they are merged by
    a heap instead, with the same result.  Returns (symbols, lengths).
    """
    out_lengths = lengths.astype(np.int64).copy()
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    begin = offsets_of(lengths)
    for word in np.flatnonzero(lengths > long):
        part = merge_long(symbols[begin[word] : begin[word + 1]], table)
        out_lengths[word] = len(part)
        done.append((np.array([word]), part, np.array([len(part)])))
    words = np.flatnonzero((lengths <= long) & (lengths > 0))
    short = np.repeat((lengths <= long), lengths)
    sym, size = symbols[short].astype(np.int64), lengths[words].astype(np.int64)
    rank = None
    while len(words):
        last = np.cumsum(size) - 1
        head = last - size + 1
        if rank is None:
            rank = np.full(len(sym), NEVER, np.int64)
            if len(sym) > 1:
                rank[:-1] = table.ranks(sym[:-1], sym[1:])
            rank[last] = NEVER
        best = np.minimum.reduceat(rank, head)
        over = best == NEVER
        if over.any():
            keep = np.repeat(~over, size)
            done.append((words[over], sym[~keep].astype(np.int32), size[over]))
            out_lengths[words[over]] = size[over]
            sym, rank, words, size, best = sym[keep], rank[keep], words[~over], size[~over], best[~over]
            if not len(words):
                break
            last = np.cumsum(size) - 1
            head = last - size + 1
        hit = np.flatnonzero(rank == np.repeat(best, size))
        owner = np.searchsorted(last, hit)
        at = hit[np.concatenate([[True], owner[1:] != owner[:-1]])]
        sym[at] = table.merged[table.slot(sym[at], sym[at + 1])]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        at = at - np.arange(len(at))
        sym, rank = sym[keep], rank[keep]
        size -= 1
        last = np.cumsum(size) - 1
        rank[at] = NEVER
        inner = at[at != last]
        rank[inner] = table.ranks(sym[inner], sym[inner + 1])
        outer = at[at != last - size + 1] - 1
        rank[outer] = table.ranks(sym[outer], sym[outer + 1])
    # back to the order of the input
    at = offsets_of(out_lengths)
    out = np.empty(int(at[-1]), np.int32)
    for which, part, count in done:
        before = np.cumsum(count) - count
        out[np.repeat(at[which] - before, count) + np.arange(len(part))] = part
    return out, out_lengths


@cache
def rank_file(path: str) -> tuple[list[bytes], PairTable, np.ndarray]:
    """A rank file: (the pieces by id, all pairs whose joined bytes are a piece, the id of each byte)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    pairs = np.array([(ranks[p[:k]], ranks[p[k:]], i) for p, i in ranks.items() for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks], np.int64)
    table = PairTable(pairs[:, 0], pairs[:, 1], pairs[:, 2], pairs[:, 2].astype(np.int32), len(pieces))
    return pieces, table, np.array([ranks[bytes([b])] for b in range(256)], np.int32)


@cache
def byte_names() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(extra)) for b in range(256)]


@cache
def merge_file(path: str) -> tuple[PairTable, np.ndarray, np.ndarray, dict[str, int]]:
    """A tokenizer file with a list of merges: (pairs, ids of bytes, ids of bytes that end a word, special strings)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    rows = {}
    for rank, merge in enumerate(model["merges"]):
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        rows[vocab[a], vocab[b]] = (rank, vocab[a + b])
    left, right = np.array(list(rows), np.int64).T
    rank, merged = np.array(list(rows.values()), np.int64).T
    table = PairTable(left, right, rank, merged.astype(np.int32), max(vocab.values()) + 1)
    inner = np.array([vocab[x] for x in byte_names()], np.int32)
    final = np.array([vocab[x + suffix] for x in byte_names()], np.int32)
    return table, inner, final, {t["content"]: t["id"] for t in spec["added_tokens"]}


def byte_level_ids(column: pa.Array, table: PairTable, byte_ids: np.ndarray, specials: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a string column and the row offsets into them; a special string in a text becomes its own id."""
    found = [s for s in specials if pc.any(pc.match_substring(column, s)).as_py()]
    if found:
        cut = re.compile("(" + "|".join(map(re.escape, found)) + ")")
        parts = [cut.split(t or "") for t in column.to_pylist()]
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        flat = [x for p in parts for x in p]
        mark = np.array([specials.get(x, -1) for x in flat])
        ids, at = byte_level_ids(pa.array(["" if m >= 0 else x for x, m in zip(flat, mark, strict=True)], pa.string()), table, byte_ids, {})
        ids = np.insert(ids, at[:-1][mark >= 0], mark[mark >= 0])
        lengths = np.diff(at) + (mark >= 0)
        return ids, offsets_of(np.bincount(row, weights=lengths, minlength=len(parts)).astype(np.int64))
    data, offsets = ragged.utf8(column)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(column) + 1, np.int64)
    text = ragged.Codes(data, offsets)
    starts = text.byte(np.flatnonzero(ragged.byte_level_starts(text)))
    lengths = np.diff(np.append(starts, len(data)))
    sample, which = ragged.distinct(data, starts, lengths)
    symbols, sizes = merge_ragged(byte_ids[ragged.take(data, starts[sample], lengths[sample])], lengths[sample], table)
    ids = ragged.take(symbols, offsets_of(sizes)[which], sizes[which])
    ends = offsets_of(sizes[which])
    return ids, ends[np.searchsorted(starts, offsets)]
