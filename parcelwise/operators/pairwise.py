"""Pairs of runs of edges that a join has brought together, tested a batch at a time in numpy.

As rows or higher-order functions the same tests take some 10 microseconds for each pair of
edges.  A run has a bounded number of edges, and CHUNK pairs of edges are looked at together,
so that memory does not grow with the batch.  A missing coordinate is NaN here and plays no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa

#: Pairs of edges looked at together.
CHUNK = 1 << 18
SNAP = 1e-6
EPS = 1e-9

Ends = dict[str, np.ndarray]


class Edges:
    """A column of runs: the row of each edge, and its fields."""

    def __init__(self, column: pa.ListArray) -> None:
        at = column.offsets.to_numpy().astype(np.int64)
        values = column.values.slice(at[0], at[-1] - at[0])
        self.at = at - at[0]
        self.row = np.repeat(np.arange(len(column)), np.diff(self.at))
        self.fields = {f.name: values.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(values.type)}

    def ends(self, index: np.ndarray | slice = slice(None)) -> Ends:
        return {c: self.fields[c][index] for c in ("x1", "y1", "x2", "y2")}


def product(a: np.ndarray, b: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place in a, place in b) of all pairs of one row; a and b are the rows of either side's items, rising."""
    n, m = (np.bincount(x, minlength=rows) for x in (a, b))
    begin_a, begin_b = np.cumsum(n) - n, np.cumsum(m) - m
    ends = np.cumsum(n * m)
    first = 0
    while first < rows:
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
        here = np.arange(first, last)
        count = (n * m)[here]
        row = np.repeat(here, count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        if len(row):
            yield row, begin_a[row] + k // m[row], begin_b[row] + k % m[row]
        first = last


def cross(ax, ay, bx, by):
    return ax * by - ay * bx


def distance2(a: Ends, b: Ends) -> np.ndarray:
    """The squared distance of two segments; 0 if they cross."""

    def to(x, y, s):
        dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
        t = np.fmin(np.fmax(((x - s["x1"]) * dx + (y - s["y1"]) * dy) / (dx * dx + dy * dy), 0.0), 1.0)
        return (s["x1"] + t * dx - x) ** 2 + (s["y1"] + t * dy - y) ** 2

    dx, dy, ex, ey = a["x2"] - a["x1"], a["y2"] - a["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"]
    d1, d2 = cross(dx, dy, b["x1"] - a["x1"], b["y1"] - a["y1"]), cross(dx, dy, b["x2"] - a["x1"], b["y2"] - a["y1"])
    d3, d4 = cross(ex, ey, a["x1"] - b["x1"], a["y1"] - b["y1"]), cross(ex, ey, a["x2"] - b["x1"], a["y2"] - b["y1"])
    ends = reduce(np.fmin, (to(a["x1"], a["y1"], b), to(a["x2"], a["y2"], b), to(b["x1"], b["y1"], a), to(b["x2"], b["y2"], a)))
    return np.where((d1 * d2 < 0) & (d3 * d4 < 0), 0.0, ends)


def boxes_meet(a: Ends, b: Ends, by: float) -> np.ndarray:
    met = True
    for c in "xy":
        low, high = (lambda s, c=c: np.fmin(s[f"{c}1"], s[f"{c}2"])), (lambda s, c=c: np.fmax(s[f"{c}1"], s[f"{c}2"]))
        met = met & (low(a) <= high(b) + by) & (low(b) <= high(a) + by)
    return met


def _near(a: Edges, b: Edges, rows: int, wanted: np.ndarray, reach: float) -> np.ndarray:
    """Of the wanted rows, those in which two edges come within `reach`."""
    found = np.zeros(rows, bool)
    sides = [np.flatnonzero(wanted[x.row]) for x in (a, b)]
    for row, i, j in product(a.row[sides[0]], b.row[sides[1]], rows):
        i, j = sides[0][i], sides[1][j]
        close = np.flatnonzero(boxes_meet(a.ends(i), b.ends(j), reach + SNAP))
        hit = distance2(a.ends(i[close]), b.ends(j[close])) <= reach * reach + SNAP * SNAP
        found[row[close[hit]]] = True
    return found


def _begins(outer: Edges, inner: Edges, rows: int, wanted: np.ndarray) -> np.ndarray:
    """Of the wanted rows, those in which a part of the inner run begins inside the outer one, by the parity of edges to its right."""
    found = np.zeros(rows, bool)
    heads = np.flatnonzero(wanted[inner.row] & (inner.fields["seq"] == 0) & (inner.fields["ring"] == 0))
    edges = np.flatnonzero(wanted[outer.row])
    for _, i, j in product(inner.row[heads], outer.row[edges], rows):
        x, y, e = inner.fields["x1"][heads[i]], inner.fields["y1"][heads[i]], outer.ends(edges[j])
        hit = ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"]))
        found[inner.row[heads[np.bincount(i[hit], minlength=len(heads)) % 2 == 1]]] = True
    return found


def _flags(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)


def near(batches: Iterator[pa.RecordBatch], columns: list[str], reach: float) -> Iterator[pa.RecordBatch]:
    """`columns` of the rows whose runs a and b come within `reach`, or of which one (solid and whole) holds where the other's part begins.

    Boxes are those of `meeting.leveled`, a's widened by `reach`; a run of one part can only begin inside if its box lies in the outer box.
    """
    for batch in batches:
        n = batch.num_rows
        runs = {p: Edges(batch.column(f"{p}_edges")) for p in "ab"}
        box = {f"{p}_{c}": batch.column(f"{p}_{c}").to_numpy(zero_copy_only=False) for p in "ab" for c in ("bx0", "by0", "bx1", "by1")}
        inside = np.zeros(n, bool)
        with np.errstate(all="ignore"):
            for outer, inner in ("ab", "ba"):
                part, at = runs[inner].fields["part"], runs[inner].at
                fits = part[at[:-1]] != part[at[1:] - 1] if n else inside
                fits = fits | np.logical_and.reduce([(box[f"{inner}_b{c}0"] + 2 * reach >= box[f"{outer}_b{c}0"]) & (box[f"{inner}_b{c}1"] - 2 * reach <= box[f"{outer}_b{c}1"]) for c in "xy"])
                inside |= _begins(runs[outer], runs[inner], n, ~inside & fits & _flags(batch, f"{outer}_solid") & _flags(batch, f"{outer}_whole"))
            hits = inside | _near(runs["a"], runs["b"], n, ~inside, reach)
        yield batch.select(columns).filter(pa.array(hits))


def cut_places(a: Ends, b: Ends) -> tuple[np.ndarray, np.ndarray]:
    """(index, place) where segments b cross segments a or have an end on them; see `overlay.cut_places`."""
    dx, dy, ex, ey = a["x2"] - a["x1"], a["y2"] - a["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"]
    wx, wy = b["x1"] - a["x1"], b["y1"] - a["y1"]
    size2 = dx * dx + dy * dy
    det = cross(dx, dy, ex, ey)
    apart = np.abs(det) > EPS * np.sqrt(size2 * (ex * ex + ey * ey))
    t, u = cross(wx, wy, ex, ey) / det, cross(wx, wy, dx, dy) / det
    found = [(apart & (t >= -EPS) & (t <= 1 + EPS) & (u >= -EPS) & (u <= 1 + EPS), t)]
    for x, y in ((b["x1"], b["y1"]), (b["x2"], b["y2"])):
        off = np.abs(cross(dx, dy, x - a["x1"], y - a["y1"])) / np.sqrt(size2)
        place = ((x - a["x1"]) * dx + (y - a["y1"]) * dy) / size2
        found.append(((off <= SNAP) & (place >= 0) & (place <= 1), place))
    kept = [np.flatnonzero(good) for good, _ in found]
    return np.concatenate(kept), np.concatenate([place[k] for k, (_, place) in zip(kept, found, strict=True)])


def inner_cuts(a: Ends, b: Ends) -> tuple[np.ndarray, np.ndarray]:
    """Those of `cut_places` that split segments a, their ends left out."""
    index, place = cut_places(a, b)
    inner = (place > EPS) & (place < 1 - EPS)
    return index[inner], place[inner]


def cuts(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """`columns`, sid and places: where edges of run a are cut by edges of run b."""
    for batch in batches:
        a, b = Edges(batch.column("a_edges")), Edges(batch.column("b_edges"))
        for row, i, j in product(a.row, b.row, batch.num_rows):
            close = np.flatnonzero(boxes_meet(a.ends(i), b.ends(j), 2 * SNAP))
            row, i, j = row[close], i[close], j[close]
            with np.errstate(all="ignore"):
                index, place = inner_cuts(a.ends(i), b.ends(j))
            if len(index):
                keys = batch.select(columns).take(pa.array(row[index]))
                places = pa.ListArray.from_arrays(pa.array(np.arange(len(index) + 1), pa.int32()), pa.array(place))
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(a.fields["sid"][i[index]]), places], names=[*columns, "sid", "places"])
