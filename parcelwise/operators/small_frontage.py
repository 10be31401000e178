"""Frontages of the lots of projects that are small enough for one task, many projects of a batch at once in numpy.

The steps are those of `frontage`, whose joins take projects over `small.LOCAL_PAIRS` points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from parcelwise.operators.pairwise import SNAP, Ends, boxes_meet, cut_places
from parcelwise.operators.small import LOCAL_PAIRS, around, expanded, joined, lines, outlines, partners, points, ranges, take, whole_groups

KEYS = ["project_id"]
RAW = ("feature_id", "road_id", "geom", "road")
MADE = ("made_id", "part", "ring", "from", "to")


def within(a: Ends, b: Ends, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The part s to t of each segment a, from 0 to 1, that lies within `reach` of segment b, s over t if none; see `frontage._within`."""
    dx, dy, ex, ey = a["x2"] - a["x1"], a["y2"] - a["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"]
    wx, wy = a["x1"] - b["x1"], a["y1"] - b["y1"]
    size2 = ex * ex + ey * ey

    def span(value0: np.ndarray, value1: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        flat, inside = np.abs(value1) < 1e-12, (value0 >= low) & (value0 <= high)
        one, two = (low - value0) / value1, (high - value0) / value1
        return np.where(flat, np.where(inside, 0.0, 2.0), np.minimum(one, two)), np.where(flat, np.where(inside, 1.0, -1.0), np.maximum(one, two))

    def disc(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        px, py = a["x1"] - x, a["y1"] - y
        p, q, r = dx * dx + dy * dy, px * dx + py * dy, px * px + py * py - reach * reach
        root = q * q - p * r
        side = np.sqrt(np.maximum(root, 0.0))
        return np.where(root >= 0, (-q - side) / p, 2.0), np.where(root >= 0, (-q + side) / p, -1.0)

    size = np.sqrt(size2)
    first = span((ex * wy - ey * wx) / size, (ex * dy - ey * dx) / size, -reach, reach)
    second = span((wx * ex + wy * ey) / size2, (dx * ex + dy * ey) / size2, 0.0, 1.0)
    s, t = np.full(len(dx), 2.0), np.full(len(dx), -1.0)
    for low, high in ((np.maximum(first[0], second[0]), np.minimum(first[1], second[1])), disc(b["x1"], b["y1"]), disc(b["x2"], b["y2"])):
        low, high = np.maximum(low, 0.0), np.minimum(high, 1.0)
        good = low <= high
        s, t = np.where(good, np.minimum(s, low), s), np.where(good, np.maximum(t, high), t)
    return s, t


def _onward(owner: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the second items of all owners, then of the third, and so on; items lie by owner."""
    begin = np.flatnonzero(np.append(True, np.diff(owner) != 0)[: len(owner)])
    count = np.diff(np.append(begin, len(owner)))
    k = 1
    while True:
        begin, count = begin[count > k], count[count > k]
        if not len(begin):
            return
        yield begin + k
        k += 1


def _outline(geom: pa.ListArray) -> tuple[np.ndarray, np.ndarray, Ends, np.ndarray, np.ndarray, np.ndarray]:
    """Row and ring of the edges in the order of their parts and rings, their ends, and metres from the row's first; each ring's part and number."""
    row, ring, e = lines(geom)
    part, number = (geom.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("part", "ring"))
    place = np.empty(len(row), np.int64)
    place[np.lexsort((number, part, row))] = np.arange(len(row))
    order = np.argsort(place[ring], kind="stable")
    ring, e = ring[order], take(e, order)
    size, start = np.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]), np.zeros(len(ring))
    for at in _onward(row[ring]):
        start[at] = start[at - 1] + size[at - 1]
    return row[ring], ring, e, start, part, number


def parts(rows: pa.RecordBatch, group: np.ndarray, reach: float) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The row of each part of a lot's outline that fronts a road, and its part, ring, from and to; see `frontage.frontage_parts`."""
    geom, n = rows.column("geom"), rows.num_rows
    road = rows.column("road").to_numpy(zero_copy_only=False)
    row, ring, e, start, part, number = _outline(geom)
    size = np.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"])
    box = outlines(geom)[2]
    begin, count = ranges(row, n)
    sides = [np.flatnonzero(v) for v in (road, ~road)]
    groups = int(group[-1]) + 1
    first, number_of = ranges(group[sides[0]], groups)
    of = group[sides[1]]
    some, other = [], []
    for k, j in partners(first[of], number_of[of]):
        i, j = sides[1][k], sides[0][j]
        gap = np.maximum(np.maximum(box[i, 0] - box[j, 2], box[j, 0] - box[i, 2]), np.maximum(box[i, 1] - box[j, 3], box[j, 1] - box[i, 3]))
        near = gap <= reach + 2 * SNAP
        some.append(i[near])
        other.append(j[near])
    some, other = joined(some), joined(other)
    pair, edge = expanded(some, begin, count)
    at, low, high, cut, place = [], [], [], [], []
    for k, b in partners(begin[other[pair]], count[other[pair]]):
        a = edge[k]
        close = np.flatnonzero(boxes_meet(take(e, a), take(e, b), reach + 2 * SNAP))
        a, b = a[close], b[close]
        s, t = within(take(e, a), take(e, b), reach)
        good = s <= t
        at.append(a[good])
        low.append(s[good])
        high.append(t[good])
        index, where = cut_places(take(e, a), take(e, b))
        cut.append(a[index])
        place.append(where)
    # what lies inside the footprint: pieces between the crossings whose middle is inside
    own = expanded(np.unique(some), begin, count)[1]
    cut, place = np.concatenate([*cut, own, own]), np.concatenate([*place, np.zeros(len(own)), np.ones(len(own))])
    order = np.lexsort((place, cut))
    cut, place = cut[order], place[order]
    k = np.flatnonzero((cut[:-1] == cut[1:]) & (place[1:] > place[:-1]))
    a, s, t = cut[k], place[k], place[k + 1]
    middle = (s + t) / 2
    outer = np.flatnonzero(road[row])
    first, number_of = ranges(group[row[outer]], groups)
    mine = group[row[a]]
    x, y = (e[f"{c}1"][a] + (e[f"{c}2"][a] - e[f"{c}1"][a]) * middle for c in "xy")
    inside = np.unique(around(x, y, first[mine], number_of[mine], take(e, outer), row[outer])[0])
    at, low, high = np.concatenate([*at, a[inside]]), np.concatenate([*low, s[inside]]), np.concatenate([*high, t[inside]])
    low, high = start[at] + low * size[at], start[at] + high * size[at]
    # gaps and islands along each ring
    order = np.lexsort((high, low, ring[at]))
    at, low, high = at[order], low[order], high[order]
    reached = np.full(len(at), -np.inf)
    for k in _onward(ring[at]):
        reached[k] = np.maximum(reached[k - 1], high[k - 1])
    begins = np.flatnonzero(~(low <= reached + 1e-7))
    ring = ring[at[begins]]
    return row[at[begins]], {"part": part[ring], "ring": number[ring], "from": low[begins], "to": np.maximum.reduceat(high, begins) if len(begins) else high}


def _weight(rows: pa.RecordBatch, group: np.ndarray) -> np.ndarray:
    """Points of each row; a project with several rows of a feature is never small."""
    out = np.maximum(1, points(rows.column("geom")))
    sides = (group, rows.column("road").to_numpy(zero_copy_only=False).astype(np.int64), rows.column("name").to_numpy())
    order = np.lexsort(sides[::-1])
    again = np.append(False, np.logical_and.reduce([np.diff(v[order]) == 0 for v in sides]))[: len(order)]
    out[order[again]] = LOCAL_PAIRS + 1
    return out


def frontages(batches: Iterator[pa.RecordBatch], reach: float) -> Iterator[pa.RecordBatch]:
    """Lots (feature_id) and footprints (road_id) sorted by project -> project_id and MADE; rows of large projects come out as they were."""
    names = [*KEYS, *MADE, *RAW, "large"]
    made = {"part": pa.int32(), "ring": pa.int32(), "from": pa.float64(), "to": pa.float64()}
    for rows, group in whole_groups(batches, KEYS, _weight, LOCAL_PAIRS):
        n, ids = rows.num_rows, rows.column("feature_id")
        if group is None:
            yield pa.RecordBatch.from_arrays([rows.column("project_id"), pa.nulls(n, ids.type), *(pa.nulls(n, t) for t in made.values()), *(rows.column(c) for c in RAW), pa.array(np.ones(n, bool))], names=names)
            continue
        with np.errstate(all="ignore"):
            row, found = parts(rows, group, reach)
        kept = [pa.nulls(len(row), rows.column(c).type) for c in RAW]
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([rows.column("project_id").take(at), ids.take(at), *(pa.array(found[c], t) for c, t in made.items()), *kept, pa.array(np.zeros(len(row), bool))], names=names)
