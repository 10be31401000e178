"""Unions, rings and polygons of groups that are small enough for one task, many groups of a batch at once in numpy.

Rows come dealt and sorted by group.  Groups of at most LOCAL points are done where they lie;
rows of larger ones are passed on as they are, batch by batch, to the joins of `overlay` and
`rings`.  What is held is a batch, one small group, and CHUNK pairs of edges or points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from parcelwise.operators.pairwise import CHUNK, SNAP, Ends, boxes_meet, inner_cuts

#: Points of a group that one task goes through at once.
LOCAL = 1024
#: The same for containment, where only boxes that lie in each other are looked at closer.
LOCAL_PAIRS = 4096
ENDS = ("x1", "y1", "x2", "y2")


def _new(rows: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a row's keys are not those of the row before."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in keys:
        a, b = rows.column(c).slice(0, rows.num_rows - 1), rows.column(c).slice(1)
        other = pc.if_else(pc.and_(a.is_valid(), b.is_valid()), pc.not_equal(a, b), pc.not_equal(a.is_valid(), b.is_valid()))
        new[1:] |= other.to_numpy(zero_copy_only=False).astype(bool)
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], weight: Callable[[pa.RecordBatch, np.ndarray], np.ndarray], limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray | None]]:
    """Rows sorted by `keys`: (rows of whole groups, the number of each row's group), and (rows, None) of groups that weigh more than `limit`."""
    # the group that may go on; of a large one, whose rows are given out already, its last row
    held, given = None, False

    def parted(rows: pa.RecordBatch, last: bool):
        new = _new(rows, keys)
        begin, group = np.flatnonzero(new), np.cumsum(new) - 1
        large = np.bincount(group, weights=weight(rows, group)) > limit
        large[0] |= given
        done = len(begin) if last else len(begin) - 1
        out = []
        mine = ~large[group] & (group < done)
        if mine.any():
            some = rows.slice(0, begin[done] if done < len(begin) else rows.num_rows)
            out.append((some if mine[: some.num_rows].all() else rows.filter(pa.array(mine)), np.cumsum(new[mine]) - 1))
        theirs = large[group]
        theirs[:1] &= not given
        if theirs.any():
            out.append((rows.filter(pa.array(theirs)), None))
        return out, rows.slice(rows.num_rows - 1 if large[-1] else begin[-1]), bool(large[-1])

    for batch in batches:
        if batch.num_rows:
            out, held, given = parted(batch if held is None else pa.concat_batches([held, batch]), False)
            yield from out
    if held is not None:
        yield from parted(held, True)[0]


def partners(begin: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k, place) of all items k and their places begin[k], ..., begin[k] + count[k] - 1, about CHUNK at a time."""
    ends, first = np.cumsum(count), 0
    while first < len(count):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CHUNK, side="right")))
        n = count[first:last]
        yield np.repeat(np.arange(first, last), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin[first:last], n)
        first = last


def ranges(owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and number of each owner's items, which lie in order."""
    count = np.bincount(owner, minlength=owners)
    return np.cumsum(count) - count, count


def joined(parts: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def rounded(v: np.ndarray) -> np.ndarray:
    return np.round(v, 6) + 0.0


def points(geom: pa.ListArray) -> np.ndarray:
    """The number of points of each geometry."""
    at = geom.offsets.to_numpy().astype(np.int64)
    pts = geom.values.slice(at[0], at[-1] - at[0]).field("pts").offsets.to_numpy().astype(np.int64)
    return np.diff(pts[at - at[0]])


def _corners(geom: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each ring's row, whether it is a shell or line, and the place of its first point; each point's ring, x and y."""
    at = geom.offsets.to_numpy().astype(np.int64)
    rings = geom.values.slice(at[0], at[-1] - at[0])
    pts = rings.field("pts")
    of = pts.offsets.to_numpy().astype(np.int64)
    x, y = (pts.values.slice(of[0], of[-1] - of[0]).field(c).to_numpy(zero_copy_only=False) for c in "xy")
    ring = np.repeat(np.arange(len(of) - 1), np.diff(of))
    return np.repeat(np.arange(len(geom)), np.diff(at)), rings.field("ring").to_numpy(zero_copy_only=False) == 0, of[:-1] - of[0], ring, x, y


def _real(e: Ends) -> np.ndarray:
    """Edges that have a length."""
    return ((e["x1"] != e["x2"]) | (e["y1"] != e["y2"])) & ~np.isnan(sum(e.values()))


def _doubled(row: np.ndarray, begin: np.ndarray, ring: np.ndarray, x: np.ndarray, y: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Twice the signed area of each ring with at least four points, over its edges i; from its first corner, for precision."""
    dx, dy = x - x[begin[ring]], y - y[begin[ring]]
    area = np.bincount(ring[i], weights=dx[i] * dy[i + 1] - dx[i + 1] * dy[i], minlength=len(row))
    area[np.bincount(ring, minlength=len(row)) < 4] = 0
    return area


def solid(geom: pa.ListArray) -> np.ndarray:
    """Whether a geometry has an area, as in `geometry.area`: shells less holes, none where a coordinate is missing."""
    row, shell, begin, ring, x, y = _corners(geom)
    i = np.flatnonzero(ring[:-1] == ring[1:])
    size = np.abs(_doubled(row, begin, ring, x, y, i))
    total = np.bincount(row, weights=np.where(shell, size, -size), minlength=len(geom))
    found = ~(total <= 0)
    if geom.flatten().field("pts").flatten().field("x").null_count + geom.flatten().field("pts").flatten().field("y").null_count:
        points_ = geom.flatten().field("pts").flatten()
        missing = ~np.logical_and.reduce([points_.field(c).is_valid().to_numpy(zero_copy_only=False) for c in "xy"])
        found[row[ring[missing]]] = False
    return found


def with_area(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows but those that are `judged` by their area and have none."""
    for batch in batches:
        with np.errstate(all="ignore"):
            kept = ~batch.column("judged").to_numpy(zero_copy_only=False) | solid(batch.column("geom"))
        yield batch if kept.all() else batch.filter(pa.array(kept))


def lines(geom: pa.ListArray) -> tuple[np.ndarray, np.ndarray, Ends]:
    """The row of each line (a ring), and the line and ends of every edge as they run."""
    row, _, _, ring, x, y = _corners(geom)
    i = np.flatnonzero(ring[:-1] == ring[1:])
    ends = {"x1": x[i], "y1": y[i], "x2": x[i + 1], "y2": y[i + 1]}
    real = _real(ends)
    return row, ring[i][real], take(ends, real)


def outlines(geom: pa.ListArray) -> tuple[np.ndarray, Ends, np.ndarray]:
    """Row and ends of every edge, interior on the left, in order of rows; and the rows' boxes (x0, y0, x1, y1)."""
    row, shell, begin, ring, x, y = _corners(geom)
    i = np.flatnonzero(ring[:-1] == ring[1:])
    area = _doubled(row, begin, ring, x, y, i)
    flip = ((area < 0) == shell)[ring[i]]
    a, b = np.where(flip, i + 1, i), np.where(flip, i, i + 1)
    ends = {"x1": x[a], "y1": y[a], "x2": x[b], "y2": y[b]}
    real = _real(ends)
    box = np.tile(np.array([np.inf, np.inf, -np.inf, -np.inf]), (len(geom), 1))
    for k, (v, use) in enumerate(((x, np.fmin), (y, np.fmin), (x, np.fmax), (y, np.fmax))):
        use.at(box[:, k], row[ring], v)
    return row[ring[i]][real], take(ends, real), box


def take(e: Ends, at: np.ndarray) -> Ends:
    return {c: v[at] for c, v in e.items()}


def split(e: Ends, edge: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, Ends]:
    """The edges cut at their places: the edge that each piece is of, and its ends, snapped; see `overlay.split_edges`."""
    cut = np.unique(edge)
    edge, place = np.concatenate([edge, cut, cut]), np.concatenate([place, np.zeros(len(cut)), np.ones(len(cut))])
    order = np.lexsort((place, edge))
    edge, place = edge[order], place[order]
    i = np.flatnonzero((edge[:-1] == edge[1:]) & (place[:-1] != place[1:]))
    at = lambda c, d, k: np.where(place[k] == 0, e[c][edge[k]], np.where(place[k] == 1, e[d][edge[k]], e[c][edge[k]] + (e[d][edge[k]] - e[c][edge[k]]) * place[k]))
    pieces = {"x1": at("x1", "x2", i), "y1": at("y1", "y2", i), "x2": at("x1", "x2", i + 1), "y2": at("y1", "y2", i + 1)}
    rest = np.setdiff1d(np.arange(len(e["x1"])), cut, assume_unique=True)
    of = np.concatenate([rest, edge[i]])
    out = {c: rounded(np.concatenate([e[c][rest], pieces[c]])) for c in ENDS}
    real = (out["x1"] != out["x2"]) | (out["y1"] != out["y2"])
    return of[real], take(out, real)


def beside(e: Ends) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The middles of segments, moved a little to their left and to their right."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    size = np.hypot(dx, dy)
    step = np.minimum(1e-4, size / 4)
    nx, ny, mx, my = -dy / size * step, dx / size * step, (e["x1"] + e["x2"]) / 2, (e["y1"] + e["y2"]) / 2
    return (mx + nx, my + ny), (mx - nx, my - ny)


def around(x: np.ndarray, y: np.ndarray, begin: np.ndarray, count: np.ndarray, e: Ends, polygon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, polygon): in which polygons point k lies, of those with edges at its places; by the parity of edges to its right."""
    found, base = [], int(polygon.max(initial=0)) + 1
    for k, j in partners(begin, count):
        i = np.flatnonzero((e["y1"][j] > y[k]) != (e["y2"][j] > y[k]))
        k, j = k[i], j[i]
        right = x[k] < e["x1"][j] + (y[k] - e["y1"][j]) * (e["x2"][j] - e["x1"][j]) / (e["y2"][j] - e["y1"][j])
        pair, n = np.unique(k[right] * base + polygon[j[right]], return_counts=True)
        found.append(pair[n % 2 == 1])
    every = joined(found)
    return every // base, every % base


def union(geom: pa.ListArray, polygon: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, Ends]:
    """Group and ends of the boundary edges of each group's union, interior on the left; see `overlay.union_edges`."""
    groups = int(group[-1]) + 1
    row, e, box = outlines(geom)
    first, size = ranges(group, groups)
    begin, count = ranges(row, len(group))
    over, some, other = np.zeros(groups, bool), [], []
    for i, j in partners(first[group], size[group]):
        gap = np.minimum(np.minimum(box[i, 2], box[j, 2]) - np.maximum(box[i, 0], box[j, 0]), np.minimum(box[i, 3], box[j, 3]) - np.maximum(box[i, 1], box[j, 1]))
        apart = polygon[i] != polygon[j]
        over[group[i[apart & (gap > 2 * SNAP)]]] = True
        met = apart & (gap >= -2 * SNAP)
        some.append(i[met])
        other.append(j[met])
    some, other = joined(some), joined(other)
    # edges of one polygon that meet the other's box, then pairs of edges
    edge, of = [], []
    for k, a in partners(begin[some], count[some]):
        b = box[other[k]]
        near = np.flatnonzero((np.minimum(e["x1"][a], e["x2"][a]) <= b[:, 2] + 2 * SNAP) & (np.maximum(e["x1"][a], e["x2"][a]) >= b[:, 0] - 2 * SNAP) & (np.minimum(e["y1"][a], e["y2"][a]) <= b[:, 3] + 2 * SNAP) & (np.maximum(e["y1"][a], e["y2"][a]) >= b[:, 1] - 2 * SNAP))
        edge.append(a[near])
        of.append(other[k[near]])
    edge, of = joined(edge), joined(of)
    cut, place = [], []
    for k, b in partners(begin[of], count[of]):
        a = edge[k]
        close = np.flatnonzero(boxes_meet(take(e, a), take(e, b), 2 * SNAP))
        a, b = a[close], b[close]
        index, at = inner_cuts(take(e, a), take(e, b))
        cut.append(a[index])
        place.append(at)
    source, parts = split(e, joined(cut), joined(place, np.float64))
    own = group[row[source]]
    flip = (parts["x1"] > parts["x2"]) | ((parts["x1"] == parts["x2"]) & (parts["y1"] > parts["y2"]))
    ends = {c: np.where(flip, parts[o], parts[c]) for c, o in zip(ENDS, ("x2", "y2", "x1", "y1"), strict=True)}
    order = np.lexsort((ends["y2"], ends["x2"], ends["y1"], ends["x1"], own))
    ends, own = take(ends, order), own[order]
    new = np.append(True, np.logical_or.reduce([np.diff(v) != 0 for v in (own, *ends.values())]))[: len(own)]
    start = np.flatnonzero(new)
    net = np.add.reduceat(np.where(flip[order], -1, 1), start) if len(start) else start
    ends, own = take(ends, start), own[start]
    kept, back = net != 0, net < 0
    mixed = np.flatnonzero(over[own])
    if len(mixed):
        edges_of = group[row]
        at, n = ranges(edges_of, groups)
        _, code = np.unique(polygon, return_inverse=True)
        inside = np.zeros((2, len(mixed)), bool)
        for k, (x, y) in enumerate(beside(take(ends, mixed))):
            inside[k][around(x, y, at[own[mixed]], n[own[mixed]], e, code[row])[0]] = True
        kept[mixed], back[mixed] = inside[0] ^ inside[1], inside[1]
    return own[kept], {c: np.where(back, ends[o], ends[c])[kept] for c, o in zip(ENDS, ("x2", "y2", "x1", "y1"), strict=True)}


def _after(group: np.ndarray, e: Ends, clockwise: bool) -> np.ndarray:
    """The edge after each edge at the spot of its group where it arrives, in the order of their angles; -1 for none."""
    n = len(group)
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    x, y, of = np.concatenate([e["x1"], e["x2"]]), np.concatenate([e["y1"], e["y2"]]), np.concatenate([group, group])
    angle = np.concatenate([np.arctan2(dy, dx), np.arctan2(-dy, -dx)])
    arrives = np.arange(2 * n) >= n
    order = np.lexsort((arrives, -angle if clockwise else angle, y, x, of))
    x, y, of = x[order], y[order], of[order]
    new = np.append(True, (np.diff(of) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0))[: 2 * n]
    spot = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    leaving = np.flatnonzero(~arrives[order])
    here = np.flatnonzero(arrives[order])
    ends = np.append(begin[1:], 2 * n)[spot[here]]
    place = lambda at: np.append(leaving, 2 * n)[np.searchsorted(leaving, at)]
    later, first = place(here), place(begin[spot[here]])
    to = np.where(later < ends, later, np.where(first < ends, first, -1))
    # an edge follows one other at most
    once = np.zeros(len(to), bool)
    once[np.unique(to, return_index=True)[1]] = True
    after = np.full(n, -1)
    good = once & (to >= 0)
    after[order[here[good]] - n] = order[to[good]]
    return after


def _closed(after: np.ndarray) -> np.ndarray:
    """The least edge of each edge's closed way, -1 on open ways."""
    ring, to = np.arange(len(after)), after
    while True:
        on = to >= 0
        low, there = ring.copy(), np.full(len(to), -1)
        low[on], there[on] = np.minimum(ring[on], ring[to[on]]), to[to[on]]
        same = (low == ring).all() and ((there >= 0) == on).all()
        ring, to = low, there
        if same:
            return np.where(to >= 0, ring, -1)


def rings(group: np.ndarray, e: Ends) -> tuple[np.ndarray, Ends, dict[str, np.ndarray]]:
    """Group, ends and ring (its least edge), seq, start, ring_length of the edges on closed rings; see `rings.rings`."""
    e = {c: rounded(v) for c, v in e.items()}
    order = np.lexsort((e["y2"], e["x2"], e["y1"], e["x1"], group))
    group, e = group[order], take(e, order)
    new = np.append(True, np.logical_or.reduce([np.diff(v) != 0 for v in (group, *e.values())]))[: len(group)]
    real = new & ((e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))
    group, e = group[real], take(e, real)
    after = _after(group, e, True)
    ring = _closed(after)
    on = np.flatnonzero(ring >= 0)
    # a corner that a ring passes twice: there it is parted along the outside instead
    order = on[np.lexsort((e["y2"][on], e["x2"][on], ring[on]))]
    spot = np.cumsum(np.append(False, np.logical_or.reduce([np.diff(v[order]) != 0 for v in (ring, e["x2"], e["y2"])]))[: len(on)])
    twice = order[np.bincount(spot)[spot] > 1]
    if len(twice):
        other = np.full(len(after), -1)
        own = _after(ring[on], take(e, on), False)
        other[on] = np.where(own >= 0, on[own], -1)
        twice = twice[other[twice] >= 0]
        after[twice] = other[twice]
        after[ring < 0] = -1
        ring = _closed(after)
        on = np.flatnonzero(ring >= 0)
    size = np.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"])
    # cut before the ring's least edge, pointers run to its end and sum what lies there
    to, n, rest = np.where((ring >= 0) & (after != ring), after, -1), np.ones(len(after), np.int64), size.copy()
    while (to >= 0).any():
        k = np.flatnonzero(to >= 0)
        n2, rest2, there = n[to[k]], rest[to[k]], to[to[k]]
        n[k], rest[k], to[k] = n[k] + n2, rest[k] + rest2, there
    lead = ring[on]
    return group[on], take(e, on), {"ring": lead, "seq": n[lead] - n[on], "start": np.maximum(0.0, rest[lead] - rest[on]), "ring_length": rest[lead]}


def polygons(group: np.ndarray, e: Ends) -> tuple[np.ndarray, pa.ListArray]:
    """Groups and the polygons that their boundaries enclose; see `rings.polygons`."""
    group, e, at = rings(group, e)
    order = np.lexsort((at["seq"], at["ring"]))
    group, e, ring = group[order], take(e, order), at["ring"][order]
    _, begin, of, size = np.unique(ring, return_index=True, return_inverse=True, return_counts=True)
    x0, y0 = e["x1"][begin][of], e["y1"][begin][of]
    area = np.bincount(of, weights=(e["x1"] - x0) * (e["y2"] - y0) - (e["y1"] - y0) * (e["x2"] - x0), minlength=len(begin)) / 2
    owner = np.where(area > 0, np.arange(len(begin)), -1)
    holes = np.flatnonzero(area < 0)
    if len(holes):
        # edges of shells lie by group, as rings do
        outer = np.flatnonzero(area[of] > 0)
        first, count = ranges(group[outer], int(group[-1]) + 1)
        x, y = beside(take(e, begin[holes]))[0]
        own = group[begin[holes]]
        k, shell = around(x, y, first[own], count[own], take(e, outer), of[outer])
        order = np.lexsort((area[shell], k))
        k, shell = k[order], shell[order]
        k, nearest = np.unique(k, return_index=True)
        owner[holes[k]] = shell[nearest]
    # a ring begins at its least edge, which leaves its least corner
    corner = np.stack([e["x1"][begin], e["y1"][begin]])
    every = np.flatnonzero(owner >= 0)
    own = owner[every]
    order = np.lexsort((every, corner[1, every], corner[0, every], every != own, own, corner[1, own], corner[0, own], group[begin[every]]))
    every, own = every[order], own[order]
    groups = group[begin[every]]
    new_group, new_shell = (np.append(True, np.diff(v) != 0)[: len(every)] for v in (groups, own))
    shells = np.cumsum(new_shell) - 1
    part = shells - shells[np.flatnonzero(new_group)][np.cumsum(new_group) - 1]
    number = np.arange(len(every)) - np.flatnonzero(new_shell)[shells]
    count = size[every] + 1
    at = np.repeat(begin[every] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    at[np.cumsum(count) - 1] = begin[every]
    pts = pa.ListArray.from_arrays(np.append(0, np.cumsum(count)).astype(np.int32), pa.StructArray.from_arrays([pa.array(e["x1"][at]), pa.array(e["y1"][at])], ["x", "y"]))
    found = pa.StructArray.from_arrays([pa.array(part.astype(np.int32)), pa.array(number.astype(np.int32)), pts], ["part", "ring", "pts"])
    starts = np.flatnonzero(new_group)
    return groups[starts], pa.ListArray.from_arrays(np.append(starts, len(every)).astype(np.int32), found)


def dissolve(batches: Iterator[pa.RecordBatch], keys: list[str], form: str) -> Iterator[pa.RecordBatch]:
    """Polygons (keys, feature_id, polygon, geom, judged) sorted by keys -> their unions in the form that is asked for: edges, rings or polygons.

    Rows of groups over LOCAL points come out as they were, in feature_id and geom, which are null elsewhere.
    """
    for rows, group in whole_groups(with_area(batches), keys, lambda r, _: points(r.column("geom")), LOCAL):
        n, empty = rows.num_rows, {c: rows.column(c).type for c in ("feature_id", "geom")}
        if group is None:
            made = {c: pa.nulls(n, kind) for c, kind in FORMS[form].items()}
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keys), *made.values(), *(rows.column(c) for c in empty)], names=[*keys, *made, *empty])
            continue
        with np.errstate(all="ignore"):
            own, e = union(rows.column("geom"), rows.column("polygon").to_numpy(), group)
            made = dict(e)
            if form == "rings":
                own, e, at = rings(own, e)
                made = {**at, **e}
            if form == "polygons":
                own, shape = polygons(own, e)
                made = {"members": np.bincount(group)[own], "shape": shape}
        first = np.flatnonzero(np.append(True, np.diff(group) != 0))
        cells = [v if isinstance(v, pa.Array) else pa.array(v) for v in made.values()]
        yield pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(first[own])) for c in keys), *cells, *(pa.nulls(len(own), kind) for kind in empty.values())], names=[*keys, *made, *empty])


def expanded(of: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, edge) of all edges of each shape in `of`."""
    n = count[of]
    return np.repeat(np.arange(len(of)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin[of], n)


def _pieces_beside(one: np.ndarray, other: np.ndarray, e: Ends, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of each pair of shapes the edges of `one`, cut where they meet those of `other`: the pair of each piece, and the spots at its sides."""
    pair, edge = expanded(one, begin, count)
    cut, place = [], []
    of = other[pair]
    for k, j in partners(begin[of], count[of]):
        close = np.flatnonzero(boxes_meet(take(e, edge[k]), take(e, j), 2 * SNAP))
        k, j = k[close], j[close]
        index, at = inner_cuts(take(e, edge[k]), take(e, j))
        cut.append(k[index])
        place.append(at)
    source, parts = split(take(e, edge), joined(cut), joined(place, np.float64))
    return pair[source], list(beside(parts))


def _in(spots: tuple[np.ndarray, np.ndarray], shape: np.ndarray, e: Ends, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether each spot lies in its shape."""
    found = np.zeros(len(shape), bool)
    found[around(*spots, begin[shape], count[shape], e, np.zeros(len(e["x1"]), np.int64))[0]] = True
    return found


def contained(inner: np.ndarray, outer: np.ndarray, e: Ends, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of pairs of polygons, in which the outer one contains the inner; see `overlay.holding`."""
    pair, sides = _pieces_beside(inner, outer, e, begin, count)
    pair, spots = np.tile(pair, 2), tuple(np.concatenate(v) for v in zip(*sides, strict=True))
    own = _in(spots, inner[pair], e, begin, count)
    pair, spots = pair[own], tuple(v[own] for v in spots)
    good = np.bincount(pair, minlength=len(inner)) > 0
    good[pair[~_in(spots, outer[pair], e, begin, count)]] = False
    left = np.flatnonzero(good)
    # the holder's edges: none may have both sides in the held polygon
    pair, sides = _pieces_beside(outer[left], inner[left], e, begin, count)
    through = np.logical_and.reduce([_in(spots, inner[left][pair], e, begin, count) for spots in sides])
    good[left[pair[through]]] = False
    return good


def _hold_weight(rows: pa.RecordBatch, group: np.ndarray) -> np.ndarray:
    """Points of each row; a group with a line or points to be held, or with several rows of a feature, is never small."""
    out = np.maximum(1, points(rows.column("geom")))
    out[rows.column("flat").to_numpy(zero_copy_only=False)] = LOCAL_PAIRS + 1
    sides = (group, rows.column("holds").to_numpy(zero_copy_only=False).astype(np.int64), rows.column("name").to_numpy())
    order = np.lexsort(sides[::-1])
    again = np.append(False, np.logical_and.reduce([np.diff(v[order]) == 0 for v in sides]))[: len(order)]
    out[order[again]] = LOCAL_PAIRS + 1
    return out


def hold(batches: Iterator[pa.RecordBatch], keys: list[str], raw: list[str]) -> Iterator[pa.RecordBatch]:
    """Polygons to hold (outer_id) and to be held (inner_id) sorted by keys -> keys, outer, inner; rows of large groups come out as they were."""
    for rows, group in whole_groups(with_area(batches), keys, _hold_weight, LOCAL_PAIRS):
        n, ids = rows.num_rows, [rows.column(c) for c in ("outer_id", "inner_id")]
        names = [*keys, "outer", "inner", *raw, "large"]
        if group is None:
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keys), *(pa.nulls(n, c.type) for c in ids), *(rows.column(c) for c in raw), pa.array(np.ones(n, bool))], names=names)
            continue
        holds = rows.column("holds").to_numpy(zero_copy_only=False)
        row, e, box = outlines(rows.column("geom"))
        begin, count = ranges(row, n)
        sides = [np.flatnonzero(v) for v in (holds, ~holds)]
        first, size = ranges(group[sides[0]], int(group[-1]) + 1)
        of = group[sides[1]]
        with np.errstate(all="ignore"):
            for k, j in partners(first[of], size[of]):
                i, o = sides[1][k], sides[0][j]
                fits = np.logical_and.reduce([box[i, 0] >= box[o, 0] - SNAP, box[i, 1] >= box[o, 1] - SNAP, box[i, 2] <= box[o, 2] + SNAP, box[i, 3] <= box[o, 3] + SNAP])
                i, o = i[fits], o[fits]
                step = np.cumsum(count[i] + count[o]) // CHUNK
                for some in np.split(np.arange(len(i)), np.flatnonzero(np.diff(step)) + 1):
                    good = some[contained(i[some], o[some], e, begin, count)]
                    kept = [pa.nulls(len(good), rows.column(c).type) for c in raw]
                    yield pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(o[good])) for c in keys), ids[0].take(pa.array(o[good])), ids[1].take(pa.array(i[good])), *kept, pa.array(np.zeros(len(good), bool))], names=names)


_GEOMETRY = pa.list_(pa.struct([("part", pa.int32()), ("ring", pa.int32()), ("pts", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))]))
#: Form -> the columns that it gives.
FORMS = {
    "edges": dict.fromkeys(ENDS, pa.float64()),
    "rings": {"ring": pa.int64(), "seq": pa.int64(), "start": pa.float64(), "ring_length": pa.float64(), **dict.fromkeys(ENDS, pa.float64())},
    "polygons": {"members": pa.int64(), "shape": _GEOMETRY},
}
