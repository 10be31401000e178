"""Road networks of projects that are small enough for one task, many projects of a batch at once in numpy.

The steps are those of `roads`, whose joins take the projects over `small.LOCAL` points; which
of them a project goes by changes nothing in its edges and warnings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from parcelwise.operators.pairwise import EPS, SNAP, Ends, boxes_meet, cross, cut_places, distance2
from parcelwise.operators.small import ENDS, LOCAL, joined, lines, partners, points, ranges, rounded, split, take, whole_groups

EXISTING, PROPOSED = "existente", "proposta"
KEYS = ["project_id"]
#: Columns of the rows that go in: a centreline with the numbers of its lines, or the point of an unlink.
RAW = ("feature_id", "name", "road_status", "lines", "geom", "unlink_id", "x", "y", "spot")


def labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of the numbers below n that each is connected with."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows, and in it where values are not those of the row before; the first column leads."""
    order = np.lexsort(columns[::-1])
    return order, np.append(True, np.logical_or.reduce([np.diff(c[order]) != 0 for c in columns]))[: len(order)]


def _codes(*columns: np.ndarray) -> np.ndarray:
    """Equal numbers for equal rows."""
    order, new = _runs(*columns)
    code = np.zeros(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    return code


def _distinct(a: np.ndarray, b: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of numbers a and b (below base), in order."""
    found = np.unique(a * base + b)
    return found // max(base, 1), found % max(base, 1)


class Network:
    """The lines of a batch's projects, as edges in order of their projects and lines."""

    def __init__(self, rows: pa.RecordBatch, group: np.ndarray, tolerance: float) -> None:
        self.tolerance, self.groups = tolerance, int(group[-1]) + 1
        self.row, self.line, self.e = lines(rows.column("geom"))
        self.number = rows.column("lines").flatten().to_numpy(zero_copy_only=False)
        self.of = group[self.row]  # the project of a line
        self._cluster()
        self._snap()
        self.spots = np.flatnonzero(rows.column("spot").to_numpy(zero_copy_only=False))
        self.spot_of, self.spot_x, self.spot_y = group[self.spots], *(rows.column(c).to_numpy(zero_copy_only=False)[self.spots] for c in "xy")
        self._unlink()

    def _tips(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges at the two ends of each line, the first and the last by turns, and where they lie."""
        new = np.append(True, np.diff(self.line) != 0)[: len(self.line)]
        first = np.flatnonzero(new)
        tips = np.stack([first, np.append(first[1:], len(new))[: len(first)] - 1], axis=1).ravel()
        start = np.arange(len(tips)) % 2 == 0
        return tips, *(np.where(start, self.e[f"{c}1"][tips], self.e[f"{c}2"][tips]) for c in "xy")

    def _move(self, tips: np.ndarray, which: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """The tips `which` go to their new places; edges that lose their length go."""
        for k, end in ((0, "1"), (1, "2")):
            own = which % 2 == k
            self.e[f"x{end}"][tips[which[own]]], self.e[f"y{end}"][tips[which[own]]] = x[own], y[own]
        real = (self.e["x1"] != self.e["x2"]) | (self.e["y1"] != self.e["y2"])
        self.line, self.e = self.line[real], take(self.e, real)

    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin and number of each project's edges."""
        return ranges(self.of[self.line], self.groups)

    def _cluster(self) -> None:
        tips, x, y = self._tips()
        of = self.of[self.line[tips]]
        begin, count = ranges(of, self.groups)
        one, two = [], []
        for i, j in partners(begin[of], count[of]):
            near = (i < j) & (np.hypot(x[i] - x[j], y[i] - y[j]) <= self.tolerance)
            one.append(i[near])
            two.append(j[near])
        one, two = joined(one), joined(two)
        label = labels(one, two, len(tips))
        which = np.unique(np.concatenate([one, two]))
        n = np.bincount(label[which], minlength=len(tips))
        mean = [rounded(np.bincount(label[which], weights=v[which], minlength=len(tips))[label[which]] / n[label[which]]) for v in (x, y)]
        self._move(tips, which, *mean)

    def _snap(self) -> None:
        tips, x, y = self._tips()
        begin, count = self._edges()
        of = self.of[self.line[tips]]
        best = []
        for k, j in partners(begin[of], count[of]):
            e = take(self.e, j)
            close = self.line[tips[k]] != self.line[j]
            for c, v in (("x", x), ("y", y)):
                close &= (np.minimum(e[f"{c}1"], e[f"{c}2"]) <= v[k] + self.tolerance + 2 * SNAP) & (np.maximum(e[f"{c}1"], e[f"{c}2"]) >= v[k] - self.tolerance - 2 * SNAP)
            k, j, e = k[close], j[close], take(e, close)
            dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
            t = np.clip(((x[k] - e["x1"]) * dx + (y[k] - e["y1"]) * dy) / (dx * dx + dy * dy), 0.0, 1.0)
            px, py = rounded(e["x1"] + t * dx), rounded(e["y1"] + t * dy)
            gap = np.hypot(px - x[k], py - y[k])
            good = gap <= self.tolerance
            best.append((k[good], gap[good], self.number[self.line[j[good]]], px[good], py[good]))
        if best:
            k, gap, number, px, py = (np.concatenate(v) for v in zip(*best, strict=True))
            order = np.lexsort((py, px, number, gap, k))
            which, first = np.unique(k[order], return_index=True)
            self._move(tips, which, px[order][first], py[order][first])

    def _unlink(self) -> None:
        """Which points match exactly two lines, and which."""
        begin, count = self._edges()
        spot, line = [], []
        for k, j in partners(begin[self.spot_of], count[self.spot_of]):
            x, y = self.spot_x[k], self.spot_y[k]
            near = distance2(take(self.e, j), {"x1": x, "y1": y, "x2": x + 1e-9, "y2": y}) <= self.tolerance**2
            spot.append(k[near])
            line.append(self.line[j[near]])
        spot, line = _distinct(joined(spot), joined(line), len(self.row))
        self.matched = np.bincount(spot, minlength=len(self.spots)) == 2
        self.apart = line[self.matched[spot]].reshape(-1, 2)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Edges of two lines of one project whose boxes meet."""
        begin, count = self._edges()
        of = self.of[self.line]
        for a, b in partners(begin[of], count[of]):
            close = np.flatnonzero((self.line[a] != self.line[b]) & boxes_meet(take(self.e, a), take(self.e, b), 2 * SNAP))
            yield a[close], b[close]

    def _places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where lines meet: the edge, the place on it, x and y; what an unlink takes out is left out."""
        found = []
        for a, b in self.pairs():
            index, t = cut_places(take(self.e, a), take(self.e, b))
            found.append((a[index], b[index], t))
        a, b, t = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        x, y = (self.e[f"{c}1"][a] + t * (self.e[f"{c}2"][a] - self.e[f"{c}1"][a]) for c in "xy")
        if self.matched.any():
            base = len(self.row)
            key = self.apart[:, 0] * base + self.apart[:, 1]
            order = np.argsort(key, kind="stable")
            ux, uy = self.spot_x[self.matched][order], self.spot_y[self.matched][order]
            mine = np.minimum(self.line[a], self.line[b]) * base + np.maximum(self.line[a], self.line[b])
            low, high = (np.searchsorted(key[order], mine, side) for side in ("left", "right"))
            gone = np.zeros(len(a), bool)
            for k, u in partners(low, high - low):
                gone[k[np.hypot(x[k] - ux[u], y[k] - uy[u]) <= self.tolerance]] = True
            a, t, x, y = a[~gone], t[~gone], x[~gone], y[~gone]
        return a, t, x, y

    def edges(self) -> tuple[np.ndarray, Ends, np.ndarray]:
        """Line, ends and length of the pieces between nodes."""
        a, t, x, y = self._places()
        inner = (t > EPS) & (t < 1 - EPS)
        source, parts = split(self.e, a[inner], t[inner])
        away = np.hypot(parts["x1"] - self.e["x1"][source], parts["y1"] - self.e["y1"][source])
        order = np.lexsort((away, source))
        source, parts = source[order], take(parts, order)
        line = self.line[source]
        # bends that are no cut don't end an edge
        code = _codes(np.concatenate([line, self.line[a]]), np.concatenate([parts["x1"], rounded(x)]), np.concatenate([parts["y1"], rounded(y)]))
        cut = np.isin(code[: len(line)], code[len(line) :])
        start = np.flatnonzero(np.append(True, np.diff(line) != 0)[: len(line)] | cut)
        end = np.append(start[1:], len(line))[: len(start)] - 1
        size = np.hypot(parts["x2"] - parts["x1"], parts["y2"] - parts["y1"])
        length = np.add.reduceat(size, start) if len(start) else size
        return line[start], {"x1": parts["x1"][start], "y1": parts["y1"][start], "x2": parts["x2"][end], "y2": parts["y2"][end]}, length

    def overlaps(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of lines that run along the same stretch; see `roads.overlaps`."""
        one, two = [], []
        for i, j in self.pairs():
            lower = self.number[self.line[i]] < self.number[self.line[j]]
            i, j = i[lower], j[lower]
            a, b = take(self.e, i), take(self.e, j)
            dx, dy = a["x2"] - a["x1"], a["y2"] - a["y1"]
            size = np.hypot(dx, dy)
            ends = [(b[f"x{k}"] - a["x1"], b[f"y{k}"] - a["y1"]) for k in "12"]
            off = [np.abs(cross(dx, dy, *v)) / size for v in ends]
            at = [(dx * x + dy * y) / size for x, y in ends]
            along = np.minimum(size, np.maximum(*at)) - np.maximum(0.0, np.minimum(*at))
            same = (off[0] <= SNAP) & (off[1] <= SNAP) & (along > SNAP)
            one.append(self.line[i[same]])
            two.append(self.line[j[same]])
        return _distinct(joined(one), joined(two), len(self.row))


def _status(rows: pa.RecordBatch, value: str) -> np.ndarray:
    return pc.equal(rows.column("road_status"), value).fill_null(False).to_numpy(zero_copy_only=False)


def _listed(rows: pa.RecordBatch, of: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The different features of rows for each number `of`, and these numbers."""
    known = rows.column("feature_id").is_valid().to_numpy(zero_copy_only=False)
    every = np.unique(of)
    of, row = of[known[row]], row[known[row]]
    order, new = _runs(of, rows.column("name").to_numpy()[row])
    of, row = of[order][new], row[order][new]
    ends = np.searchsorted(of, every, side="right")
    return every, pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), rows.column("feature_id").take(pa.array(row)))


def _warned(rows: pa.RecordBatch, group: np.ndarray, found: Network) -> Iterator[tuple[str, np.ndarray, pa.Array, pa.Array]]:
    """Code, projects, feature_ids and unlinks of each kind of warning."""
    line, e, _ = found.edges()
    n, of, row = len(line), found.of[line], found.row[line]
    node = _codes(np.tile(of, 2), np.concatenate([e["x1"], e["x2"]]), np.concatenate([e["y1"], e["y2"]]))
    label = labels(node[:n], node[n:], int(node.max(initial=-1)) + 1)[node[:n]]
    low, high = np.full(found.groups, n * 2), np.full(found.groups, -1)
    np.minimum.at(low, of, label)
    np.maximum.at(high, of, label)
    torn = (low != high)[of]
    yield "disconnected_road_network", *_listed(rows, of[torn], row[torn]), None
    old = np.zeros(2 * n + 1, bool)
    old[label[_status(rows, EXISTING)[row]]] = True
    new = _status(rows, PROPOSED)[row] & ~old[label] & rows.column("feature_id").is_valid().to_numpy(zero_copy_only=False)[row]
    parts, features = _listed(rows, label[new], row[new])
    project = np.zeros(2 * n + 1, np.int64)
    project[label] = of
    yield "proposed_roads_not_connected_to_existing", project[parts], features, None
    one, two = found.overlaps()
    both = found.row[np.stack([one, two], axis=1).ravel()]
    yield "overlapping_road_centerlines", found.of[one], pa.ListArray.from_arrays(np.arange(len(one) + 1, dtype=np.int32) * 2, rows.column("feature_id").take(pa.array(both))), None
    # points of one name that match two lines nowhere
    name, known = rows.column("name").to_numpy()[found.spots], rows.column("unlink_id").is_valid().to_numpy(zero_copy_only=False)[found.spots]
    code = _codes(found.spot_of, name)
    bad = np.flatnonzero(~known | ~np.isin(code, code[found.matched & known]))
    yield "invalid_road_unlink", found.spot_of[bad], None, rows.column("unlink_id").take(pa.array(found.spots[bad]))


def _weight(rows: pa.RecordBatch, group: np.ndarray) -> np.ndarray:
    """Points of each row; a project in which a line has several rings or features is never small."""
    geom = rows.column("geom")
    number = rows.column("lines").flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(geom)), np.diff(geom.offsets.to_numpy()))
    order, new = _runs(group[row], number)
    out = np.maximum(1, points(geom))
    out[row[order][~new]] = LOCAL + 1
    return out


def networks(batches: Iterator[pa.RecordBatch], form: str, tolerance: float, raw: list[pa.Field], made: list[pa.Field]) -> Iterator[pa.RecordBatch]:
    """Rows of RAW sorted by project -> `form` (edges or warnings) as columns `made`; rows of large projects come out as they were."""
    names = [*KEYS, *(f.name for f in made), *RAW, "large"]

    def out(rows: pa.RecordBatch, first: np.ndarray, cells: list) -> pa.RecordBatch:
        kept = [pa.nulls(len(first), f.type) for f in raw]
        return pa.RecordBatch.from_arrays([rows.column("project_id").take(pa.array(first)), *cells, *kept, pa.array(np.zeros(len(first), bool))], names=names)

    for rows, group in whole_groups(batches, KEYS, _weight, LOCAL):
        n = rows.num_rows
        if group is None:
            yield pa.RecordBatch.from_arrays([rows.column("project_id"), *(pa.nulls(n, f.type) for f in made), *(rows.column(c) for c in RAW), pa.array(np.ones(n, bool))], names=names)
            continue
        first = np.flatnonzero(np.append(True, np.diff(group) != 0))
        with np.errstate(all="ignore"):
            found = Network(rows, group, tolerance)
            if form == "edges":
                line, e, length = found.edges()
                row = found.row[line]
                yield out(rows, row, [*(rows.column(c).take(pa.array(row)) for c in ("feature_id", "road_status")), *(pa.array(e[c]) for c in ENDS), pa.array(length)])
                continue
            for code, of, features, unlink in _warned(rows, group, found):
                cells = [pa.array([code] * len(of), pa.string()), features, unlink]
                yield out(rows, first[of], [pa.nulls(len(of), f.type) if c is None else c for c, f in zip(cells, made, strict=True)])
