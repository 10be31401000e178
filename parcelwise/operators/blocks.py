"""Perimeters and blocks: what follows from the union of polygons."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import geometry
from parcelwise.operators import overlay, rings, territory
from parcelwise.session import spread

#: A face up to GOOD metres scores 1, one of BAD or more scores WORST.
GOOD, BAD, WORST = 120.0, 250.0, 0.1
KEYS = ["project_id", "quadra_id"]
#: Sets of points of one size that don't pay for going through at once, and products of corners and edges that are held at once.
FEW, AT_ONCE = 8, 1 << 20


def compactness(area, length):
    return 4 * math.pi * area / (length * length)


def perimeter(features: DataFrame) -> DataFrame:
    """project_id, area, length and compactness of each project's dissolved perimeter."""
    return overlay.dissolved(features, ["project_id"]).withColumn("compactness", compactness(F.col("area"), F.col("length")))


def skipped(features: DataFrame) -> DataFrame:
    """Perimeter features that aren't valid polygons: a warning each."""
    return features.filter(~overlay.usable(features)).select("project_id", "feature_id", F.lit("perimeter_feature_skipped").alias("code"))


def _in_blocks(features: DataFrame) -> DataFrame:
    return features.filter((F.col("macroarea") == territory.LOT) & F.col("quadra_id").isNotNull())


def _lots(features: DataFrame) -> DataFrame:
    return _in_blocks(features).filter(overlay.usable(features))


def block_stats(features: DataFrame) -> DataFrame:
    """project_id, quadra_id, area, length, n_lots and compactness of the union of each block's lots."""
    lots = _lots(features)
    return _dissolved(lots, lots.groupBy(*KEYS).agg(F.count("*").alias("n_lots"))).withColumn("compactness", compactness(F.col("area"), F.col("length")))


def _dissolved(lots: DataFrame, sums: DataFrame) -> DataFrame:
    return overlay.dissolved(lots, KEYS).join(sums, KEYS)


Points = list[tuple[float, float]]


def hull(points: Points) -> Points:
    """The corners of the convex hull, counter-clockwise from the leftmost."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    out: Points = []
    for rows in (points, points[::-1]):
        chain: Points = []
        for p in rows:
            while len(chain) > 1:
                (ax, ay), (bx, by) = chain[-2], chain[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                chain.pop()
            chain.append(p)
        out += chain[:-1]
    return out


def _chains(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's points in order, those on the chain that turns left, as indexes, and their number."""
    rows, kept = np.arange(len(x)), np.zeros(x.shape, np.int64)
    top = np.zeros(len(x), np.int64)
    for k in range(x.shape[1]):
        own = rows[top > 1]
        while len(own):
            a, b = kept[own, top[own] - 2], kept[own, top[own] - 1]
            ax, ay = x[own, a], y[own, a]
            own = own[~((x[own, b] - ax) * (y[own, k] - ay) - (y[own, b] - ay) * (x[own, k] - ax) > 0)]
            top[own] -= 1
            own = own[top[own] > 1]
        kept[rows, top] = k
        top += 1
    return kept, top


def hulls(x: np.ndarray, y: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`hull` of each group's points (at least one): x and y of all corners, group by group, and the groups' numbers of them.

    Groups of equally many points go through at once; a number that few have goes through alone.
    """
    order = np.lexsort((y, x, group))
    x, y, group = x[order], y[order], group[order]
    new = np.append(True, (np.diff(group) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0))[: len(x)]
    x, y = x[new], y[new]
    size = np.bincount(group[new], minlength=groups)
    begin = np.cumsum(size) - size
    count, picked, owner = size.copy(), [], []
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        at = begin[own][:, None] + np.arange(n)
        if n < 3:
            picked.append(at.ravel())
            owner.append(np.repeat(own, n))
        elif len(own) < FEW:
            for g, places in zip(own.tolist(), at, strict=True):
                corners = hull(list(zip(x[places].tolist(), y[places].tolist(), strict=True)))
                place = {p: k for p, k in zip(zip(x[places].tolist(), y[places].tolist(), strict=True), places.tolist(), strict=True)}
                picked.append(np.array([place[p] for p in corners]))
                owner.append(np.full(len(corners), g))
                count[g] = len(corners)
        else:
            sides = []
            for way in (at, at[:, ::-1]):
                kept, top = _chains(x[way], y[way])
                sides.append((np.take_along_axis(way, kept, axis=1), np.arange(n) < top[:, None] - 1))
            both, real = (np.concatenate(side, axis=1) for side in zip(*sides, strict=True))
            picked.append(both[real])
            count[own] = real.sum(axis=1)
            owner.append(np.repeat(own, count[own]))
    if not picked:
        return x, y, count
    picked, owner = np.concatenate(picked), np.concatenate(owner)
    picked = picked[np.argsort(owner, kind="stable")]
    return x[picked], y[picked], count


def _smallest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """`smallest_rectangle` of hulls of equally many corners, a row each."""
    if x.shape[1] < 2:
        return np.zeros((len(x), 3))
    ex, ey = np.roll(x, -1, axis=1) - x, np.roll(y, -1, axis=1) - y
    size = np.hypot(ex, ey)
    ux, uy = ex / size, ey / size
    along = np.ptp(x[:, None] * ux[:, :, None] + y[:, None] * uy[:, :, None], axis=2)
    over = np.ptp(y[:, None] * ux[:, :, None] - x[:, None] * uy[:, :, None], axis=2)
    area = along * over
    best, least = np.zeros(len(x), np.int64), area[:, 0].copy()
    for k in range(1, x.shape[1]):
        less = area[:, k] < least - 1e-9 * np.maximum(least, 1)
        best[less], least[less] = k, area[less, k]
    a, b, ux, uy = (np.take_along_axis(v, best[:, None], axis=1)[:, 0] for v in (along, over, ux, uy))
    square = np.abs(a - b) <= 1e-9 * np.maximum(a, b)  # a square: the edge nearer to east and west
    own = (a > b + 1e-9) & ~square | square & ((np.abs(ux) >= np.abs(uy)) | (a > b + 1e-9))
    turn = np.degrees(np.arctan2(np.where(own, ux, -uy), np.where(own, uy, ux))) % 180
    return np.stack([np.maximum(a, b), np.minimum(a, b), np.minimum(turn, 180 - turn)], axis=1)


def smallest_rectangles(x: np.ndarray, y: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(long, short, degrees of the long edge from the north, 0 to 90) of the rectangle of least area around each hull."""
    begin, out = np.cumsum(count) - count, np.zeros((len(count), 3))
    for n in np.unique(count[count > 0]).tolist():
        own = np.flatnonzero(count == n)
        step = max(1, AT_ONCE // (n * n))
        for some in (own[k : k + step] for k in range(0, len(own), step)):
            at = begin[some][:, None] + np.arange(n)
            out[some] = _smallest(x[at], y[at])
    return out


def smallest_rectangle(points: np.ndarray | Points) -> tuple[float, float, float]:
    """`smallest_rectangles` of one set of points."""
    x, y = np.array(points, float).reshape(-1, 2).T
    return tuple(smallest_rectangles(*hulls(x, y, np.zeros(len(x), np.int64), 1))[0].tolist())


_HULL = "project_id bigint, quadra_id string, xs array<double>, ys array<double>"
_SIDES = "project_id bigint, quadra_id string, long_side double, short_side double, orientation double"


def _points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x and y of all points of a batch, and their row."""
    size = pc.list_value_length(batch.column("xs")).to_numpy(zero_copy_only=False)
    return *(pc.list_flatten(batch.column(c)).to_numpy(zero_copy_only=False) for c in ("xs", "ys")), np.repeat(np.arange(batch.num_rows), size)


def _hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hull of each block's points among a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        code = np.zeros(batch.num_rows, np.int64)
        for c in KEYS:
            found = pc.dictionary_encode(batch.column(c), null_encoding="encode")
            code = code * len(found.dictionary) + found.indices.to_numpy()
        _, first, group = np.unique(code, return_index=True, return_inverse=True)
        x, y, row = _points(batch)
        x, y, count = hulls(x, y, group[row], len(first))
        ends = pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (x, y)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(first)) for c in KEYS), *lists], names=[*KEYS, "xs", "ys"])


def _rectangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = smallest_rectangles(*hulls(*_points(batch), batch.num_rows))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEYS), *(pa.array(v) for v in found.T)], names=[*KEYS, "long_side", "short_side", "orientation"])


def block_rectangles(features: DataFrame) -> DataFrame:
    """The smallest rotated rectangle of each block: long_side, short_side, orientation and the score of its face.

    A hull of hulls is the hull: each batch sends only its blocks' corners, and
    batches of many blocks are measured at once.
    """
    xs, ys = F.flatten(F.transform("geom", lambda r: r["pts"]["x"])), F.flatten(F.transform("geom", lambda r: r["pts"]["y"]))
    partial_ = _lots(features).select(*KEYS, xs.alias("xs"), ys.alias("ys")).mapInArrow(_hulls, _HULL)
    whole = partial_.groupBy(*KEYS).agg(F.flatten(F.collect_list("xs")).alias("xs"), F.flatten(F.collect_list("ys")).alias("ys"))
    found = whole.mapInArrow(_rectangles, _SIDES)
    side = F.col("long_side")
    score = F.when(side <= GOOD, 1.0).when(side >= BAD, WORST).otherwise(1 - (side - GOOD) / (BAD - GOOD) * (1 - WORST))
    return found.withColumn("face_score", score).withColumn("out_of_compliance", side > BAD)


def warnings(features: DataFrame) -> DataFrame:
    """(project_id, indicator_code, code, severity, quadra_id, feature_id): a row for each lot of a block whose long side is over the limit."""
    lots = _lots(features).select("project_id", "quadra_id", "feature_id")
    over = block_rectangles(features).filter("out_of_compliance").select("project_id", "quadra_id")
    said = {"indicator_code": "quadras.face_length_score", "code": "block_face_out_of_compliance", "severity": "warning"}
    return lots.join(over, ["project_id", "quadra_id"], "left_semi").withColumns({k: F.lit(v) for k, v in said.items()}).select("project_id", *said, "quadra_id", "feature_id")


def parceling_efficiency(features: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Resolved lot area over the block's geometric area (of `stats`, the block_stats, if at hand)."""
    lots = _lots(features)
    sums = territory.measured(lots).groupBy(*KEYS).agg(F.sum("area").alias("lots"))
    rows = _dissolved(lots, sums) if stats is None else stats.join(sums, KEYS)
    return rows.select(*KEYS, (F.col("lots") / F.col("area")).alias("value"))


def derive_blocks(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A feature for each block, with its lot count and the polygon of its lots' union, and the lots with their parent."""
    keys = ["project_id", "quadra_id"]
    shapes = rings.union_polygons(_in_blocks(features), keys).withColumnRenamed("members", "quantidade_lotes")
    kind = F.when(F.element_at("geom", -1)["part"] > 0, "MultiPolygon").otherwise("Polygon")
    made = spread(shapes.withColumns({"block_id": F.concat_ws("/", F.col("project_id").cast("string"), "quadra_id"), "geom_type": kind}))
    linked = features.join(made.select(*keys, "block_id"), keys, "left")
    own = (F.col("macroarea") == territory.LOT) & F.col("block_id").isNotNull()
    children = linked.withColumn("parent_feature_id", F.when(own, F.col("block_id"))).withColumn("relation_method", F.when(own, "attribute").otherwise("unresolved")).drop("block_id")
    return made, children
