"""Which polygons are valid, and why the others are not.

Convex polygons of one ring are recognised where they are.  All others have
their edges split wherever edges of the same feature meet (a join by boxes in
each feature), and the pieces say it all: a piece that two edges share is a
fault, and the middle of any other piece lies inside, outside or on no other
ring, which tells how rings nest.  Unions and blocks leave out features whose
`is_valid` is false.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import geometry
from parcelwise.operators import overlay
from parcelwise.session import released, spread


def convex(geom: Column) -> Column:
    """Whether a geometry is one closed ring that turns one way all along, once around, with no two equal points in a row."""
    pts = F.get(geom, F.lit(0))["pts"]
    n = F.size(pts) - 1

    def turn(i: Column) -> Column:
        """The angle at the end of edge i; beyond a half turn where the edge has no length."""
        p, q, r = F.get(pts, i), F.get(pts, i + 1), F.get(pts, i % (n - 1) + F.when(i == n - 1, 1).otherwise(2))
        ax, ay, bx, by = q["x"] - p["x"], q["y"] - p["y"], r["x"] - q["x"], r["y"] - q["y"]
        return F.when((ax == 0) & (ay == 0), 9.0).otherwise(F.atan2(ax * by - ay * bx, ax * bx + ay * by))

    state = lambda low, high, total: F.struct(low.alias("low"), high.alias("high"), total.alias("total"))
    one_way = lambda s: ((s["low"] > -1e-12) | (s["high"] < 1e-12)) & (s["high"] < math.pi - 1e-6) & (s["low"] > 1e-6 - math.pi) & (F.abs(F.abs(s["total"]) - 2 * math.pi) < 1e-6)
    turns = F.transform(F.sequence(F.lit(0), n - 1), turn)
    round_ = F.aggregate(turns, state(F.lit(0.0), F.lit(0.0), F.lit(0.0)), lambda s, t: state(F.least(s["low"], t), F.greatest(s["high"], t), s["total"] + t), one_way)
    closed = F.get(pts, F.lit(0)) == F.get(pts, n)
    return F.when((F.size(geom) == 1) & (n >= 3), F.coalesce(closed & round_, F.lit(False))).otherwise(False)


def _shape_faults(features: DataFrame, keys: list[str]) -> DataFrame:
    points = lambda r: F.coalesce(F.size(r["pts"]), F.lit(0))
    ends = lambda r: (F.get(r["pts"], F.lit(0)), F.get(r["pts"], points(r) - 1))
    loose = F.exists("geom", lambda r: (points(r) < 4) | (ends(r)[0] != ends(r)[1]))
    fault = F.when(F.col("geom").isNull(), "null").when(F.size("geom") == 0, "empty").when(loose, "unclosed_ring").when(geometry.area(F.col("geom")).isNull(), "no_area")
    return features.select(*keys, "feature_id", fault.alias("fault")).filter("fault is not null")


def faults(features: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature_id, fault) of polygons; stored, as are the edges and their pieces on the way.

    null, empty, unclosed_ring, no_area; self_intersection: edges cross, or those of one ring touch;
    shared_edge: a stretch belongs to two edges; hole_outside, nested_holes, overlapping_parts: some
    stretch of a ring lies outside its shell, inside another hole, or inside another part.  Rings may
    touch in points; that several such points cut the interior in two is not looked for.
    """
    features = features.filter(~F.coalesce(convex(F.col("geom")), F.lit(False)))
    shape = _shape_faults(features, keys)
    own = [*keys, "of"]
    edges = spread(overlay.segments(features, keys))
    segs = edges.withColumn("of", F.col("feature_id")).withColumn("sid", F.struct("part", "ring", "seq"))
    pairs = overlay.neighbours(segs, segs, own, "sid").filter("a_sid <> b_sid")
    a, b = overlay.side("a"), overlay.side("b")
    same_ring = (F.col("a_sid.part") == F.col("b_sid.part")) & (F.col("a_sid.ring") == F.col("b_sid.ring"))
    # inside a ring segments may only share ends; different rings may touch, but not cross
    inner = F.exists(overlay.cut_places(a, b), lambda t: t.between(1e-9, 1 - 1e-9))
    crossed = pairs.filter(overlay.properly_cross(a, b) | (same_ring & inner))
    found = [crossed.select(*keys, F.col("of").alias("feature_id"), F.lit("self_intersection").alias("fault"))]

    cuts = pairs.select(*own, F.col("a_sid").alias("sid"), overlay.inner_cuts(a, b).alias("places")).filter(F.size("places") > 0)
    pieces = overlay.split_edges(segs, cuts, own, "sid")
    _, ends = overlay.canonical()
    used = spread(pieces.select(*own, "sid.part", "sid.ring", *(v.alias(k) for k, v in ends.items())).groupBy(*own, *ends).agg(F.count("*").alias("n"), F.min(F.struct("part", "ring")).alias("r")))
    found.append(used.filter("n > 1").select(*keys, F.col("of").alias("feature_id"), F.lit("shared_edge").alias("fault")))

    middle = lambda c: (F.col(f"{c}1") + F.col(f"{c}2")) / 2
    spots = used.filter("n = 1").select(*own, F.col("r.part").alias("part"), F.col("r.ring").alias("ring"), middle("x").alias("x"), middle("y").alias("y"))
    spots = spots.withColumn("point_id", F.struct("part", "ring", "x", "y"))
    part, ring = F.col("point_id.part"), F.col("point_id.ring")

    def faulty(points: DataFrame, rings: DataFrame, polygon: Column, wrong: Column, name: str) -> DataFrame:
        met = overlay.containing(points.select(*own, "point_id", "x", "y"), rings.withColumn("feature_id", polygon), own)
        return met.filter(wrong).select(*keys, F.col("of").alias("feature_id"), F.lit(name).alias("fault"))

    found.append(faulty(spots.filter("ring = 0"), segs, F.col("part"), F.col("polygon") != part, "overlapping_parts"))
    holes = spots.filter("ring > 0")
    found.append(faulty(holes, segs.filter("ring > 0"), F.struct("part", "ring"), (F.col("polygon.part") == part) & (F.col("polygon.ring") != ring), "nested_holes"))
    shells = overlay.containing(holes.select(*own, "point_id", "x", "y"), segs.filter("ring = 0").withColumn("feature_id", F.col("part")), own).filter(F.col("polygon") == part)
    outside = holes.join(shells.select(*own, "point_id"), [*own, "point_id"], "left_anti")
    found.append(outside.select(*keys, F.col("of").alias("feature_id"), F.lit("hole_outside").alias("fault")))
    every = found[0]
    for rows in found[1:]:
        every = every.union(rows)
    out = spread(shape.union(every.distinct()))
    released(edges, used)
    return out


def audited(features: DataFrame, keys: list[str]) -> DataFrame:
    """Features with is_valid and their sorted faults."""
    found = faults(features, keys).groupBy(*keys, "feature_id").agg(F.sort_array(F.collect_set("fault")).alias("faults"))
    return features.join(found, [*keys, "feature_id"], "left").withColumn("is_valid", F.col("faults").isNull())
