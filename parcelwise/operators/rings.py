"""Rings and polygons from loose boundary edges, by pointer jumping over all groups at once.

Every edge names the edge after it.  Rounds of joins, each of which makes a
pointer four times as long, find an edge's ring and its place on it, so that a
boundary of n edges takes about log4(n) rounds and is never one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelwise.operators import overlay
from parcelwise.session import released, spread

ENDS = ("x1", "y1", "x2", "y2")


def _after(places: DataFrame, keys: list[str], clockwise: bool) -> DataFrame:
    """(keys, id, next): at each spot (x, y) the leaving edge that follows an arriving one in the order of their angles, round the spot."""
    spot = Window.partitionBy(*keys, "x", "y")
    turn = F.col("angle").desc() if clockwise else F.col("angle").asc()
    order = spot.orderBy(turn)
    leaving = F.when(F.col("leaves"), F.col("id"))
    later = F.first(leaving, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    first = F.first(leaving, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = places.withColumn("next", F.coalesce(later, first)).withColumn("rank", F.row_number().over(order)).filter(~F.col("leaves"))
    # an edge follows one other at most; at spots where a boundary is torn the rest end there
    alone = F.row_number().over(Window.partitionBy(*keys, "x", "y", "next").orderBy("rank"))
    return found.withColumn("next", F.when(alone == 1, F.col("next"))).select(*(k for k in keys if k != "ring"), "id", "next")


def _places(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Each edge at both its ends, with the angle at which it lies there."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    two = F.array(
        F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.atan2(dy, dx).alias("angle"), F.lit(True).alias("leaves")),
        F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), F.atan2(-dy, -dx).alias("angle"), F.lit(False).alias("leaves")),
    )
    return edges.select(*keys, "id", F.explode(two).alias("p")).select(*keys, "id", "p.*")


def _jumped(state: DataFrame, keys: list[str], joined: dict[str, Column]) -> DataFrame:
    """Every pointer `to` moved on by the pointer it names; `joined` says how columns meet those there (with `n_` before)."""
    there = state.select(*keys, F.col("id").alias("to"), F.col("to").alias("n_to"), *(F.col(c).alias(f"n_{c}") for c in joined))
    return state.join(there, [*keys, "to"], "left").select(*keys, "id", F.col("n_to").alias("to"), *(c.alias(name) for name, c in joined.items()))


def _labels(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, next, ring): the smallest id on an edge's closed way; edges on open ways are left out."""
    state = spread(links.select(*keys, "id", F.col("next").alias("to"), F.col("id").alias("ring")))
    low = {"ring": F.least("ring", "n_ring")}
    while True:
        new = spread(_jumped(_jumped(state, keys, low), keys, low))
        # where no window of edges has a smaller id than the one a quarter as long, all of a closed way agree
        moved = new.select(*keys, "id", "ring", "to").join(state.select(*keys, "id", F.col("ring").alias("old"), F.col("to").alias("was")), [*keys, "id"])
        going = moved.filter((F.col("ring") != F.col("old")) | (F.col("to").isNull() & F.col("was").isNotNull())).limit(1).count()
        released(state)
        state = new
        if not going:
            break
    out = spread(links.join(state.filter("to is not null").select(*keys, "id", "ring"), [*keys, "id"]))
    released(state)
    return out


def rings(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Boundary edges (keys, x1, y1, x2, y2), interior on the left, as closed rings.

    Adds ring (a number of the ring), seq (from 0, from its least edge on), start (metres from there)
    and ring_length.  Rings that touch in a corner are rings of their own; a ring never passes a corner
    twice.  Edges on no closed way are left out.
    """
    size = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    rows = edges.select(*keys, *(F.round(c, 6).alias(c) for c in ENDS)).filter("x1 <> x2 or y1 <> y2").distinct()
    rows = spread(rows.select(*keys, *ENDS, F.struct(*ENDS).alias("id"), size.alias("size")))
    # along the interior: from an arriving edge clockwise to the first that leaves
    found = _labels(_after(_places(rows, keys), keys, True), keys)
    spots = found.select(*keys, "id", "next", "ring", F.col("id.x2").alias("x"), F.col("id.y2").alias("y"))
    twice = spots.groupBy(*keys, "ring", "x", "y").agg(F.count("*").alias("n")).filter("n > 1")
    if twice.limit(1).count():
        # there it is parted along the outside instead
        places = _places(found.select(*keys, "id", "ring", *(F.col(f"id.{c}").alias(c) for c in ENDS)), [*keys, "ring"])
        parted = _after(places.join(twice.drop("n"), [*keys, "ring", "x", "y"], "left_semi"), [*keys, "ring"], False)
        links = found.select(*keys, "id", "next").join(parted.withColumnRenamed("next", "other"), [*keys, "id"], "left")
        again = _labels(links.select(*keys, "id", F.coalesce("other", "next").alias("next")), keys)
        released(found)
        found = again
    # cut before the ring's least edge, pointers run to its end and sum what lies there
    open_ = found.join(rows.select(*keys, "id", "size"), [*keys, "id"])
    state = spread(open_.select(*keys, "id", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("to"), F.lit(1).cast("bigint").alias("n"), F.col("size").alias("rest")))
    more = {"n": F.col("n") + F.coalesce("n_n", F.lit(0)), "rest": F.col("rest") + F.coalesce("n_rest", F.lit(0.0))}
    while state.filter("to is not null").limit(1).count():
        new = spread(_jumped(_jumped(state, keys, more), keys, more))
        released(state)
        state = new
    ranked = found.select(*keys, "id", "ring").join(state.select(*keys, "id", "n", "rest"), [*keys, "id"])
    whole = ranked.filter("id = ring").select(*keys, "ring", F.col("n").alias("total"), F.col("rest").alias("ring_length"))
    out = ranked.join(whole, [*keys, "ring"])
    place = F.greatest(F.lit(0.0), F.col("ring_length") - F.col("rest"))
    out = spread(out.select(*keys, F.xxhash64("ring").alias("ring"), (F.col("total") - F.col("n")).alias("seq"), "id.*", place.alias("start"), "ring_length"))
    released(rows, found, state)
    return out


def union_rings(features: DataFrame, keys: list[str]) -> DataFrame:
    """The rings of the union of each group's polygons: columns as in `rings`."""
    done, large = overlay.united(features, keys, "rings")
    return done if large is None else spread(done.unionByName(rings(overlay.joined_edges(large, keys), keys)))


def union_polygons(features: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, members, geom): the union of each group's usable polygons, and their number."""
    done, large = overlay.united(features, keys, "polygons")
    done = done.withColumnRenamed("shape", "geom")
    if large is None:
        return done
    counts = large.groupBy(*keys).agg(F.count("*").alias("members"))
    return spread(done.unionByName(counts.join(polygons(overlay.joined_edges(large, keys), keys), keys)))


def polygons(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, geom): the polygon, of one or several parts, that each group's boundary encloses.

    Rings that run counter-clockwise are shells, numbered by their least point; a hole belongs to the
    smallest shell that contains it.  A group without a closed ring has no row.
    """
    every = rings(edges, keys)
    # from the ring's first corner, for precision
    first = every.filter("seq = 0").select(*keys, "ring", F.col("x1").alias("x0"), F.col("y1").alias("y0"))
    around = overlay.cross(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("x2") - F.col("x0"), F.col("y2") - F.col("y0"))
    points = F.transform(F.sort_array(F.collect_list(F.struct("seq", F.col("x1").alias("x"), F.col("y1").alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    closed = F.concat(points, F.slice(points, 1, 1))
    shapes = spread(every.join(first, [*keys, "ring"]).groupBy(*keys, "ring").agg((F.sum(around) / 2).alias("area"), closed.alias("pts")))
    shells, holes = shapes.filter("area > 0"), shapes.filter("area < 0")
    owned = shells.select(*keys, F.col("ring").alias("shell"), F.lit(0).alias("hole"), "ring", "pts")
    if holes.limit(1).count():
        outline = every.join(shells.select(*keys, "ring"), [*keys, "ring"], "left_semi").select(*keys, F.col("ring").alias("feature_id"), *ENDS)
        spots = every.filter("seq = 0").join(holes.select(*keys, "ring"), [*keys, "ring"], "left_semi").select(*keys, F.col("ring").alias("point_id"), F.inline(F.filter(overlay.beside(), lambda s: s["side"] == "left")))
        inside = overlay.containing(spots, outline, keys)
        around_ = inside.join(shells.select(*keys, F.col("ring").alias("polygon"), "area"), [*keys, "polygon"])
        nearest = around_.groupBy(*keys, F.col("point_id").alias("ring")).agg(F.min_by("polygon", "area").alias("shell"))
        owned = owned.unionByName(holes.join(nearest, [*keys, "ring"]).select(*keys, "shell", F.lit(1).alias("hole"), "ring", "pts"))
    least = shells.select(*keys, F.col("ring").alias("shell"), F.array_min("pts").alias("corner"))
    rows = owned.join(least, [*keys, "shell"])
    part = F.dense_rank().over(Window.partitionBy(*keys).orderBy("corner", "shell")) - 1
    ring = F.row_number().over(Window.partitionBy(*keys, "shell").orderBy("hole", F.array_min("pts"), "ring")) - 1
    numbered = rows.select(*keys, F.struct(part.alias("part"), ring.alias("ring"), "pts").alias("r"))
    out = spread(numbered.groupBy(*keys).agg(F.sort_array(F.collect_list("r")).alias("geom")))
    released(every, shapes)
    return out
