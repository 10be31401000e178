"""Street frontage of lots, and walking distances along the road network."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parcelwise.functions import geometry
from parcelwise.operators import meeting, overlay, small_frontage
from parcelwise.session import released, spread

REACH = 3.0
#: Largest side of a cell in the search for the nearest node.
NODE_CELL = 64.0


def _within(ax: str, ay: str, bx: str, by: str, edge: dict[str, Column], reach: float) -> Column:
    """struct(s, t): the part of the segment a-b, from 0 to 1, that lies within `reach` of an edge; null if none.

    The points near a segment form a strip and two discs, a convex shape: the
    part is one interval, the hull of its cuts with the three.
    """
    dx, dy = F.col(bx) - F.col(ax), F.col(by) - F.col(ay)
    ex, ey = edge["x2"] - edge["x1"], edge["y2"] - edge["y1"]
    wx, wy = F.col(ax) - edge["x1"], F.col(ay) - edge["y1"]
    size2 = ex * ex + ey * ey
    # p(t) = a + t d: its place along the edge and its distance from the edge's line, both linear in t
    along0, along1 = (wx * ex + wy * ey) / size2, (dx * ex + dy * ey) / size2
    off0, off1 = (ex * wy - ey * wx) / F.sqrt(size2), (ex * dy - ey * dx) / F.sqrt(size2)

    def span(value0: Column, value1: Column, low: float, high: float) -> tuple[Column, Column]:
        """Where value0 + t value1 lies between low and high."""
        flat = F.abs(value1) < 1e-12
        one, two = (low - value0) / value1, (high - value0) / value1
        inside = value0.between(low, high)
        return (F.when(flat, F.when(inside, F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least(one, two)), F.when(flat, F.when(inside, F.lit(1.0)).otherwise(F.lit(-1.0))).otherwise(F.greatest(one, two)))

    def disc(x: Column, y: Column) -> tuple[Column, Column]:
        px, py = F.col(ax) - x, F.col(ay) - y
        a, b, c = dx * dx + dy * dy, px * dx + py * dy, px * px + py * py - reach * reach
        root = b * b - a * c
        return F.when(root >= 0, (-b - F.sqrt(F.greatest(root, F.lit(0.0)))) / a).otherwise(F.lit(2.0)), F.when(root >= 0, (-b + F.sqrt(F.greatest(root, F.lit(0.0)))) / a).otherwise(F.lit(-1.0))

    first, second = span(off0, off1, -reach, reach), span(along0, along1, 0.0, 1.0)
    strip = (F.greatest(first[0], second[0]), F.least(first[1], second[1]))
    pieces = []
    for low, high in (strip, disc(edge["x1"], edge["y1"]), disc(edge["x2"], edge["y2"])):
        low, high = F.greatest(low, F.lit(0.0)), F.least(high, F.lit(1.0))
        pieces.append(F.when(low <= high, F.struct(low.alias("s"), high.alias("t"))))
    found = F.array_compact(F.array(*pieces))
    return F.when(F.size(found) > 0, F.struct(F.array_min(F.transform(found, lambda p: p["s"])).alias("s"), F.array_max(F.transform(found, lambda p: p["t"])).alias("t")))


def frontage_parts(lots: DataFrame, footprint: DataFrame, reach: float = REACH) -> DataFrame:
    """The parts of each lot's outline within `reach` of the road footprint (polygons): project_id, feature_id, part, ring, from
    and to (metres along the outline); stored.

    Projects of at most `small.LOCAL_PAIRS` points are done in numpy where they are dealt to, others by joins; rows without a project are left out.
    """
    of = {c: lots.schema[c].dataType for c in ("project_id", "feature_id")}
    types = {"feature_id": of["feature_id"], "road_id": footprint.schema["feature_id"].dataType, "geom": geometry.GEOMETRY, "road": "boolean"}

    def side(rows: DataFrame, road: bool) -> DataFrame:
        has = {"road_id" if road else "feature_id": F.col("feature_id"), "geom": F.col("geom"), "road": F.lit(road)}
        return rows.filter("project_id is not null and geom is not null").select(F.col("project_id").cast(of["project_id"]), *(has.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()), F.xxhash64("feature_id").alias("name"))

    rows = side(lots, False).union(side(footprint, True))
    made = [T.StructField("made_id", of["feature_id"]), *T.StructType.fromDDL("part int, ring int, `from` double, `to` double").fields]
    schema = T.StructType([rows.schema["project_id"], *made, *(T.StructField(c, rows.schema[c].dataType) for c in types), T.StructField("large", T.BooleanType())])
    found = spread(rows.repartition("project_id").sortWithinPartitions("project_id").mapInArrow(partial(small_frontage.frontages, reach=reach), schema))
    done = found.filter("not large").select("project_id", F.col("made_id").alias("feature_id"), "part", "ring", "from", "to")
    large = found.filter("large")
    if not large.limit(1).count():
        return done
    sides = [large.filter(F.col("road") == road).select("project_id", F.col(c).alias("feature_id"), "geom") for road, c in ((False, "feature_id"), (True, "road_id"))]
    return spread(done.unionByName(joined_frontage_parts(*sides, reach)))


def joined_frontage_parts(lots: DataFrame, footprint: DataFrame, reach: float = REACH) -> DataFrame:
    """`frontage_parts` of projects of any size, by joins; stored.  Only lots whose boxes come near the footprint's are looked at."""
    keys = ["project_id"]
    # what lies within reach of the footprint or in it has a box that comes as near
    near_ = meeting.pairs(meeting.boxes(lots, keys, reach), meeting.boxes(footprint, keys), keys)
    lots = lots.join(near_.select(*keys, F.col("a_feature_id").alias("feature_id")).distinct().hint("merge"), [*keys, "feature_id"], "left_semi")
    outline = overlay.segments(lots, keys).withColumn("size", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    order = Window.partitionBy("project_id", "feature_id").orderBy("part", "ring", "seq")
    outline = outline.withColumn("start", F.sum("size").over(order) - F.col("size")).withColumn("sid", F.struct("feature_id", "part", "ring", "seq"))
    outline = spread(outline)
    roads = spread(overlay.segments(footprint, keys).withColumn("sid", F.struct("feature_id", "part", "ring", "seq")))
    pairs = overlay.neighbours(outline, roads, keys, "sid", reach)
    near = pairs.withColumn("i", _within("a_x1", "a_y1", "a_x2", "a_y2", overlay.side("b"), reach)).filter("i is not null").select(*keys, F.col("a_sid").alias("sid"), "i.s", "i.t")
    # what lies inside the footprint: pieces between the crossings whose middle is inside
    cuts = pairs.select(*keys, F.col("a_sid").alias("sid"), F.explode(overlay.cut_places(overlay.side("a"), overlay.side("b"))).alias("c")).union(outline.select(*keys, "sid", F.explode(F.array(F.lit(0.0), F.lit(1.0))))).distinct()
    step = Window.partitionBy(*keys, "sid").orderBy("c")
    spans = cuts.withColumn("t", F.lead("c").over(step)).filter("t > c").join(outline.select(*keys, "sid", "x1", "y1", "x2", "y2"), [*keys, "sid"])
    middle = (F.col("c") + F.col("t")) / 2
    spots = spans.select(*keys, F.struct("sid", F.col("c").alias("s"), "t").alias("point_id"), (F.col("x1") + (F.col("x2") - F.col("x1")) * middle).alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * middle).alias("y"))
    inside = overlay.covered(spots, roads, keys).select(*keys, "point_id.sid", "point_id.s", "point_id.t")
    both = near.union(inside).join(outline.select(*keys, "feature_id", "sid", "start", "size"), [*keys, "sid"])
    metres = both.select(*keys, "feature_id", "sid.part", "sid.ring", (F.col("start") + F.col("s") * F.col("size")).alias("from"), (F.col("start") + F.col("t") * F.col("size")).alias("to"))
    # gaps and islands along each ring
    run = Window.partitionBy(*keys, "feature_id", "part", "ring").orderBy("from", "to")
    reached = F.max("to").over(run.rowsBetween(Window.unboundedPreceding, -1))
    marked = metres.withColumn("new", F.when(F.col("from") <= reached + 1e-7, 0).otherwise(1)).withColumn("island", F.sum("new").over(run))
    out = spread(marked.groupBy(*keys, "feature_id", "part", "ring", "island").agg(F.min("from").alias("from"), F.max("to").alias("to")).drop("island"))
    released(outline, roads)
    return out


def frontage_length(lots: DataFrame, footprint: DataFrame, reach: float = REACH, parts: DataFrame | None = None) -> DataFrame:
    """project_id, feature_id, value: 0 for lots that no street reaches, and for all where there is no footprint.

    `parts`: the frontage_parts of these lots or more, if at hand.
    """
    parts = frontage_parts(lots, footprint, reach) if parts is None else parts
    sums = parts.groupBy("project_id", "feature_id").agg(F.sum(F.col("to") - F.col("from")).alias("value"))
    return lots.select("project_id", "feature_id").join(sums, ["project_id", "feature_id"], "left").select("project_id", "feature_id", F.coalesce("value", F.lit(0.0)).alias("value"))


#: The indicators that need a lot's frontage, and of these the ones that a lot without any is left out of.
DISTANCES = ("lots.distance_to_green_area", "lots.distance_to_non_residential_use")
FRONTAGE = "lots.frontage_length"


def warnings(features: DataFrame, footprint: DataFrame, reach: float = REACH) -> DataFrame:
    """(project_id, indicator_code, code, severity, feature_id), a row for each lot that a warning names.

    no_road_footprint_for_frontage: all lots of a project without a usable footprint, and one row without
    a lot where it has none; lot_without_street_frontage: lots that no street reaches, left out of distances.
    Lots whose geometry can't be used are named by neither.
    """
    lots = features.filter((F.col("macroarea") == "lote") & overlay.usable(features))
    footprint = footprint.filter(overlay.usable(footprint))
    bare = features.select("project_id").distinct().join(footprint.select("project_id").distinct(), "project_id", "left_anti")
    unserved = bare.join(lots.select("project_id", "feature_id"), "project_id", "left")
    unreached = frontage_length(lots, footprint, reach).filter("value = 0")

    def said(rows: DataFrame, code: str, indicators: tuple[str, ...]) -> DataFrame:
        each = F.explode(F.array(*map(F.lit, indicators))).alias("indicator_code")
        return rows.select("project_id", each, F.lit(code).alias("code"), F.lit("info").alias("severity"), "feature_id")

    return said(unserved, "no_road_footprint_for_frontage", (FRONTAGE, *DISTANCES)).unionByName(said(unreached, "lot_without_street_frontage", DISTANCES))


def frontage_midpoints(lots: DataFrame, footprint: DataFrame, reach: float = REACH, parts: DataFrame | None = None) -> DataFrame:
    """project_id, feature_id, x, y: the middle of each lot's longest frontage; lots without one are left out."""
    parts = frontage_parts(lots, footprint, reach) if parts is None else parts
    best = parts.groupBy("project_id", "feature_id").agg(F.max(F.struct((F.col("to") - F.col("from")).alias("size"), (-F.col("from")).alias("back"), ((F.col("to") + F.col("from")) / 2).alias("middle"))).alias("b"))
    fronting = lots.join(best.select("project_id", "feature_id").hint("merge"), ["project_id", "feature_id"], "left_semi")
    outline = overlay.segments(fronting, ["project_id"]).withColumn("size", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    outline = outline.withColumn("start", F.sum("size").over(Window.partitionBy("project_id", "feature_id").orderBy("part", "ring", "seq")) - F.col("size"))
    rows = outline.join(best, ["project_id", "feature_id"]).filter((F.col("b.middle") >= F.col("start")) & (F.col("b.middle") <= F.col("start") + F.col("size")))
    t = (F.col("b.middle") - F.col("start")) / F.col("size")
    spot = F.struct((F.col("x1") + (F.col("x2") - F.col("x1")) * t).alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * t).alias("y"))
    return rows.groupBy("project_id", "feature_id").agg(F.min(F.struct("start", spot.alias("p"))).alias("f")).select("project_id", "feature_id", "f.p.x", "f.p.y")


def nearest_nodes(points: DataFrame, nodes: DataFrame, cell: float = NODE_CELL) -> DataFrame:
    """(project_id, feature_id, x, y) with the nearest node (nx, ny) of the project and its distance, of the lowest node on a tie.

    Rings of cells around a point widen until a node found is nearer than the
    ring's inner edge; only points that are not done go on, and doubling the
    cells bounds the rounds by the logarithm of the extent.
    """
    extent = nodes.groupBy("project_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    todo = points.join(extent, "project_id").withColumn("most", F.greatest(*(F.abs(F.col(a) - F.col(b)) for a, b in (("x", "x0"), ("x", "x1"), ("y", "y0"), ("y", "y1")))))
    done = None
    while True:
        n = nodes.select("project_id", F.col("x").alias("nx"), F.col("y").alias("ny"), F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
        around = [F.lit(k) for k in (-1, 0, 1)]
        here = todo.withColumn("i", F.explode(F.array(*around))).withColumn("j", F.explode(F.array(*around))).withColumn("cx", F.floor(F.col("x") / cell) + F.col("i")).withColumn("cy", F.floor(F.col("y") / cell) + F.col("j"))
        gap = F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))
        best = here.join(n.hint("merge"), ["project_id", "cx", "cy"]).groupBy("project_id", "feature_id").agg(F.min(F.struct(gap.alias("gap"), "nx", "ny")).alias("b"))
        found = spread(todo.join(best, ["project_id", "feature_id"], "left"))
        # within one cell's side all nodes have been seen
        sure = F.coalesce(F.col("b.gap") <= cell, F.lit(False)) | (F.col("most") <= cell)
        part = found.filter(sure & F.col("b").isNotNull()).select("project_id", "feature_id", "x", "y", "b.nx", "b.ny", F.col("b.gap").alias("last_mile"))
        done = part if done is None else done.unionByName(part)
        todo = found.filter(~sure).drop("b")
        if not todo.limit(1).count():
            return done
        cell *= 2


def network_distances(edges: DataFrame, origins: DataFrame, targets: DataFrame) -> DataFrame:
    """For each origin (project_id, feature_id, nx, ny, last_mile) the walking distance to the nearest target other than
    itself: last mile, shortest path, last mile.  Null where no target can be reached.

    All targets spread at once: a node keeps its two nearest targets of
    different ids, which is enough to leave one's own out; rounds go on from the
    nodes that changed, until none does, and are cut in the shared folder.
    """
    both = edges.select("project_id", "x1", "y1", "x2", "y2", "length").union(edges.select("project_id", "x2", "y2", "x1", "y1", "length"))
    steps = spread(both.groupBy("project_id", "x1", "y1", "x2", "y2").agg(F.min("length").alias("length")))
    state = spread(_best_two(targets.select("project_id", F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("feature_id").alias("target"), F.col("last_mile").alias("distance"))))
    front = state
    while True:
        moved = front.join(steps, (front["project_id"] == steps["project_id"]) & (F.col("x") == F.col("x1")) & (F.col("y") == F.col("y1"))).select(front["project_id"], F.col("x2").alias("x"), F.col("y2").alias("y"), "target", (F.col("distance") + F.col("length")).alias("distance"))
        new = spread(_best_two(state.union(moved)))
        front = spread(new.join(state.withColumnRenamed("distance", "before"), ["project_id", "x", "y", "target"], "left").filter("before is null or distance < before").drop("before"))
        state = new
        if not front.limit(1).count():
            break
    here = origins.select("project_id", "feature_id", F.col("nx").alias("x"), F.col("ny").alias("y"), "last_mile").join(state, ["project_id", "x", "y"], "left")
    other = F.when(F.col("target") != F.col("feature_id"), F.col("distance") + F.col("last_mile"))
    return here.groupBy("project_id", "feature_id").agg(F.min(other).alias("value"))


def _best_two(rows: DataFrame) -> DataFrame:
    """Of each node the two nearest targets, each once."""
    each = rows.groupBy("project_id", "x", "y", "target").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("project_id", "x", "y").orderBy("distance", "target")
    return each.withColumn("rank", F.row_number().over(order)).filter("rank <= 2").drop("rank")


def access_points(lots: DataFrame, footprint: DataFrame, edges: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """The middle of each lot's frontage with the network's nearest node, as nearest_nodes gives them."""
    spots = frontage_midpoints(lots, footprint, parts=parts)
    ends = edges.select("project_id", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("n")).select("project_id", "n.x", "n.y").distinct()
    return nearest_nodes(spots, ends)


def distances(lots: DataFrame, footprint: DataFrame, edges: DataFrame, is_target: Column, is_origin: Column, near: DataFrame | None = None) -> DataFrame:
    """Walking distance from the frontage of each origin lot to that of the nearest target (project_id, feature_id, value).

    `near`: the access_points of the lots, if at hand.
    """
    near = spread(access_points(lots, footprint, edges)) if near is None else near
    pick = lambda condition: near.join(lots.filter(condition).select("project_id", "feature_id"), ["project_id", "feature_id"], "left_semi")
    return network_distances(edges, pick(is_origin), pick(is_target))


def non_residential_distance(lots: DataFrame, footprint: DataFrame, edges: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """From residential and mixed lots to the nearest lot of another use; mixed lots count as targets, but never for themselves."""
    lot = F.col("macroarea") == "lote"
    return distances(lots, footprint, edges, lot & F.col("land_use").isNotNull() & (F.col("land_use") != "residencial"), lot & F.col("land_use").isin("residencial", "misto"), near)


def green_distance(lots: DataFrame, footprint: DataFrame, edges: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """From residential and mixed lots to the nearest green area's frontage."""
    return distances(lots, footprint, edges, F.col("macroarea") == "avl", (F.col("macroarea") == "lote") & F.col("land_use").isin("residencial", "misto"), near)
