"""Segments, grid-cell joins, and the union of polygons by its edges.

Nothing here builds a geometry object: all is equi-joins on (group, cell) and
sums.  A segment lies in the cells of its bounding box; long segments are first
cut, so that their cells are those along the line and not those of its box.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parcelwise.functions import geometry
from parcelwise.operators import meeting, pairwise, small
from parcelwise.session import released, spread

CELL = 32.0
#: Cells of the point search: LEVELS sizes, each SPREAD times the one before.
LEVELS, SPREAD = 3, 32
#: Coordinates closer than this are the same point.
SNAP = 1e-6
EPS = 1e-9
#: Columns of the forms of a union, see `united`.
ENDS = "x1 double, y1 double, x2 double, y2 double"
FORMS = {"edges": ENDS, "rings": f"ring bigint, seq bigint, start double, ring_length double, {ENDS}", "polygons": f"members bigint, shape {geometry.GEOMETRY}"}


def segments(features: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, feature_id, part, ring, seq and the ends x1, y1, x2, y2 of every edge; edges without length are left out."""
    rows = features.select(*keys, "feature_id", F.explode(geometry.edges(F.col("geom"))).alias("e")).select(*keys, "feature_id", "e.*")
    return rows.filter("x1 <> x2 or y1 <> y2")


def cross(ax, ay, bx, by) -> Column:
    return ax * by - ay * bx


def cut_places(a: dict[str, Column], b: dict[str, Column], tolerance: float = SNAP) -> Column:
    """array<double>: where, from 0 to 1 along segment a, segment b crosses it or has an end on it."""
    dx, dy, ex, ey = a["x2"] - a["x1"], a["y2"] - a["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"]
    wx, wy = b["x1"] - a["x1"], b["y1"] - a["y1"]
    size2 = dx * dx + dy * dy
    det = cross(dx, dy, ex, ey)
    parallel = F.abs(det) <= EPS * F.sqrt(size2 * (ex * ex + ey * ey))
    t, u = cross(wx, wy, ex, ey) / det, cross(wx, wy, dx, dy) / det
    meets = ~parallel & t.between(-EPS, 1 + EPS) & u.between(-EPS, 1 + EPS)

    def end(x: Column, y: Column) -> Column:
        """The place of an end of b on a, if it lies there."""
        place = ((x - a["x1"]) * dx + (y - a["y1"]) * dy) / size2
        off = F.abs(cross(dx, dy, x - a["x1"], y - a["y1"])) / F.sqrt(size2)
        return F.when((off <= tolerance) & place.between(0, 1), place)

    return F.array_compact(F.array(F.when(meets, t), end(b["x1"], b["y1"]), end(b["x2"], b["y2"])))


def inner_cuts(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Those of `cut_places` that split segment a, its ends left out."""
    return F.filter(cut_places(a, b), lambda t: (t > EPS) & (t < 1 - EPS))


def side(prefix: str) -> dict[str, Column]:
    return {k: F.col(f"{prefix}_{k}") for k in ("x1", "y1", "x2", "y2")}


def neighbours(rows: DataFrame, other: DataFrame, keys: list[str], id_: str, reach: float = 0.0) -> DataFrame:
    """Pairs of segments of one group whose boxes meet: columns a_* of `rows` and b_* of `other`."""
    return meeting.segment_pairs(rows, other, keys, id_, reach)


def split_edges(rows: DataFrame, cuts: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """Segments split at `places` (keys, id_, places: array) of `cuts`; ends are snapped to a grid of SNAP."""
    all_cuts = cuts.groupBy(*keys, id_).agg(F.flatten(F.collect_list("places")).alias("places"))
    joined = rows.join(all_cuts.hint("merge"), [*keys, id_], "left")
    inner = F.filter("places", lambda t: (t > EPS) & (t < 1 - EPS))
    stops = F.sort_array(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), inner)))
    parts = F.transform(F.sequence(F.lit(0), F.size("stops") - 2), lambda i: F.struct(F.get("stops", i).alias("s"), F.get("stops", i + 1).alias("t")))
    at = lambda a, b, t: F.round(F.when(t == 0, F.col(a)).when(t == 1, F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * t), 6)
    # most edges are not cut
    parts = F.when(F.col("places").isNull(), F.array(F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")))).otherwise(parts)
    out = joined.withColumn("stops", stops).withColumn("part_", F.explode(parts))
    s, t = F.col("part_.s"), F.col("part_.t")
    out = out.withColumns({"u1": at("x1", "x2", s), "v1": at("y1", "y2", s), "u2": at("x1", "x2", t), "v2": at("y1", "y2", t)})
    out = out.drop("x1", "y1", "x2", "y2", "places", "stops", "part_").withColumnsRenamed({"u1": "x1", "v1": "y1", "u2": "x2", "v2": "y2"})
    return out.filter("x1 <> x2 or y1 <> y2")


def _lanes(edges: DataFrame, keys: list[str]) -> DataFrame:
    """What of a polygon lies in a strip of y: its edges there, and the cells (level, cx) that they span.

    A wide lane takes wide cells, so that it has at most SPREAD + 2 of them, up
    to a width of CELL * SPREAD ** LEVELS.
    """
    strip = lambda y: F.floor(y / CELL)
    rows = edges.withColumn("strip", F.explode(F.sequence(strip(F.least("y1", "y2")), strip(F.greatest("y1", "y2")))))
    ends = F.min(F.least("x1", "x2")).alias("low"), F.max(F.greatest("x1", "x2")).alias("high")
    lanes = rows.groupBy(*keys, "strip", F.col("feature_id").alias("polygon")).agg(*ends, F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    level, width = F.lit(LEVELS - 1), F.col("high") - F.col("low")
    for k in reversed(range(LEVELS - 1)):
        level = F.when(width <= CELL * SPREAD ** (k + 1), k).otherwise(level)
    lanes = lanes.withColumn("level", level)
    cell = CELL * F.pow(F.lit(float(SPREAD)), F.col("level"))
    return lanes.withColumn("cx", F.explode(F.sequence(F.floor((F.col("low") - SNAP) / cell), F.floor((F.col("high") + SNAP) / cell))))


def containing(points: DataFrame, edges: DataFrame, keys: list[str], on_edge: bool = False) -> DataFrame:
    """(keys, point_id, polygon): the polygons of its group in which a point (x, y) lies, by the parity of edges to its right.

    A point meets only polygons whose edges, in its strip of y, span its cell of
    x, and of those only the edges in the strip; each such polygon once.
    """
    sizes = F.array(*(F.struct(F.lit(k).alias("level"), F.floor(F.col("x") / (CELL * SPREAD**k)).alias("cx")) for k in range(LEVELS)))
    spots = points.select(*keys, "point_id", "x", "y", F.floor(F.col("y") / CELL).alias("strip"), F.inline(sizes))
    met = spots.join(_lanes(edges, keys).hint("merge"), [*keys, "strip", "level", "cx"]).filter(F.col("x").between(F.col("low") - SNAP, F.col("high") + SNAP))
    x, y = F.col("x"), F.col("y")

    def hit(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        return spans & (x < e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.when(spans, e["y2"] - e["y1"]))

    def touching(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        place = ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / (dx * dx + dy * dy)
        return (F.abs(cross(dx, dy, x - e["x1"], y - e["y1"])) <= SNAP * F.hypot(dx, dy)) & place.between(-EPS, 1 + EPS)

    inside = F.size(F.filter("edges", hit)) % 2 == 1
    return met.filter(inside | F.exists("edges", touching) if on_edge else inside).select(*keys, "point_id", "polygon")


def covered(points: DataFrame, edges: DataFrame, keys: list[str], on_edge: bool = False) -> DataFrame:
    """(keys, point_id) of the points that lie in some polygon of their group."""
    return containing(points, edges, keys, on_edge).select(*keys, "point_id").distinct()


def usable(polygons: DataFrame) -> Column:
    """Polygons with an area (`geometric`, if it is at hand), and if they have been audited (`is_valid`), only valid ones."""
    area = (F.col("geometric") if "geometric" in polygons.columns else geometry.area(F.col("geom"))).isNotNull()
    return area & F.col("is_valid") if "is_valid" in polygons.columns else area


def _outlines(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feature_id, edges and box of polygons, their interior on the left: shells run counter-clockwise, holes clockwise.

    An edge is (sid, x1, y1, x2, y2); edges without length are left out.
    """
    turned = lambda r: (geometry.ring_area(r["pts"]) < 0) == (r["ring"] == 0)
    rings = F.transform("geom", lambda r: F.struct(r["part"].alias("part"), r["ring"].alias("ring"), F.when(turned(r), F.reverse(r["pts"])).otherwise(r["pts"]).alias("pts")))
    flat = polygons.select(*keys, "feature_id", F.inline(F.array(F.struct(geometry.edges(rings).alias("all"), geometry.bounds(F.col("geom")).alias("b")))))
    real = F.filter("all", lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))
    named = F.transform(real, lambda e: F.struct(F.xxhash64("feature_id", e["part"], e["ring"], e["seq"]).alias("sid"), *(e[c].alias(c) for c in ("x1", "y1", "x2", "y2"))))
    return flat.select(*keys, "feature_id", named.alias("edges"), *(F.col(f"b.{c[1:]}").alias(c) for c in meeting.BOX))


def canonical() -> tuple[Column, dict[str, Column]]:
    """Whether a segment runs against the order of its ends, and its ends in that order."""
    flip = (F.col("x1") > F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2")))
    return flip, {c: F.when(flip, F.col(o)).otherwise(F.col(c)) for c, o in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))}


def _reversed(turn: Column) -> list[Column]:
    return [F.when(turn, F.col(o)).otherwise(F.col(c)).alias(c) for c, o in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]


def _overlapping(outlines: DataFrame, keys: list[str]) -> DataFrame:
    """Groups in which the boxes of two polygons overlap by more than an edge: where none do, interiors are apart."""
    boxes = meeting.leveled(outlines.select(*keys, "feature_id", *meeting.BOX))
    met = meeting.pairs(boxes, boxes, keys).filter("a_feature_id < b_feature_id")
    over = F.lit(True)
    for c in "xy":
        # both boxes are a hair wider than their polygons
        over = over & (F.least(f"a_b{c}1", f"b_b{c}1") - F.greatest(f"a_b{c}0", f"b_b{c}0") > 4 * SNAP)
    return met.filter(over).select(*keys).distinct()


def _odd_edges(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The boundary of polygons whose interiors are apart: what two of them share runs both ways and cancels."""
    flip, ends = canonical()
    net = parts.select(*keys, F.when(flip, -1).otherwise(1).alias("way"), *(v.alias(k) for k, v in ends.items())).groupBy(*keys, *ends).agg(F.sum("way").alias("net"))
    return net.filter("net <> 0").select(*keys, *_reversed(F.col("net") < 0))


def _single_edges(parts: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The boundary of polygons that may overlap: sub-edges of which exactly one side is covered."""
    _, ends = canonical()
    distinct = parts.select(*keys, *(v.alias(k) for k, v in ends.items())).distinct().withColumn("edge", F.xxhash64("x1", "y1", "x2", "y2"))
    points = distinct.withColumn("s", F.explode(beside())).select(*keys, F.struct("edge", "s.side").alias("point_id"), "s.x", "s.y")
    inside = covered(points, rows, keys).groupBy(*keys, F.col("point_id.edge").alias("edge")).agg(F.count("*").alias("n"), F.max(F.col("point_id.side")).alias("only")).filter("n = 1")
    return distinct.join(inside, [*keys, "edge"]).select(*keys, *_reversed(F.col("only") == "right"))


def beside() -> Column:
    """array<struct<side, x, y>>: the middle of a segment, moved a little to its left and to its right."""
    size = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    step = F.least(F.lit(1e-4), size / 4)
    nx, ny = -(F.col("y2") - F.col("y1")) / size * step, (F.col("x2") - F.col("x1")) / size * step
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return F.array(F.struct(F.lit("left").alias("side"), (mx + nx).alias("x"), (my + ny).alias("y")), F.struct(F.lit("right").alias("side"), (mx - nx).alias("x"), (my - ny).alias("y")))


def united(polygons: DataFrame, keys: list[str], form: str) -> tuple[DataFrame, DataFrame | None]:
    """Unions of each group's polygons as edges, rings or polygons (columns of `small.FORMS`; stored), and the polygons of groups too large for one task, if any.

    Groups of at most `small.LOCAL` points are done in numpy where they are dealt to; rows without a key are left out.
    """
    # whether a polygon is `usable` by its area is seen in numpy
    rows = polygons.filter(reduce(Column.__and__, (F.col(k).isNotNull() for k in (*keys, "geom")), F.col("is_valid") if "is_valid" in polygons.columns else F.lit(True)))
    rows = rows.select(*keys, "feature_id", F.xxhash64("feature_id").alias("polygon"), F.col("geom").cast(geometry.GEOMETRY).alias("geom"), F.lit(True).alias("judged"))
    same = [rows.schema[c] for c in ("feature_id", "geom")]
    schema = T.StructType([*(rows.schema[k] for k in keys), *T.StructType.fromDDL(FORMS[form]).fields, *(T.StructField(f.name, f.dataType) for f in same)])
    found = spread(rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(partial(small.dissolve, keys=keys, form=form), schema))
    large = found.filter("geom is not null").select(*keys, "feature_id", "geom")
    return found.filter("geom is null").drop("feature_id", "geom"), large if large.limit(1).count() else None


def union_edges(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """The boundary of the union of each group's polygons: edges with the interior on their left; stored."""
    done, large = united(polygons, keys, "edges")
    return done if large is None else spread(done.unionByName(joined_edges(large, keys)))


def joined_edges(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """`union_edges` of usable polygons of groups of any size, by joins.

    Edges are split where they meet those of other polygons of the group.  In a
    group whose polygons lie in boxes apart from each other, shared sub-edges
    cancel; in others a sub-edge is on the boundary if exactly one of its sides
    is covered.  The edges are stored.
    """
    outlines = spread(_outlines(polygons, keys))
    rows = outlines.select(*keys, "feature_id", F.inline("edges"))
    bundles = meeting.bundles(outlines.select(*keys, "feature_id", "edges"), keys)
    met = meeting.pairs(bundles, bundles, keys).filter("a_feature_id <> b_feature_id").select(*keys, "a_edges", "b_edges")
    schema = T.StructType([*met.select(*keys).schema.fields, T.StructField("sid", T.LongType()), T.StructField("places", T.ArrayType(T.DoubleType()))])
    cuts = met.mapInArrow(partial(pairwise.cuts, columns=keys), schema)
    parts = spread(split_edges(rows, cuts, keys, "sid"))
    over = spread(_overlapping(outlines, keys))
    if over.limit(1).count():
        apart = _odd_edges(parts.join(over, keys, "left_anti"), keys)
        out = spread(apart.unionByName(_single_edges(parts.join(over, keys, "left_semi"), rows.join(over, keys, "left_semi"), keys)))
    else:
        out = spread(_odd_edges(parts, keys))
    released(outlines, parts, over)
    return out


def union_measures(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Area and length of a boundary: plain sums over its edges."""
    area = F.sum(cross(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))) / 2
    return edges.groupBy(*keys).agg(area.alias("area"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length"))


def dissolved(features: DataFrame, keys: list[str]) -> DataFrame:
    """Area and length of the union of each group; rows without a group key are left out."""
    rows = features
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    return union_measures(union_edges(rows, keys), keys)


def _spans(features: DataFrame) -> Column:
    """Whether a feature covers an area: by its geom_type, or where there is none by its area."""
    return F.col("geom_type").isin("Polygon", "MultiPolygon") if "geom_type" in features.columns else geometry.area(F.col("geom")).isNotNull()


def _edges_and_dots(features: DataFrame) -> Column:
    """The edges of a feature, and the points of point features as edges of almost no length."""
    edges = F.filter(geometry.edges(F.col("geom")), lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))
    if "geom_type" not in features.columns:
        return edges
    at = lambda r: F.get(r["pts"], F.lit(0))
    dot = lambda r: F.struct(r["part"].alias("part"), r["ring"].alias("ring"), F.lit(0).alias("seq"), at(r)["x"].alias("x1"), at(r)["y"].alias("y1"), (at(r)["x"] + 1e-9).alias("x2"), at(r)["y"].alias("y2"))
    return F.concat(edges, F.transform(F.filter("geom", lambda r: F.size(r["pts"]) == 1), dot))


def related(targets: DataFrame, sources: DataFrame, keys: list[str], relation: str, distance: float = 0.0) -> DataFrame:
    """Target features (keys, feature_id) that stand in a relation to some source of their group.

    `intersects`, `contains` (the target contains a source), `within`, `dwithin`.
    Features with a geom_type may be polygons, lines or points, others are polygons.
    """
    if relation in ("intersects", "dwithin"):
        return _near(targets, sources, keys, distance if relation == "dwithin" else 0.0)
    hold, held, name = (targets, sources, "outer") if relation == "contains" else (sources, targets, "inner")
    return holding(hold, held, keys).select(*keys, F.col(name).alias("feature_id")).distinct()


def _shapes(features: DataFrame, keys: list[str]) -> DataFrame:
    """Features with `solid`, and a shape that equal geometries of a group share."""
    kind = F.col("geom_type") if "geom_type" in features.columns else F.lit("Polygon")
    return features.filter("geom is not null").select(*keys, "feature_id", "geom", kind.alias("geom_type"), F.struct(F.xxhash64("geom"), F.hash("geom")).alias("shape"))


def _distinct_shapes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `_shapes`, each shape once: keys, feature_id (the shape), solid and edges."""
    each = rows.groupBy(*keys, F.col("shape").alias("feature_id")).agg(F.any_value("geom").alias("geom"), F.any_value("geom_type").alias("geom_type"))
    return each.select(*keys, "feature_id", F.inline(F.array(F.struct(_spans(each).alias("solid"), _edges_and_dots(each).alias("edges")))))


def _near(targets: DataFrame, sources: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Targets that come within `reach` of a source, or lie in one, or have one in them.

    Equal geometries are tested once, so that a heap of copies makes one pair.  Two features are
    near if two of their edges are, or if a part of one begins inside the other; a polygon of one run
    is tested where it meets (in numpy, see `pairwise`), larger ones by strips.
    """
    shapes = [_shapes(x, keys) for x in (targets, sources)]
    sides = [_distinct_shapes(x, keys) for x in shapes]
    a, b = (spread(meeting.edge_runs(x, keys, r, ["solid"])) for x, r in zip(sides, (reach, 0.0), strict=True))
    known = [x.select(F.lit(k).alias("side"), "level", (F.col("solid") & ~F.col("whole")).alias("large")).distinct() for k, x in enumerate((a, b))]
    found = known[0].union(known[1]).collect()
    levels = [sorted({r["level"] for r in found if r["side"] == k}) for k in (0, 1)]
    met = meeting.pairs(a, b, keys, levels).select(*keys, "a_feature_id", *(f"{p}_{c}" for p in "ab" for c in ("edges", "solid", "whole", *meeting.BOX)))
    columns = [*keys, "a_feature_id"]
    hits = met.mapInArrow(partial(pairwise.near, columns=columns, reach=reach), met.select(*columns).schema).select(*keys, F.col("a_feature_id").alias("shape"))
    for k, mine in ((0, True), (1, False)):
        # polygons of several runs: in which of them does a part of the other side begin?
        if any(r["large"] for r in found if r["side"] == k):
            large = sides[k].filter("solid").select(*keys, "feature_id", F.explode("edges").alias("e")).select(*keys, "feature_id", "e.*")
            heads = sides[1 - k].select(*keys, F.col("feature_id").alias("of"), F.explode(F.filter("edges", lambda e: (e["seq"] == 0) & (e["ring"] == 0))).alias("e"))
            heads = heads.select(*keys, F.struct("of", "e.part").alias("point_id"), F.col("e.x1").alias("x"), F.col("e.y1").alias("y"))
            within = containing(heads, large, keys)
            hits = hits.union(within.select(*keys, F.col("polygon" if mine else "point_id.of").alias("shape")))
    return shapes[0].join(hits.distinct(), [*keys, "shape"], "left_semi").select(*keys, "feature_id")


def holding(hold: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, outer, inner): polygons `hold` and the features `held` that they contain; stored.

    Groups of polygons of at most `small.LOCAL_PAIRS` points are looked at in numpy where they are dealt
    to, others by joins; rows without a key are left out.
    """
    ids = {"outer_id": hold.schema["feature_id"].dataType, "inner_id": held.schema["feature_id"].dataType}
    none = lambda kind: F.lit(None).cast(kind)
    typed = "geom_type" in held.columns

    def side(rows: DataFrame, holds: bool) -> DataFrame:
        id_ = {"outer_id" if holds else "inner_id": F.col("feature_id")}
        kind, flat = (F.col("geom_type"), ~_spans(rows)) if typed and not holds else (none("string"), F.lit(False))
        # without a geom_type polygons are told by their area, in numpy
        by_type = holds and "geom_type" in rows.columns
        judged = F.lit("geom_type" not in rows.columns)
        rows = rows.filter(reduce(Column.__and__, (F.col(k).isNotNull() for k in (*keys, "geom")), _spans(rows) if by_type else F.lit(True)))
        return rows.select(*(F.col(k).cast(hold.schema[k].dataType) for k in keys), *(id_.get(c, none(t)).cast(t).alias(c) for c, t in ids.items()), F.xxhash64("feature_id").alias("name"), F.col("geom").cast(geometry.GEOMETRY).alias("geom"), kind.alias("geom_type"), F.coalesce(flat, F.lit(True)).alias("flat"), F.lit(holds).alias("holds"), judged.alias("judged"))

    rows = side(hold, True).union(side(held, False))
    raw = ["outer_id", "inner_id", "geom", "geom_type", "holds"]
    made = [T.StructField(c.removesuffix("_id"), t) for c, t in ids.items()]
    schema = T.StructType([*(rows.schema[k] for k in keys), *made, *(T.StructField(c, rows.schema[c].dataType) for c in raw), T.StructField("large", T.BooleanType())])
    found = spread(rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(partial(small.hold, keys=keys, raw=raw), schema))
    done, large = found.filter("not large").select(*keys, "outer", "inner"), found.filter("large")
    if not large.limit(1).count():
        return done
    sides = [large.filter(F.col("holds") == holds).select(*keys, F.col(c).alias("feature_id"), "geom", *kind) for holds, c, kind in ((True, "outer_id", []), (False, "inner_id", ["geom_type"] if typed else []))]
    return spread(done.unionByName(joined_holding(*sides, keys)))


def joined_holding(hold: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """`holding` of groups of any size, by joins; stored.

    Only pairs of boxes one in the other are looked at.  A polygon contains another if all edges of
    the inner one, split where they meet, have their inner side in it, and none of its own edges,
    split likewise, runs through the inner one (as a hole's would).  It contains a line or points if
    all their pieces lie in or on it and one properly inside.
    """
    boxes = [meeting.boxes(x, keys) for x in (held, hold.filter(_spans(hold)))]
    met, around = meeting.pairs(*boxes, keys), F.lit(True)
    for c in "xy":
        around = around & (F.col(f"a_b{c}0") >= F.col(f"b_b{c}0") - SNAP) & (F.col(f"a_b{c}1") <= F.col(f"b_b{c}1") + SNAP)
    close = spread(met.filter(around).select(*keys, F.col("a_feature_id").alias("inner"), F.col("b_feature_id").alias("outer")))
    wanted = lambda x, name: x.join(close.select(*keys, F.col(name).alias("feature_id")).distinct(), [*keys, "feature_id"], "left_semi")
    numbered = lambda x: x.withColumn("sid", F.xxhash64("feature_id", "part", "ring", "seq"))
    outer = spread(numbered(segments(wanted(hold.filter(_spans(hold)), "outer"), keys)))
    solid = spread(numbered(segments(wanted(held.filter(_spans(held)), "inner"), keys)))
    found = _solid_in(solid, outer, keys)
    if "geom_type" in held.columns:
        flat = wanted(held.filter(~_spans(held)), "inner")
        pieces = flat.select(*keys, "feature_id", F.explode(_edges_and_dots(flat)).alias("e")).select(*keys, "feature_id", "e.*")
        found = found.unionByName(_flat_spots(numbered(pieces), outer, keys))
    out = spread(found.join(close, [*keys, "outer", "inner"], "left_semi"))
    released(close, outer, solid)
    return out


def _solid_in(held: DataFrame, hold: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, outer, inner): polygons `hold` that contain polygons `held`, both as segments."""
    pairs = neighbours(held, hold, keys, "sid")
    cuts = lambda p, q: pairs.select(*keys, F.col(f"{p}_sid").alias("sid"), inner_cuts(side(p), side(q)).alias("places")).filter(F.size("places") > 0)
    spots = lambda parts: parts.withColumn("s", F.explode(beside())).select(*keys, F.struct("feature_id", "x1", "y1", "x2", "y2", "s.side").alias("point_id"), F.col("s.x").alias("x"), F.col("s.y").alias("y"))
    of = F.col("point_id.feature_id")
    # the inner sides of the held edges: all must lie in the holder
    sides = spots(split_edges(held, cuts("a", "b"), keys, "sid"))
    own = containing(sides, held, keys).filter(of == F.col("polygon")).drop("polygon")
    total = own.groupBy(*keys, of.alias("inner")).agg(F.count("*").alias("total"))
    in_hold = containing(sides.join(own, [*keys, "point_id"], "left_semi"), hold, keys)
    got = in_hold.groupBy(*keys, of.alias("inner"), F.col("polygon").alias("outer")).agg(F.count("*").alias("got"))
    covered_ = got.join(total, [*keys, "inner"]).filter("got = total").select(*keys, "outer", "inner")
    # the holder's edges: none may have both sides in the held polygon
    through = containing(spots(split_edges(hold, cuts("b", "a"), keys, "sid")), held, keys)
    edge = [F.col(f"point_id.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]
    pierced = through.groupBy(*keys, of.alias("outer"), F.col("polygon").alias("inner"), *edge).agg(F.count("*").alias("n")).filter("n = 2").select(*keys, "outer", "inner").distinct()
    return covered_.join(pierced, [*keys, "outer", "inner"], "left_anti")


def _flat_spots(held: DataFrame, hold: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, outer, inner): polygons `hold` that contain lines or points: the middles of all their pieces lie in or on it, one properly inside."""
    cuts = neighbours(held, hold, keys, "sid").select(*keys, F.col("a_sid").alias("sid"), inner_cuts(side("a"), side("b")).alias("places")).filter(F.size("places") > 0)
    dots = held.filter(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1")) <= 2e-9)
    lines = split_edges(held.filter(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1")) > 2e-9), cuts, keys, "sid")
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    both = [x.select(*keys, "feature_id", middle("x1", "x2").alias("x"), middle("y1", "y2").alias("y")) for x in (lines, dots)]
    spots = both[0].union(both[1]).select(*keys, F.struct("feature_id", "x", "y").alias("point_id"), "x", "y").distinct()
    total = spots.groupBy(*keys, F.col("point_id.feature_id").alias("inner")).agg(F.count("*").alias("total"))
    touched = containing(spots, hold, keys, on_edge=True).groupBy(*keys, F.col("point_id.feature_id").alias("inner"), F.col("polygon").alias("outer")).agg(F.count("*").alias("got"))
    proper = containing(spots, hold, keys).select(*keys, F.col("point_id.feature_id").alias("inner"), F.col("polygon").alias("outer")).distinct()
    return touched.join(total, [*keys, "inner"]).filter("got = total").join(proper, [*keys, "inner", "outer"], "left_semi").select(*keys, "outer", "inner")


def properly_cross(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two segments cross in the inside of both."""
    dx, dy, ex, ey = a["x2"] - a["x1"], a["y2"] - a["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"]
    d1, d2 = cross(dx, dy, b["x1"] - a["x1"], b["y1"] - a["y1"]), cross(dx, dy, b["x2"] - a["x1"], b["y2"] - a["y1"])
    d3, d4 = cross(ex, ey, a["x1"] - b["x1"], a["y1"] - b["y1"]), cross(ex, ey, a["x2"] - b["x1"], a["y2"] - b["y1"])
    return (d1 * d2 < 0) & (d3 * d4 < 0)


def segment_distance2(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The squared distance of two segments; 0 if they cross."""

    def to(x, y, s):
        dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
        t = F.least(F.greatest(((x - s["x1"]) * dx + (y - s["y1"]) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
        return F.pow(s["x1"] + t * dx - x, 2) + F.pow(s["y1"] + t * dy - y, 2)

    ends = F.least(to(a["x1"], a["y1"], b), to(a["x2"], a["y2"], b), to(b["x1"], b["y1"], a), to(b["x2"], b["y2"], a))
    return F.when(properly_cross(a, b), F.lit(0.0)).otherwise(ends)


def attribute_filter(features: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Features whose attributes all equal the wanted ones: land_use by its column, others by their mapped text."""
    for key, value in wanted.items():
        features = features.filter((F.col("land_use") if key == "land_use" else F.try_element_at("mapped", F.lit(key))) == value)
    return features


def largest_gap(positions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring_length, position) -> the largest gap along a ring, the one over its start included."""
    order = Window.partitionBy(*keys).orderBy("position")
    rows = positions.withColumn("gap", F.col("position") - F.lag("position").over(order))
    ends = rows.groupBy(*keys).agg(F.max("gap").alias("inner"), F.min("position").alias("low"), F.max("position").alias("high"), F.first("ring_length").alias("ring_length"))
    return ends.select(*keys, F.greatest(F.coalesce("inner", F.lit(0.0)), F.col("ring_length") - F.col("high") + F.col("low")).alias("gap"))
