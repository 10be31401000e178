"""Road networks: from centrelines to a noded graph, and its measures.

All steps are joins by project: ends that lie within a tolerance become one
node, ends near another line move onto it, lines are split where they meet, and
the pieces are the edges of a multigraph whose nodes are their rounded ends.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from parcelwise.functions import geometry
from parcelwise.operators import overlay, small_roads
from parcelwise.session import released, spread

TOLERANCE = 2.0
EXISTING, PROPOSED = small_roads.EXISTING, small_roads.PROPOSED


def parts(roads: DataFrame) -> DataFrame:
    """project_id, feature_id, road_status, part and its edges; parts without length are left out."""
    rows = overlay.segments(roads, ["project_id", "road_status"])
    return rows.withColumn("line", F.xxhash64("feature_id", "part")).select("project_id", "feature_id", "road_status", "line", "seq", "x1", "y1", "x2", "y2")


def warnings(roads: DataFrame) -> DataFrame:
    empty = F.coalesce(geometry.length(F.col("geom")), F.lit(0.0)) == 0
    found = F.array_compact(F.array(F.when(empty, F.lit("invalid_road_geometry")), F.when(~empty & F.col("road_status").isNull(), F.lit("road_status_missing"))))
    return roads.select("project_id", "feature_id", F.explode(found).alias("code"))


def components(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b) -> keys, id, label: the smallest id that each id is connected with; rounds are cut in the shared folder."""
    both = spread(links.select(*keys, "a", "b").union(links.select(*keys, F.col("b"), F.col("a"))).distinct())
    labels = both.groupBy(*keys, F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label"))
    while True:
        near = both.join(labels.select(*keys, F.col("id").alias("b"), "label"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("id")).agg(F.min("label").alias("near"))
        nearer = labels.join(near, [*keys, "id"]).select(*keys, "id", F.least("label", "near").alias("to"), F.col("label").alias("old"))
        jump = labels.select(*keys, F.col("id").alias("to"), F.col("label").alias("next"))
        found = spread(nearer.join(jump, [*keys, "to"]).select(*keys, "id", F.least("to", "next").alias("label"), "old"))
        labels = found.drop("old")
        if not found.filter("label <> old").limit(1).count():
            return labels


def ends(lines: DataFrame) -> DataFrame:
    """The two ends of each line: project_id, line, which, seq, x, y."""
    rows = lines.groupBy("project_id", "line").agg(F.min(F.struct("seq", "x1", "y1")).alias("s"), F.max(F.struct("seq", "x2", "y2")).alias("t"))
    both = F.array(F.struct(F.lit("s").alias("which"), F.col("s.seq").alias("seq"), F.col("s.x1").alias("x"), F.col("s.y1").alias("y")), F.struct(F.lit("t").alias("which"), F.col("t.seq").alias("seq"), F.col("t.x2").alias("x"), F.col("t.y2").alias("y")))
    return rows.select("project_id", "line", F.explode(both).alias("e")).select("project_id", "line", "e.*").withColumn("end_id", F.xxhash64("line", "which"))


def _moved(lines: DataFrame, moves: DataFrame) -> DataFrame:
    """Lines with ends (project_id, line, which, seq) at their new places x, y."""
    start = moves.filter("which = 's'").select("project_id", "line", "seq", F.col("x").alias("sx"), F.col("y").alias("sy"))
    stop = moves.filter("which = 't'").select("project_id", "line", "seq", F.col("x").alias("tx"), F.col("y").alias("ty"))
    rows = lines.join(start.hint("merge"), ["project_id", "line", "seq"], "left").join(stop.hint("merge"), ["project_id", "line", "seq"], "left")
    new = {"x1": ("sx", "x1"), "y1": ("sy", "y1"), "x2": ("tx", "x2"), "y2": ("ty", "y2")}
    return rows.withColumns({k: F.coalesce(*v) for k, v in new.items()}).drop("sx", "sy", "tx", "ty").filter("x1 <> x2 or y1 <> y2")


def cluster_ends(lines: DataFrame, tolerance: float) -> DataFrame:
    """Ends within the tolerance of each other, and all these lead to, move to their mean."""
    every = spread(ends(lines))
    cell = lambda c, k: F.floor(F.col(c) / tolerance) + k
    here = every.withColumns({"cx": cell("x", 0), "cy": cell("y", 0)})
    around = every.withColumn("dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    around = around.select("project_id", F.col("end_id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), (cell("x", 0) + F.col("dx")).alias("cx"), (cell("y", 0) + F.col("dy")).alias("cy"))
    near = here.join(around.hint("merge"), ["project_id", "cx", "cy"]).filter((F.col("end_id") < F.col("other")) & (F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) <= tolerance))
    labels = components(near.select("project_id", F.col("end_id").alias("a"), F.col("other").alias("b")), ["project_id"])
    named = every.join(labels.withColumnRenamed("id", "end_id"), ["project_id", "end_id"])
    mean = named.groupBy("project_id", "label").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    moves = named.join(mean, ["project_id", "label"]).select("project_id", "line", "which", "seq", F.round("mx", 6).alias("x"), F.round("my", 6).alias("y"))
    return _moved(lines, moves)


def snap_ends(lines: DataFrame, tolerance: float) -> DataFrame:
    """Each end moves onto the nearest other line within the tolerance, of the lowest line on a tie."""
    tips = ends(lines).select("project_id", F.col("line").alias("feature_id"), F.struct("line", "which", "seq").alias("sid"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    segs = lines.select("project_id", F.col("line").alias("feature_id"), F.struct("line", F.lit("-").alias("which"), "seq").alias("sid"), "x1", "y1", "x2", "y2")
    pairs = overlay.neighbours(tips, segs, ["project_id"], "sid", tolerance).filter("a_feature_id <> b_feature_id")
    dx, dy = F.col("b_x2") - F.col("b_x1"), F.col("b_y2") - F.col("b_y1")
    t = F.least(F.greatest(((F.col("a_x1") - F.col("b_x1")) * dx + (F.col("a_y1") - F.col("b_y1")) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    rows = pairs.withColumns({"x": F.round(F.col("b_x1") + t * dx, 6), "y": F.round(F.col("b_y1") + t * dy, 6)})
    gap = F.hypot(F.col("x") - F.col("a_x1"), F.col("y") - F.col("a_y1"))
    best = rows.withColumn("gap", gap).filter(F.col("gap") <= tolerance).groupBy("project_id", "a_sid").agg(F.min(F.struct("gap", "b_feature_id", "x", "y")).alias("b"))
    return _moved(lines, best.select("project_id", F.col("a_sid.line").alias("line"), F.col("a_sid.which").alias("which"), F.col("a_sid.seq").alias("seq"), F.col("b.x").alias("x"), F.col("b.y").alias("y")))


def unlinked_pairs(lines: DataFrame, unlinks: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(project_id, one, two, x, y): pairs of lines that don't meet at an unlink point; and the points (project_id,
    feature_id) that don't match exactly two lines."""
    spots = unlinks.select("project_id", "feature_id", F.col("feature_id").alias("sid"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    segs = lines.select("project_id", F.col("line").alias("feature_id"), F.col("line").alias("sid"), "x1", "y1", "x2", "y2")
    near = overlay.neighbours(spots, segs, ["project_id"], "sid", tolerance).filter(overlay.segment_distance2(overlay.side("b"), overlay.side("b") | {"x1": F.col("a_x1"), "y1": F.col("a_y1"), "x2": F.col("a_x1") + 1e-9, "y2": F.col("a_y1")}) <= tolerance**2)
    met = near.groupBy("project_id", F.col("a_feature_id").alias("point"), F.col("a_x1").alias("x"), F.col("a_y1").alias("y")).agg(F.sort_array(F.collect_set("b_feature_id")).alias("lines"))
    good = met.filter(F.size("lines") == 2)
    bad = unlinks.select("project_id", "feature_id").join(good.select("project_id", F.col("point").alias("feature_id")), ["project_id", "feature_id"], "left_anti")
    return good.select("project_id", F.get("lines", F.lit(0)).alias("one"), F.get("lines", F.lit(1)).alias("two"), "x", "y"), bad


def _settled(roads: DataFrame, unlinks: DataFrame | None, tolerance: float, form: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The edges or warnings of projects that one task goes through (stored), and roads and unlinks of larger ones, if there are any.

    Small are projects of at most `small.LOCAL` points, see `small_roads`; rows without a project are left out.
    """
    of = {c: roads.schema[c].dataType for c in ("project_id", "feature_id")}
    unlink_id = of["feature_id"] if unlinks is None else unlinks.schema["feature_id"].dataType
    types = {"feature_id": of["feature_id"], "name": "bigint", "road_status": "string", "lines": "array<bigint>", "geom": geometry.GEOMETRY, "unlink_id": unlink_id, "x": "double", "y": "double", "spot": "boolean"}
    name, number = F.xxhash64("feature_id"), F.transform("geom", lambda r: F.xxhash64("feature_id", r["part"]))
    row = lambda rows, **has: rows.filter("project_id is not null").select(F.col("project_id").cast(of["project_id"]), *(has.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()))
    rows = row(roads, feature_id=F.col("feature_id"), name=name, road_status=F.col("road_status"), lines=number, geom=F.col("geom"), spot=F.lit(False))
    if unlinks is not None:
        rows = rows.union(row(unlinks, name=name, unlink_id=F.col("feature_id"), x=F.col("x"), y=F.col("y"), spot=F.lit(True)))
    field = lambda c, t: T.StructField(c, t if isinstance(t, T.DataType) else T.StructType.fromDDL(f"c {t}")["c"].dataType)
    made = [field("made_id", of["feature_id"]), field("made_status", "string"), *(field(c, "double") for c in ("x1", "y1", "x2", "y2", "length"))]
    if form == "warnings":
        made = [field("code", "string"), field("feature_ids", T.ArrayType(of["feature_id"])), field("unlink", unlink_id)]
    raw = [field(c, t) for c, t in types.items()]
    arrow = [list(to_arrow_schema(T.StructType(x))) for x in (raw, made)]
    schema = T.StructType([field("project_id", of["project_id"]), *made, *raw, field("large", "boolean")])
    use = partial(small_roads.networks, form=form, tolerance=tolerance, raw=arrow[0], made=arrow[1])
    found = spread(rows.repartition("project_id").sortWithinPartitions("project_id").mapInArrow(use, schema))
    done, large = found.filter("not large").select("project_id", *(f.name for f in made)), found.filter("large")
    if not large.limit(1).count():
        return done, None, None
    points = large.filter("spot").select("project_id", F.col("unlink_id").alias("feature_id"), "x", "y")
    return done, large.filter("not spot").select("project_id", "feature_id", "road_status", "geom"), None if unlinks is None else points


def network(roads: DataFrame, unlinks: DataFrame | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """The edges of the noded graph: project_id, feature_id, road_status, x1, y1, x2, y2 and length, of whole pieces between nodes.

    A piece that bends is one edge: `nodes` counts ends of pieces alone.  The edges are stored.
    """
    done, large, points = _settled(roads, unlinks, tolerance, "edges")
    done = done.withColumnsRenamed({"made_id": "feature_id", "made_status": "road_status"})
    return done if large is None else spread(done.unionByName(joined_network(large, points, tolerance)))


def _noded(roads: DataFrame, tolerance: float) -> DataFrame:
    """Lines whose ends have moved onto each other; stored."""
    steps = [spread(parts(roads))]
    for move in (cluster_ends, snap_ends):
        steps.append(spread(move(steps[-1], tolerance)))
    released(*steps[:-1])
    return steps[-1]


def joined_network(roads: DataFrame, unlinks: DataFrame | None = None, tolerance: float = TOLERANCE, noded: DataFrame | None = None) -> DataFrame:
    """`network` of projects of any size, by joins (of `noded` lines, if at hand); the edges are stored, as are the steps on the way."""
    lines = _noded(roads, tolerance) if noded is None else noded
    rows = lines.withColumn("sid", F.struct("line", "seq"))
    segs = rows.select("project_id", F.col("line").alias("feature_id"), "sid", "x1", "y1", "x2", "y2")
    pairs = overlay.neighbours(segs, segs, ["project_id"], "sid").filter("a_feature_id <> b_feature_id")
    places = pairs.select("project_id", F.col("a_sid").alias("sid"), F.col("b_feature_id").alias("other"), F.explode(overlay.cut_places(overlay.side("a"), overlay.side("b"))).alias("t"), (F.col("a_x2") - F.col("a_x1")).alias("dx"), (F.col("a_y2") - F.col("a_y1")).alias("dy"), "a_x1", "a_y1")
    places = places.withColumns({"x": F.col("a_x1") + F.col("t") * F.col("dx"), "y": F.col("a_y1") + F.col("t") * F.col("dy")})
    if unlinks is not None:
        apart, _ = unlinked_pairs(lines, unlinks, tolerance)
        both = apart.select("project_id", "one", F.col("two").alias("other"), F.col("x").alias("ux"), F.col("y").alias("uy")).union(apart.select("project_id", "two", "one", "x", "y"))
        same = (places["project_id"] == both["project_id"]) & (places["sid"]["line"] == both["one"]) & (places["other"] == both["other"]) & (F.hypot(places["x"] - both["ux"], places["y"] - both["uy"]) <= tolerance)
        places = places.join(both.hint("merge"), same, "left_anti")
    places = spread(places)
    cuts = places.groupBy("project_id", "sid").agg(F.collect_list("t").alias("places"))
    pieces = spread(overlay.split_edges(rows, cuts, ["project_id"], "sid"))
    # the pieces of a line between its cuts: bends that are no cut don't end an edge
    nodes = places.select("project_id", F.col("sid.line").alias("line"), F.round("x", 6).alias("x1"), F.round("y", 6).alias("y1")).distinct().withColumn("cut", F.lit(1))
    order = Window.partitionBy("project_id", "line").orderBy("seq", F.hypot(F.col("x1") - F.col("ox"), F.col("y1") - F.col("oy")))
    origin = rows.select("project_id", "line", "seq", F.col("x1").alias("ox"), F.col("y1").alias("oy"))
    marked = pieces.join(nodes, ["project_id", "line", "x1", "y1"], "left").join(origin, ["project_id", "line", "seq"])
    marked = marked.withColumn("place", F.row_number().over(order)).withColumn("piece", F.sum(F.coalesce("cut", F.lit(0))).over(order))
    size = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    whole = marked.groupBy("project_id", "feature_id", "road_status", "line", "piece").agg(F.min(F.struct("place", "x1", "y1")).alias("s"), F.max(F.struct("place", "x2", "y2")).alias("t"), F.sum(size).alias("length"))
    out = spread(whole.select("project_id", "feature_id", "road_status", F.col("s.x1").alias("x1"), F.col("s.y1").alias("y1"), F.col("t.x2").alias("x2"), F.col("t.y2").alias("y2"), "length"))
    released(places, pieces, *([lines] if noded is None else []))
    return out


def nodes(edges: DataFrame) -> DataFrame:
    """project_id, x, y, degree (a loop counts twice) and the statuses that meet."""
    both = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    return edges.select("project_id", "road_status", F.explode(both).alias("n")).groupBy("project_id", F.col("n.x").alias("x"), F.col("n.y").alias("y")).agg(F.count("*").alias("degree"), F.max((F.col("road_status") == EXISTING).cast("int")).alias("existing"), F.max((F.col("road_status") == PROPOSED).cast("int")).alias("proposed"))


def measures(edges: DataFrame, perimeter: DataFrame | None = None, area: DataFrame | None = None) -> DataFrame:
    """One row per project: lengths, nodes, edges, intersections (degree 3 or more), link_node_ratio, proposed_connections,
    and with a perimeter (features) the intersections it covers per square kilometre of its `area` (project_id, area)."""
    sums = edges.groupBy("project_id").agg(
        F.sum("length").alias("total_length"),
        F.coalesce(F.sum(F.when(F.col("road_status") == EXISTING, F.col("length"))), F.lit(0.0)).alias("existing_length"),
        F.coalesce(F.sum(F.when(F.col("road_status") == PROPOSED, F.col("length"))), F.lit(0.0)).alias("proposed_length"),
        F.count("*").alias("n_edges"),
    )
    found = nodes(edges)
    counts = found.groupBy("project_id").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("degree") >= 3).alias("intersections"), F.count_if((F.col("existing") == 1) & (F.col("proposed") == 1)).alias("proposed_connections"))
    out = sums.join(counts, "project_id").withColumn("link_node_ratio", F.col("n_edges") / F.col("n_nodes"))
    if perimeter is None:
        return out
    spots = found.filter("degree >= 3").select("project_id", F.struct("x", "y").alias("point_id"), "x", "y")
    inside = overlay.covered(spots, overlay.segments(perimeter, ["project_id"]), ["project_id"], on_edge=True).groupBy("project_id").agg(F.count("*").alias("inside"))
    area = (overlay.dissolved(perimeter, ["project_id"]) if area is None else area).select("project_id", "area")
    density = F.when(F.col("area") > 0, F.coalesce("inside", F.lit(0)) * 1e6 / F.col("area")).otherwise(0.0)
    return out.join(area, "project_id", "left").join(inside, "project_id", "left").withColumn("intersection_density", density).drop("area", "inside")


def connected_parts(edges: DataFrame) -> DataFrame:
    """(project_id, label, n_nodes, existing, proposed) of each connected part of the graph."""
    node = lambda x, y: F.xxhash64(x, y)
    links = edges.select("project_id", node("x1", "y1").alias("a"), node("x2", "y2").alias("b"))
    labels = components(links, ["project_id"])
    found = nodes(edges).withColumn("id", node("x", "y")).join(labels, ["project_id", "id"])
    return found.groupBy("project_id", "label").agg(F.count("*").alias("n_nodes"), F.max("existing").alias("existing"), F.max("proposed").alias("proposed"))


#: Code of a warning -> its severity, where it is not `warning`.
SEVERITY = {"road_status_missing": "info", "disconnected_road_network": "info"}


def overlaps(lines: DataFrame) -> DataFrame:
    """(project_id, feature_ids): pairs of lines that run along the same stretch."""
    segs = lines.select("project_id", F.struct("line", "seq").alias("sid"), F.struct("feature_id", "line").alias("feature_id"), "x1", "y1", "x2", "y2")
    a, b = overlay.side("a"), overlay.side("b")
    pairs = overlay.neighbours(segs, segs, ["project_id"], "sid").filter("a_feature_id.line < b_feature_id.line")
    dx, dy = a["x2"] - a["x1"], a["y2"] - a["y1"]
    size = F.hypot(dx, dy)
    off = lambda x, y: F.abs(overlay.cross(dx, dy, x - a["x1"], y - a["y1"])) / size
    at = lambda x, y: (dx * (x - a["x1"]) + dy * (y - a["y1"])) / size
    ends = [(b["x1"], b["y1"]), (b["x2"], b["y2"])]
    along = F.least(size, F.greatest(*(at(*e) for e in ends))) - F.greatest(F.lit(0.0), F.least(*(at(*e) for e in ends)))
    same = (off(*ends[0]) <= overlay.SNAP) & (off(*ends[1]) <= overlay.SNAP) & (along > overlay.SNAP)
    ids = F.sort_array(F.array("a_feature_id.feature_id", "b_feature_id.feature_id"))
    return pairs.filter(same).select("project_id", "a_feature_id.line", F.col("b_feature_id.line").alias("other"), ids.alias("feature_ids")).distinct().drop("line", "other")


def network_warnings(roads: DataFrame, unlinks: DataFrame | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(project_id, code, severity, feature_ids) of road networks.

    invalid_road_geometry, road_status_missing: a feature each; invalid_road_unlink: a point that
    doesn't match two lines; overlapping_road_centerlines: two lines each; disconnected_road_network:
    all features of a network in several parts; proposed_roads_not_connected_to_existing: the
    proposed features of a part without an existing road.
    """
    done, large, points = _settled(roads, unlinks, tolerance, "warnings")
    of_unlink = F.col("code") == "invalid_road_unlink"
    found = warnings(roads).select("project_id", "code", F.array("feature_id").alias("feature_ids"))
    found = found.unionByName(done.filter(~of_unlink).select("project_id", "code", F.sort_array("feature_ids").alias("feature_ids")))
    if unlinks is not None:
        found = found.unionByName(done.filter(of_unlink).select("project_id", "code", F.array("unlink").alias("feature_ids")))
    if large is not None:
        found = found.unionByName(joined_warnings(large, points, tolerance))
    severity = F.lit("warning")
    for code, level in SEVERITY.items():
        severity = F.when(F.col("code") == code, level).otherwise(severity)
    return spread(found.select("project_id", "code", severity.alias("severity"), "feature_ids"))


def joined_warnings(roads: DataFrame, unlinks: DataFrame | None, tolerance: float = TOLERANCE) -> DataFrame:
    """(project_id, code, feature_ids): the warnings of networks that no single road causes, by joins; stored."""
    lines = _noded(roads, tolerance)
    edges = joined_network(roads, unlinks, tolerance, lines)
    node = lambda x, y: F.xxhash64(x, y)
    labels = components(edges.select("project_id", node("x1", "y1").alias("a"), node("x2", "y2").alias("b")), ["project_id"])
    parts_ = edges.withColumn("id", node("x1", "y1")).join(labels, ["project_id", "id"])
    ids = F.sort_array(F.collect_set("feature_id")).alias("feature_ids")
    apart = parts_.groupBy("project_id").agg(F.min("label").alias("low"), F.max("label").alias("high"), ids).filter("low <> high")
    proposed = F.sort_array(F.collect_set(F.when(F.col("road_status") == PROPOSED, F.col("feature_id")))).alias("feature_ids")
    existing = F.max((F.coalesce("road_status", F.lit("")) == EXISTING).cast("int")).alias("existing")
    new = parts_.groupBy("project_id", "label").agg(proposed, existing).filter("existing = 0 and size(feature_ids) > 0")
    said = lambda rows, code: rows.select("project_id", F.lit(code).alias("code"), "feature_ids")
    found = said(overlaps(lines), "overlapping_road_centerlines").unionByName(said(apart, "disconnected_road_network")).unionByName(said(new, "proposed_roads_not_connected_to_existing"))
    if unlinks is not None:
        _, bad = unlinked_pairs(lines, unlinks, tolerance)
        found = found.unionByName(said(bad.select("project_id", F.array("feature_id").alias("feature_ids")), "invalid_road_unlink"))
    out = spread(found)
    released(lines, edges)
    return out
