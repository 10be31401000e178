"""Selections, validity and rectangles on shapes that are no boxes."""

import json
import math

import pytest
from pyspark.sql import functions as F

from parcelwise.functions import geometry
from parcelwise.operators import blocks, catalog, meeting, overlay, territory, validity


def shapes(spark, rows):
    """(feature_id, type, coordinates) as features of project 1."""
    made = spark.createDataFrame([(1, i, kind, json.dumps(xy) if xy is not None else None) for i, kind, xy in rows], "project_id bigint, feature_id bigint, geom_type string, c string")
    return made.withColumn("geom", geometry.from_geojson(F.col("geom_type"), F.col("c"))).drop("c")


BOX = [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]]
TARGETS = [(1, "Polygon", BOX), (2, "LineString", [[58, -50], [58, 50]]), (3, "Point", [5, 5]), (4, "Point", [10, 4]), (5, "LineString", [[2, 2], [8, 8]]), (6, "LineString", [[5, 5], [15, 5]]), (7, "Point", [13, 4])]


def found(targets, sources, relation, distance=0.0):
    return sorted(r["feature_id"] for r in overlay.related(targets, sources, ["project_id"], relation, distance).collect())


def test_selection_on_lines_and_points(spark):
    targets, box = shapes(spark, TARGETS), shapes(spark, [(9, "Polygon", BOX)])
    assert found(targets, box, "intersects") == [1, 3, 4, 5, 6]
    assert found(targets, box, "within") == [1, 3, 5]
    assert found(targets, box, "dwithin", 4.0) == [1, 3, 4, 5, 6, 7]
    assert found(box, shapes(spark, [(3, "Point", [5, 5])]), "contains") == [9]
    assert found(box, shapes(spark, [(4, "Point", [10, 4])]), "contains") == []
    assert found(targets, shapes(spark, [(8, "Point", [13, 4])]), "intersects") == [7]


def test_a_long_segment_meets_what_lies_along_it(spark):
    road = shapes(spark, [(1, "LineString", [[0, 0], [100_000, 70_000]])])
    near = shapes(spark, [(k, "LineString", [[x, 0.7 * x - 3], [x, 0.7 * x + 3]]) for k, x in enumerate(range(500, 100_000, 9_000))] + [(90, "LineString", [[500, 60_000], [520, 60_000]])])
    assert found(near, road, "intersects") == list(range(12))
    runs = meeting.runs(road, ["project_id"])
    assert runs.count() < 200 and runs.agg(F.max("level")).first()[0] <= 11


def test_validity(spark):
    cases = [
        ("Polygon", BOX, None),
        ("Polygon", [[[0, 0], [10, 10], [10, 0], [0, 12], [0, 0]]], "self_intersection"),
        ("Polygon", [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 1]]], "unclosed_ring"),
        ("Polygon", [*BOX, [[2, 2], [2, 4], [4, 4], [4, 2], [2, 2]]], None),
        ("Polygon", [*BOX, [[22, 2], [22, 4], [24, 4], [24, 2], [22, 2]]], "hole_outside"),
        ("MultiPolygon", [BOX, [[[2, 2], [4, 2], [4, 4], [2, 4], [2, 2]]]], "overlapping_parts"),
        ("MultiPolygon", [BOX, [[[20, 2], [24, 2], [24, 4], [20, 4], [20, 2]]]], None),
        ("Polygon", None, "null"),
        ("MultiPolygon", [BOX, [[[10, 0], [20, 0], [20, 10], [10, 10], [10, 0]]]], "shared_edge"),
        ("MultiPolygon", [BOX, [[[5, 0], [15, 0], [15, 10], [5, 10], [5, 0]]]], "overlapping_parts shared_edge"),
        ("Polygon", [*BOX, [[0, 2], [0, 4], [4, 4], [4, 2], [0, 2]]], "shared_edge"),
        ("Polygon", [*BOX, [[2, 2], [2, 8], [8, 8], [8, 2], [2, 2]], [[3, 3], [3, 4], [4, 4], [4, 3], [3, 3]]], "nested_holes"),
        ("Polygon", [*BOX, [[0, 5], [5, 8], [5, 2], [0, 5]]], None),  # a hole that touches its shell in a point
        ("MultiPolygon", [BOX, [[[10, 10], [20, 10], [20, 20], [10, 20], [10, 10]]]], None),  # parts that touch in a point
        ("MultiPolygon", [[BOX[0], [[2, 2], [2, 8], [8, 8], [8, 2], [2, 2]]], [[[3, 3], [6, 3], [6, 6], [3, 6], [3, 3]]]], None),  # an island in a hole
        ("MultiPolygon", [[BOX[0], [[2, 2], [2, 8], [8, 8], [8, 2], [2, 2]]], [[[2, 2], [8, 2], [8, 8], [2, 8], [2, 2]]]], "shared_edge"),  # a hole filled
        ("MultiPolygon", [BOX, BOX], "shared_edge"),
        ("Polygon", [*BOX, [[2, 2], [2, 12], [4, 12], [4, 2], [2, 2]]], "hole_outside self_intersection"),
        ("Polygon", [[[0, 0], [6, 10], [10, 0], [0, 7], [10, 7], [0, 0]]], "self_intersection"),  # a star turns twice
        ("Polygon", [[[0, 0], [10, 0], [10, 10], [5, 0], [0, 10], [0, 0]]], "self_intersection"),  # a corner on another edge
    ]
    rows = {r["feature_id"]: r for r in validity.audited(shapes(spark, [(k, kind, xy) for k, (kind, xy, _) in enumerate(cases)]), ["project_id"]).collect()}
    assert len(rows) == len(cases)
    for k, (_, _, faults) in enumerate(cases):
        assert (rows[k]["is_valid"], rows[k]["faults"]) == (faults is None, faults.split() if faults else None), cases[k]


def test_unions_leave_out_what_the_audit_rejects(spark):
    rows = shapes(spark, [(1, "Polygon", BOX), (2, "Polygon", [[[20, 0], [30, 10], [30, 0], [20, 12], [20, 0]]])])
    good = blocks.perimeter(validity.audited(rows, ["project_id"])).first()
    assert (good["area"], good["length"]) == (100.0, 40.0)
    assert [r["feature_id"] for r in blocks.skipped(validity.audited(rows, ["project_id"])).collect()] == [2]


def test_a_turned_rectangle_and_hull(spark):
    turn = math.radians(30)
    corner = lambda x, y: [x * math.cos(turn) - y * math.sin(turn), x * math.sin(turn) + y * math.cos(turn)]
    ring = [corner(*p) for p in ((0, 0), (40, 0), (40, 10), (20, 5), (0, 10), (0, 0))]
    features = shapes(spark, [(k, "Polygon", [ring]) for k in range(3)]).withColumns({"macroarea": F.lit("lote"), "quadra_id": F.lit("Q")}).repartition(3)
    r = blocks.block_rectangles(features).first()
    assert (r["long_side"], r["short_side"], r["orientation"]) == (pytest.approx(40), pytest.approx(10), pytest.approx(60))


def test_a_negative_coefficient_is_missing(spark):
    rows = shapes(spark, [(1, "Polygon", BOX)]).withColumns({"macroarea": F.lit("lote"), "ca_max": F.lit(-1.0), "land_use": F.lit("misto"), "quadra_id": F.lit("Q"), "reference_area_m2": F.lit(0.0), "parcelavel": F.lit(True)})
    assert "lot_ca_missing" in {r["code"] for r in territory.warnings(rows).collect()}
    # open area of reference 0
    both = rows.unionByName(rows.withColumns({"macroarea": F.lit("avl"), "feature_id": F.lit(2)}))
    assert {(r["indicator_code"], r["error"]) for r in territory.errors(both).collect()} == {("density.built_open_ratio", "no_open_area")}


def test_catalog(spark, tmp_path):
    assert catalog.catalog(spark).count() == 35
    assert catalog.catalog(spark, "density").count() == 5
    with pytest.raises(ValueError):
        catalog.catalog(spark, "weather")
    values = spark.createDataFrame([(1, "land_use.predominant_use", None, None, "misto"), (1, "green_areas.total_area", None, 2.5, None)], "project_id bigint, indicator_code string, key string, value double, label string")
    catalog.save_results(values, "r1", str(tmp_path / "results"), "EPSG:32722")
    back = {r["indicator_code"]: r for r in spark.read.parquet(str(tmp_path / "results")).collect()}
    assert json.loads(back["land_use.predominant_use"]["value_json"])["label"] == "misto" and back["green_areas.total_area"]["unit"] == "m2" and back["green_areas.total_area"]["run_id"] == "r1"


def test_points_in_polygons_of_every_width(spark):
    """Against a ray in plain Python: narrow, wide and very wide polygons, one with a hole, of two groups."""
    wide = [[[-50, -20], [90_000, 5], [60_000, 70], [-50, 70], [-50, -20]], [[100, 10], [100, 40], [4_000, 40], [4_000, 10], [100, 10]]]
    rings = {1: wide, 2: [[[0, 0], [2_000, 0], [1_000, 50], [0, 0]]]} | {k: [[[7 * k, 0], [7 * k + 9, 0], [7 * k + 4, 33], [7 * k, 0]]] for k in range(3, 300)}
    features = shapes(spark, [(k, "Polygon", r) for k, r in rings.items()])
    edges = overlay.segments(features.union(features.withColumn("project_id", F.lit(2)).filter("feature_id = 2")), ["project_id"])
    at = [(p, 1000 * p + k, x, y) for p in (1, 2) for k, (x, y) in enumerate([(0.37 + 41.3 * i, (3.1 * i) % 68) for i in range(60)] + [(70_000.5, 20.25), (-60.5, 1.5), (95_000.5, 6.5)])]
    points = spark.createDataFrame(at, "project_id bigint, point_id bigint, x double, y double")
    found = {tuple(r) for r in overlay.containing(points, edges, ["project_id"]).select("project_id", "point_id", "polygon").collect()}

    def inside(x, y, polygon):
        crossed = 0
        for ring in polygon:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
                crossed += (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
        return crossed % 2 == 1

    assert found == {(p, i, k) for p, i, x, y in at for k, ring in rings.items() if (p == 1 or k == 2) and inside(x, y, ring)}
    assert {k for _, _, k in found} >= {1, 2} and len(found) > 60


HOLE = [[2, 2], [2, 4], [4, 4], [4, 2], [2, 2]]


def test_containment_sees_holes_and_parts(spark):
    ring = lambda x0, y0, x1, y1: [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]
    holed = shapes(spark, [(1, "Polygon", [*BOX, HOLE]), (2, "MultiPolygon", [BOX, [ring(20, 0, 30, 10)]])])
    held = shapes(
        spark,
        [
            (10, "Polygon", [ring(1, 1, 6, 6)]),  # covers the hole
            (11, "Polygon", [ring(2, 2, 4, 4)]),  # fills the hole
            (12, "Polygon", [ring(5, 5, 9, 9)]),  # beside the hole
            (13, "Polygon", [ring(4, 2, 6, 4)]),  # along the hole
            (14, "Polygon", [ring(1, 1, 6, 6), HOLE]),  # around the hole, with the same hole
            (15, "Polygon", [ring(1, 1, 6, 6), [[1.5, 1.5], [1.5, 5], [5, 5], [5, 1.5], [1.5, 1.5]]]),  # around it, with a larger hole
            (16, "MultiPolygon", [[ring(5, 5, 9, 9)], [ring(22, 1, 24, 3)]]),  # in both parts of 2
            (17, "Polygon", [ring(8, 1, 22, 3)]),  # over the gap of the parts
            (18, "Polygon", [BOX[0], HOLE]),  # all of 1
            (19, "LineString", [[1, 3], [5, 3]]),  # through the hole
            (20, "LineString", [[5, 3], [9, 3]]),
            (21, "Polygon", [ring(0, 0, 30, 10)]),
        ],
    )
    pairs = {(r["outer"], r["inner"]) for r in overlay.holding(holed, held, ["project_id"]).collect()}
    assert pairs == {(1, 12), (1, 13), (1, 14), (1, 15), (1, 18), (1, 20), (2, 10), (2, 11), (2, 12), (2, 13), (2, 14), (2, 15), (2, 16), (2, 18), (2, 19), (2, 20)}
    assert found(holed, held, "contains") == [1, 2]
    assert found(holed, held.filter("feature_id in (10, 11, 19)"), "contains") == [2]
    assert found(held.filter("feature_id = 10"), holed.filter("feature_id = 1"), "within") == []


def test_convex_rings_need_no_join(spark):
    rows = shapes(spark, [(1, "Polygon", BOX), (2, "Polygon", [BOX[0][::-1]]), (3, "Polygon", [[[0, 0], [10, 0], [4, 1], [0, 10], [0, 0]]]), (4, "Polygon", [[[0, 0], [6, 10], [10, 0], [0, 7], [10, 7], [0, 0]]]), (5, "Polygon", [*BOX, HOLE]), (6, "Polygon", [[[0, 0], [5, 0], [10, 0], [10, 10], [0, 0]]]), (7, "Polygon", None), (8, "Polygon", [[[0, 0], [9, 0], [4, 0], [4, 9], [0, 0]]])])
    assert {r["feature_id"] for r in rows.filter(validity.convex(F.col("geom"))).collect()} == {1, 2, 6}


def test_boxes_of_all_sizes_meet_once(spark):
    """Against all pairs: small boxes beside some that are a thousand times larger, a heap of equal ones, and boxes that touch."""
    import random

    draw = random.Random(6)
    made = [(g, 1000 * s + k, *_box(draw)) for g in (1, 2) for s in (1, 2) for k in range(120)] + [(1, 3000 + k, 5.0, 5.0, 6.0, 6.0) for k in range(20)]
    frame = spark.createDataFrame(made, "project_id bigint, feature_id bigint, bx0 double, by0 double, bx1 double, by1 double")
    a, b = meeting.leveled(frame.filter("feature_id < 2000"), 0.5), meeting.leveled(frame.filter("feature_id >= 2000"))
    got = [tuple(r) for r in meeting.pairs(a, b, ["project_id"]).select("project_id", "a_feature_id", "b_feature_id").collect()]
    want = {(p[0], p[1], q[1]) for p in made if p[1] < 2000 for q in made if q[1] >= 2000 and p[0] == q[0] and p[2] - 0.5 <= q[4] and q[2] <= p[4] + 0.5 and p[3] - 0.5 <= q[5] and q[3] <= p[5] + 0.5}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def _box(draw):
    x, y, size = draw.randint(-40, 400) / 4, draw.randint(-40, 400) / 4, draw.choice([0.25, 1, 1, 2, 5, 60, 900])
    return x, y, x + size, y + draw.choice([0, 1, size])


def test_a_heap_of_copies_is_one_pair(spark):
    heap = shapes(spark, [(k, "Polygon", BOX) for k in range(400)])
    other = shapes(spark, [(k, "Polygon", [[[5, 5], [15, 5], [15, 15], [5, 15], [5, 5]]]) for k in range(400)])
    assert found(heap, other, "intersects") == list(range(400))
    a, b = (meeting.edge_runs(overlay._distinct_shapes(overlay._shapes(x, ["project_id"]), ["project_id"]), ["project_id"]) for x in (heap, other))
    assert meeting.pairs(a, b, ["project_id"]).count() == 1


def test_union_with_a_fast_way_and_a_slow_one(spark):
    """Abutting polygons cancel their shared edges; overlapping and holed ones are covered side by side; both in one job."""
    rows = [(1, 1, BOX), (1, 2, [[[10, 0], [20, 0], [20, 8], [10, 8], [10, 0]]]), (1, 3, [[[20, 8], [20, 0], [30, 0], [30, 8], [20, 8]]])]
    rows += [(2, 1, BOX), (2, 2, [[[5, 5], [15, 5], [15, 15], [5, 15], [5, 5]]])]
    rows += [(3, 1, [*BOX, HOLE]), (3, 2, [HOLE])]
    made = spark.createDataFrame([(p, i, "Polygon", json.dumps(xy)) for p, i, xy in rows], "project_id bigint, feature_id bigint, geom_type string, c string")
    made = made.withColumn("geom", geometry.from_geojson(F.col("geom_type"), F.col("c"))).drop("c")
    got = {r["project_id"]: (r["area"], r["length"]) for r in overlay.dissolved(made, ["project_id"]).collect()}
    assert got == {1: (260.0, 80.0), 2: (175.0, 60.0), 3: (100.0, 40.0)}
