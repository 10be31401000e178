"""Polygons from loose edges: touching corners, holes, islands, several groups; open edges are left out."""

import pytest
from pyspark.sql import functions as F

from parcelwise.functions import geometry
from parcelwise.operators import rings


def _square(x, y, side, hole=False):
    points = [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]
    points = points[::-1] if hole else points
    return [(*p, *q) for p, q in zip(points, points[1:] + points[:1], strict=True)]


CASES = {
    1: _square(0, 0, 10) + _square(2, 2, 6, True) + _square(4, 4, 2),  # a hole with an island
    2: _square(0, 0, 5) + _square(5, 5, 5),  # squares that touch in a corner
    3: [e for e in _square(0, 0, 10) if e[:2] != (0, 0)] + [(0, 0, 5, 0), (5, 0, 10, 0)] + [(5, 0, 4, 2), (4, 2, 6, 2), (6, 2, 5, 0)],  # a hole that touches the shell
    4: _square(0, 0, 1)[:3],  # torn
    5: _square(-3, 0, 4) + [(9, 9, 10, 10)],  # with a loose edge
}
FOUND = {1: (2, [0, 0, 1], 68.0, 72.0), 2: (2, [0, 1], 50.0, 40.0), 3: (1, [0, 0], 98.0, 40 + 2 + 2 * 5**0.5), 5: (1, [0], 16.0, 16.0)}


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(k, *map(float, e)) for k, case in CASES.items() for e in case]
    n = 100  # a ring of many edges, in a group of its own
    circle = [(float(i), 0.0) for i in range(n)] + [(float(n - 1 - i), 1.0 + i % 2) for i in range(n)]
    rows += [(6, *p, *q) for p, q in zip(circle, circle[1:] + circle[:1], strict=True)]
    return spark.createDataFrame(rows, "project_id int, x1 double, y1 double, x2 double, y2 double")


def test_polygons(spark, edges):
    made = rings.polygons(edges, ["project_id"]).select("project_id", "geom", geometry.area(F.col("geom")).alias("area"), geometry.length(F.col("geom")).alias("length")).collect()
    found = {r["project_id"]: r for r in made}
    assert set(found) == {1, 2, 3, 5, 6}
    for k, (parts, of, area, length) in FOUND.items():
        geom = found[k]["geom"]
        assert [r["part"] for r in geom] == of and len(set(of)) == parts
        assert (found[k]["area"], found[k]["length"]) == (pytest.approx(area), pytest.approx(length))
        for r in geom:
            points = [(p["x"], p["y"]) for p in r["pts"]]
            assert points[0] == points[-1] and len(set(points)) == len(points) - 1  # closed, and no corner twice
    assert [r["ring"] for r in found[1]["geom"]] == [0, 1, 0]
    assert len(found[6]["geom"][0]["pts"]) == 201


def test_places_on_a_ring(spark, edges):
    rows = rings.rings(edges.filter("project_id in (3, 6)"), ["project_id"]).orderBy("project_id", "ring", "seq").collect()
    at = {}
    for r in rows:
        key = r["project_id"], r["ring"]
        seq, start, end = at.get(key, (0, 0.0, (r["x1"], r["y1"])))
        assert r["seq"] == seq and r["start"] == pytest.approx(start, abs=1e-9) and (r["x1"], r["y1"]) == end
        at[key] = seq + 1, start + ((r["x2"] - r["x1"]) ** 2 + (r["y2"] - r["y1"]) ** 2) ** 0.5, (r["x2"], r["y2"])
    lengths = {(r["project_id"], r["ring"]): r["ring_length"] for r in rows}
    assert len(at) == 3 and all(lengths[k] == pytest.approx(v[1]) for k, v in at.items())


def test_no_edges(spark, edges):
    assert rings.polygons(edges.filter("false"), ["project_id"]).count() == 0
