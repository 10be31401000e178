"""Networks of small projects in numpy give the edges and warnings of the joins, and large projects still go by the joins."""

import random

import pytest
from pyspark.sql import functions as F

from parcelwise.functions import geometry
from parcelwise.operators import roads, small_roads

SIZE = 9


def _lines(rng, k):
    """Lines that cross, bend, nearly touch, run along each other, or have no length."""
    for n in range(SIZE):
        x, y = rng.uniform(0, 40), rng.uniform(0, 40)
        points = [(x, y)]
        for _ in range(rng.choice((1, 1, 2, 4))):
            points.append((rng.uniform(0, 40), rng.uniform(0, 40)))
        if rng.random() < 0.2:
            points[-1] = (points[0][0] + rng.uniform(0, 1), points[0][1])
        yield f"L{n}", rng.choice((roads.EXISTING, roads.PROPOSED, None)), [(0, 0, points)]
    yield "along", roads.EXISTING, [(0, 0, [(0.0, 60.0), (20.0, 60.0)]), (1, 0, [(5.0, 60.0), (9.0, 60.0), (9.0, 70.0)])]
    yield "over", roads.PROPOSED, [(0, 0, [(4.0, 60.0), (8.0, 60.0)])]
    yield "tee", roads.EXISTING, [(0, 0, [(15.0, 61.5), (15.0, 66.0)])]
    yield "far", roads.PROPOSED, [(0, 0, [(500.0, 500.0), (500.0, 510.0), (500.0, 520.0)])]
    yield "none", roads.EXISTING, [(0, 0, [(1.0, 1.0), (1.0, 1.0)])]
    if k == 0:  # a project too large for one task
        yield "long", roads.EXISTING, [(0, 0, [(float(i), 100.0 + i % 2) for i in range(1100)])]


@pytest.fixture(scope="module")
def layers(spark):
    rng = random.Random(4)
    rows = [(k, *r) for k in range(6) for r in _lines(rng, k)]
    lines = spark.createDataFrame(rows, f"project_id bigint, feature_id string, road_status string, geom {geometry.GEOMETRY}")
    points = [(k, f"U{n}", rng.uniform(0, 40), rng.uniform(0, 40)) for k in range(6) for n in range(12)] + [(9, "lost", 0.0, 0.0), (1, "U1", 500.0, 500.0)]
    return lines, spark.createDataFrame(points, "project_id bigint, feature_id string, x double, y double")


def _rows(frame, digits=4):
    return sorted((tuple(round(v, digits) + 0.0 if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r) for r in frame.collect()), key=repr)


def test_edges_are_those_of_the_joins(spark, layers):
    columns = ["project_id", "feature_id", "road_status", "x1", "y1", "x2", "y2", "length"]
    found, joined = (_rows(made(*layers, 3.0).select(columns)) for made in (roads.network, roads.joined_network))
    assert len(found) > 400 and found == joined


def test_warnings_are_those_of_the_joins(spark, layers):
    lines, unlinks = layers
    found = roads.network_warnings(lines, unlinks, 3.0).select("project_id", "code", "feature_ids")
    joined = roads.warnings(lines).select("project_id", "code", F.array("feature_id").alias("feature_ids")).unionByName(roads.joined_warnings(lines, unlinks, 3.0))
    assert _rows(found) == _rows(joined)
    assert {r["code"] for r in found.collect()} == {"invalid_road_geometry", "road_status_missing", "invalid_road_unlink", "overlapping_road_centerlines", "disconnected_road_network", "proposed_roads_not_connected_to_existing"}


def test_small_networks_take_no_joins(spark, layers, monkeypatch):
    def never(*_):
        raise AssertionError("a join for small projects")

    for name in ("_noded", "components", "joined_network"):
        monkeypatch.setattr(roads, name, never)
    small = layers[0].filter("project_id > 0")
    assert roads.network(small).filter("feature_id = 'far'").count() == 5
    assert roads.network_warnings(small, layers[1]).filter("code = 'invalid_road_unlink' and array_contains(feature_ids, 'lost')").count() == 1


def test_lines_of_one_number_go_by_the_joins(spark, layers):
    again = layers[0].filter("project_id = 1 and feature_id in ('tee', 'far')")
    done, large, _ = roads._settled(again.union(again.filter("feature_id = 'tee'")), None, 2.0, "edges")
    assert done.count() == 0 and large.count() == 3


def test_labels():
    import numpy as np

    a, b = np.array([0, 2, 5, 7, 6]), np.array([2, 4, 6, 6, 8])
    assert small_roads.labels(a, b, 10).tolist() == [0, 1, 0, 3, 0, 5, 5, 5, 5, 9]
