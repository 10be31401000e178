"""Frontages of small projects in numpy are those of the joins, and large projects still go by the joins."""

import math
import random

import pytest
from pyspark.sql import functions as F

from parcelwise.functions import geometry
from parcelwise.operators import frontage

COLUMNS = ["project_id", "feature_id", "part", "ring", "from", "to"]


def _ring(part, number, points):
    return part, number, [(float(x), float(y)) for x, y in [*points, points[0]]]


def _shape(rng, sides, x, y, size, number=0):
    turn = rng.uniform(0, 6)
    return _ring(0, number, [(x + size * math.cos(turn + 2 * math.pi * k / sides), y + size * math.sin(turn + 2 * math.pi * k / sides)) for k in range(sides)])


@pytest.fixture(scope="module")
def layers(spark):
    rng = random.Random(7)
    lots, roads = [], []
    for k in range(5):
        for n in range(25):
            x, y = rng.uniform(0, 60), rng.uniform(0, 60)
            geom = [_shape(rng, rng.choice((3, 4, 4, 7)), x, y, rng.uniform(2, 6))]
            if n % 5 == 0:  # a hole, out of order, and a second part
                geom = [_shape(rng, 3, x, y, 1.0, number=1), *geom, (1, *_shape(rng, 5, x + 9, y, 2.0)[1:])]
            lots.append((k, f"L{n}", geom))
        lots.append((k, "side", [_ring(0, 0, [(0, -3), (50, -3), (50, -1), (0, -1)])]))  # along the street, at its reach
        roads.append((k, 1, [_ring(0, 0, [(-5, 0), (65, 0), (65, 5), (-5, 5)])]))
        roads.append((k, 2, [_shape(rng, 6, 30, 30, 12.0), _shape(rng, 4, 30, 30, 5.0, number=1)]))
    roads.append((0, 3, [_shape(rng, 4200, 50, 50, 8.0)]))  # a project too large for one task
    return spark.createDataFrame(lots, f"project_id bigint, feature_id string, geom {geometry.GEOMETRY}"), spark.createDataFrame(roads, f"project_id bigint, feature_id int, geom {geometry.GEOMETRY}")


def _rows(frame):
    return sorted(tuple(r) for r in frame.select(COLUMNS).collect())


def _same(found, joined):
    assert len(found) == len(joined)
    for a, b in zip(found, joined, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-6)


def test_frontages_are_those_of_the_joins(spark, layers):
    lots, roads = layers
    small = roads.filter("feature_id <> 3")
    found = _rows(frontage.frontage_parts(lots, small))
    assert len(found) > 40 and {r[2:4] for r in found} >= {(0, 0), (1, 0)}
    _same(found, _rows(frontage.joined_frontage_parts(lots, small)))


def test_large_projects_go_by_the_joins(spark, layers, monkeypatch):
    lots, roads = (x.filter("project_id in (0, 1)") for x in layers)
    seen, joined = [], frontage.joined_frontage_parts

    def watched(lots, footprint, reach):
        seen.append([r[0] for r in lots.select("project_id").distinct().collect()])
        return joined(lots, footprint, reach)

    monkeypatch.setattr(frontage, "joined_frontage_parts", watched)
    found = frontage.frontage_parts(lots, roads).filter("project_id = 1")
    assert seen == [[0]]
    _same(_rows(found), _rows(joined(*(x.filter("project_id = 1") for x in (lots, roads)))))


def test_small_projects_are_not_joined(spark, layers, monkeypatch):
    monkeypatch.setattr(frontage, "joined_frontage_parts", None)
    lots, roads = (x.filter("project_id > 0") for x in layers)
    values = frontage.frontage_length(lots, roads)
    assert values.count() == lots.count() and values.filter("feature_id = 'side' and value > 90").count() == 4
    assert frontage.frontage_length(lots, roads.filter("false")).agg(F.sum("value")).first()[0] == 0
