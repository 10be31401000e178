"""Unions, rings and polygons of small groups in numpy give what the joins give, and large groups still go by the joins."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelwise.functions import geometry
from parcelwise.operators import blocks, overlay, rings, small

KEYS = ["project_id"]


def _ring(part, number, points):
    return part, number, [(float(x), float(y)) for x, y in [*points, points[0]]]


def _box(x0, y0, x1, y1, part=0, number=0, back=False):
    points = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return _ring(part, number, points[::-1] if back else points)


def _circle(n):
    return _ring(0, 0, [(20 + 15 * np.cos(2 * np.pi * k / n), 20 + 15 * np.sin(2 * np.pi * k / n)) for k in range(n)])


CASES = {
    1: {"a": [_box(0, 0, 10, 10)], "b": [_box(10, 0, 20, 5, back=True)], "c": [_box(20, 5, 30, 10)]},  # side by side, and in a corner
    2: {"a": [_box(0, 0, 10, 10)], "b": [_box(5, 5, 15, 15)], "c": [_box(6, 6, 9, 9)]},  # over and in each other
    3: {"a": [_box(0, 0, 10, 10), _box(2, 2, 8, 8, number=1)], "b": [_box(3, 3, 5, 5)], "c": [_box(5, 5, 6, 6)]},  # a hole with islands that touch
    4: {"a": [_box(0, 0, 10, 10), _box(2, 2, 8, 8, number=1)], "b": [_box(2, 2, 8, 8)]},  # a hole that is filled
    5: {"a": [_box(0, 0, 10, 10)], "b": [_box(0, 0, 10, 10)]},  # copies
    6: {"a": [_box(0, 0, 4, 4), _box(50, 50, 54, 54, part=1)], "b": [_ring(0, 0, [(4, 4), (8, 4), (6, 9)])], "c": [_ring(0, 0, [(2.5, -1), (3.3, -1), (3.1, 5)])]},  # parts, slants
    7: {"a": [_box(k, 0, k + 1, 9) for k in (0,)], **{str(k): [_box(k, k % 2, k + 1, 9 - k % 3)] for k in range(1, 9)}},  # lots
    8: {"a": [_circle(1100)], "b": [_box(0, 0, 20, 20)]},  # too large for one task
    9: {"a": [_circle(40)], "b": [_box(0, 0, 20, 20)]},
}


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [(k, name, geom) for k, case in CASES.items() for name, geom in case.items()]
    return spark.createDataFrame(rows, f"project_id bigint, feature_id string, geom {geometry.GEOMETRY}")


def _edges(frame):
    return sorted(tuple(r[c] for c in ("project_id", "x1", "y1", "x2", "y2")) for r in frame.collect())


def test_unions_are_those_of_the_joins(spark, shapes):
    found, joined = _edges(overlay.union_edges(shapes, KEYS)), _edges(overlay.joined_edges(shapes, KEYS))
    assert len(found) == len(joined) > 900
    assert np.allclose(found, joined, atol=2e-6)
    assert overlay.united(shapes, KEYS, "edges")[1].select("project_id").distinct().collect() == [(8,)]


def test_polygons_are_those_of_the_joins(spark, shapes):
    made = {r["project_id"]: r for r in rings.union_polygons(shapes, KEYS).collect()}
    joined = {r["project_id"]: r["geom"] for r in rings.polygons(overlay.joined_edges(shapes, KEYS), KEYS).collect()}
    assert set(made) == set(joined) == set(CASES)
    for k, r in made.items():
        assert r["members"] == len(CASES[k])
        assert [(a["part"], a["ring"], len(a["pts"])) for a in r["geom"]] == [(b["part"], b["ring"], len(b["pts"])) for b in joined[k]]
        for a, b in zip(r["geom"], joined[k], strict=True):
            assert np.allclose(a["pts"], b["pts"], atol=2e-6)


def test_rings_are_those_of_the_joins(spark, shapes):
    columns = ["project_id", "x1", "y1", "x2", "y2", "seq", "start", "ring_length"]
    one, two = (sorted(map(tuple, x.select(columns).collect())) for x in (rings.union_rings(shapes, KEYS), rings.rings(overlay.joined_edges(shapes, KEYS), KEYS)))
    assert len(one) == len(two) and np.allclose(one, two, atol=2e-5)


def test_loose_edges_give_the_same_polygons(spark):
    from test_rings import CASES as LOOSE

    rows = np.array([(k, *map(float, e)) for k, case in LOOSE.items() for e in case])
    group, geom = small.polygons(rows[:, 0].astype(int), {c: rows[:, k + 1] for k, c in enumerate(small.ENDS)})
    frame = spark.createDataFrame([(int(k), *map(float, e)) for k, case in LOOSE.items() for e in case], "project_id int, x1 double, y1 double, x2 double, y2 double")
    joined = {r["project_id"]: r["geom"] for r in rings.polygons(frame, KEYS).collect()}
    assert dict(zip(group.tolist(), [[(r["part"], r["ring"], [(p["x"], p["y"]) for p in r["pts"]]) for r in g] for g in geom.to_pylist()], strict=True)) == {k: [(r["part"], r["ring"], [(p["x"], p["y"]) for p in r["pts"]]) for r in g] for k, g in joined.items()}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_whole_groups(size):
    keys = [1, 1, 2, 3, 3, 3, 3, 3, 4, None, None, 5, 6, 6, 6, 6]
    rows = pa.RecordBatch.from_pydict({"k": pa.array(keys, pa.int64()), "v": list(range(len(keys)))})
    batches = [rows.slice(k, size) for k in range(0, len(keys), size)]
    done, large = [], []
    for some, group in small.whole_groups(iter(batches), ["k"], lambda r, _: np.ones(r.num_rows), 3):
        assert group is None or (group[0] == 0 and len(set(zip(group.tolist(), some["k"].to_pylist(), strict=True))) == group[-1] + 1)
        (large if group is None else done).extend(zip(some["k"].to_pylist(), some["v"].to_pylist(), strict=True))
    every = list(zip(keys, range(len(keys)), strict=True))
    assert sorted(large, key=repr) == sorted((r for r in every if r[0] in (3, 6)), key=repr)
    assert sorted(done, key=repr) == sorted((r for r in every if r[0] not in (3, 6)), key=repr)


HELD = {
    "a": [_box(1, 1, 4, 4)],
    "b": [_box(0, 0, 10, 10)],
    "c": [_box(2, 2, 8, 8)],
    "d": [_box(0, 0, 20, 5)],
    "e": [_box(5, 5, 12, 9)],
    "f": [_box(1, 1, 9, 9), _box(2, 2, 8, 8, number=1)],
    "g": [_box(1, 1, 2, 2), _box(20, 20, 22, 23, part=1)],
    "h": [_ring(0, 0, [(16, 20), (20, 16), (24, 20), (20, 24)])],
    "i": [_ring(0, 0, [(3, 3), (5, 3), (3, 3)])],
}


@pytest.fixture(scope="module")
def held(spark, shapes):
    rows = spark.createDataFrame(list(HELD.items()), f"feature_id string, geom {geometry.GEOMETRY}")
    return shapes.select("project_id").distinct().crossJoin(rows)


def test_containment_is_that_of_the_joins(spark, shapes, held):
    found, joined = ({tuple(r) for r in made(shapes, held, KEYS).select("project_id", "outer", "inner").collect()} for made in (overlay.holding, overlay.joined_holding))
    assert found == joined and len(found) > 30
    assert {(3, "a", "f"), (4, "a", "f"), (5, "b", "b"), (8, "a", "h"), (2, "a", "c")} <= found
    assert not {(3, "a", "a"), (4, "a", "c"), (7, "a", "a")} & found


def test_containment_of_lines_is_that_of_the_joins(spark, shapes, held):
    typed = held.withColumn("geom_type", F.when(F.col("feature_id") == "i", "LineString").otherwise("Polygon"))
    typed = typed.filter("project_id not in (8, 9) and (project_id < 4 or feature_id <> 'i')")
    found, joined = ({tuple(r) for r in made(shapes, typed, KEYS).select("project_id", "outer", "inner").collect()} for made in (overlay.holding, overlay.joined_holding))
    assert found == joined and {(1, "a", "i"), (2, "a", "i")} <= found


def test_small_groups_are_not_joined_for_containment(spark, shapes, held, monkeypatch):
    monkeypatch.setattr(overlay, "joined_holding", None)
    assert overlay.related(shapes, held, KEYS, "contains").count() > 5
    assert overlay.related(shapes, held, KEYS, "within").count() > 3


def test_areas(spark):
    geoms = [r for case in CASES.values() for r in case.values()] + list(HELD.values()) + [[], None, [(0, 0, [(0.0, 0.0), (1.0, None), (1.0, 1.0), (0.0, 0.0)])], [_box(0, 0, 2, 2, number=1)]]
    rows = spark.createDataFrame([(g,) for g in geoms], f"geom {geometry.GEOMETRY}")
    expected = [r[0] for r in rows.select(geometry.area(F.col("geom")).isNotNull()).collect()]
    found = pa.array([None if g is None else [dict(zip(("part", "ring", "pts"), (p, k, [dict(zip("xy", v, strict=True)) for v in pts]), strict=True)) for p, k, pts in g] for g in geoms], small._GEOMETRY)
    assert small.solid(found).tolist() == expected and small.solid(found.slice(3, 4)).tolist() == expected[3:7]


def test_small_blocks_take_no_rounds_of_pointers(spark, shapes, monkeypatch):
    def never(*_):
        raise AssertionError("a join for small groups")

    for module, name in ((rings, "_labels"), (overlay, "joined_edges")):
        monkeypatch.setattr(module, name, never)
    lots = shapes.filter("project_id <> 8").withColumns({"quadra_id": F.lit("Q"), "macroarea": F.lit("lote")})
    made, children = blocks.derive_blocks(lots)
    assert {r["project_id"]: r["quantidade_lotes"] for r in made.collect()} == {k: len(v) for k, v in CASES.items() if k != 8}
    assert children.filter("relation_method = 'attribute'").count() == lots.count()
