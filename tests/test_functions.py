import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelwise.functions import crs, geometry, text
from parcelwise.operators import blocks, mapping, metric, overlay
from parcelwise.sources import layers, uploads


def value(spark, column, **row):
    frame = spark.range(1)
    for k, v in row.items():
        frame = frame.withColumn(k, F.lit(v))
    return frame.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "key"), [("SISTEMA VIÁRIO", "sistemaviario"), (" sistema_viario ", "sistemaviario"), ("Açaí-1", "acai1"), ("", ""), (None, None)])
def test_normalize_key(spark, raw, key):
    assert value(spark, text.normalize_key(F.lit(raw).cast("string"))) == key


@pytest.mark.parametrize(("raw", "good"), [("MÃ\x8dNIMO", "MÍNIMO"), ("Área", "Área"), ("€", "€"), ("plain", "plain"), (None, None)])
def test_mojibake(spark, raw, good):
    assert value(spark, text.repair_mojibake(F.lit(raw).cast("string"))) == good


@pytest.mark.parametrize(("raw", "use"), [("Residencial", "residencial"), ("Residencial;Comercial", "misto"), ("comercial; Comercial", "comercial"), ("(none)", None), (None, None)])
def test_land_use(spark, raw, use):
    assert value(spark, text.land_use(F.lit(raw).cast("string"))) == use


@pytest.mark.parametrize(("raw", "area"), [("1338.63 m²", 1338.63), ("448", 448.0), ("-3", -3.0), ("12 ha", None), ("", None), (None, None)])
def test_area_text(spark, raw, area):
    found = value(spark, text.to_area(F.lit(raw).cast("string")))
    assert (float(found) if found is not None else None) == area


def test_golden_square(spark, tmp_path):
    """A square of 100 m in UTM zone 22S, through a GeoJSON file, measures as it should."""
    corners = [(500000.0, 7000000.0), (500100.0, 7000000.0), (500100.0, 7000100.0), (500000.0, 7000100.0), (500000.0, 7000000.0)]
    back = spark.createDataFrame(corners, "x double, y double").select(crs.from_utm(F.col("x"), F.col("y"), F.lit(32722)).alias("p")).collect()
    ring = [[r["p"]["x"], r["p"]["y"]] for r in back]
    feature = {"type": "Feature", "id": "perimeter-1", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"% MÃ\x8dNIMO": "1", "a": 0.10}}
    (tmp_path / "layer.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    rows = uploads.read_geojson(spark, str(tmp_path / "layer.geojson"))
    assert "% MÍNIMO" in rows.first()["source"]
    rows, failed = metric.to_metres(rows.withColumn("project_id", F.lit(1)).withColumn("feature_id", F.col("external_id")))
    found = blocks.perimeter(rows).first()
    assert failed.count() == 0
    assert rows.first()["epsg"] == 32722
    assert found["area"] == pytest.approx(10000, abs=0.01)
    assert found["length"] == pytest.approx(400, abs=0.01)
    assert found["compactness"] == pytest.approx(math.pi / 4, abs=1e-6)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 5), st.integers(1, 5)), min_size=1, max_size=5))
def test_union_of_rectangles(spark, boxes):
    cells = {(i, j) for x, y, w, h in boxes for i in range(x, x + w) for j in range(y, y + h)}
    border = sum((i + a, j + b) not in cells for i, j in cells for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
    rows = spark.createDataFrame([(1, k, *map(float, b)) for k, b in enumerate(boxes)], "project_id int, feature_id int, x double, y double, w double, h double")
    rows = rows.withColumn("geom", geometry.box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")))
    found = overlay.dissolved(rows, ["project_id"]).first()
    assert (found["area"], found["length"]) == pytest.approx((len(cells), border))


@pytest.mark.parametrize(("points", "turn"), [([(0, 0), (10, 0), (10, 50), (0, 50)], 0), ([(0, 0), (50, 0), (50, 10), (0, 10)], 90), ([(0, 0), (10, 0), (10, 10), (0, 10)], 90), ([(0, 0), (30, 30), (27, 33), (-3, 3)], 45)])
def test_orientation(points, turn):
    import numpy as np

    assert blocks.smallest_rectangle(np.array(points, float))[2] == pytest.approx(turn, abs=1e-6)


def test_mapping_leaves_other_columns(spark):
    rows = spark.createDataFrame([(1, {"m": "Lote", "a": "5 m²"}, "avl")], "feature_id int, source map<string,string>, macroarea string")
    found = mapping.map_attributes(rows, {"reference_area_m2": "a"}).first()
    assert found["macroarea"] == "avl" and float(found["reference_area_m2"]) == 5 and found["mapped"] == {"reference_area_m2": "5 m²"}


def test_suggested_mapping(spark):
    """The columns of the two known kinds of export."""
    names = {1: ["Comments", "Area", "P_Área de Projeto", "QUADRA", "Name"], 2: ["TIPO DE MACROÁREA", "uso_do_solo", "07.COEFICIENTE DE APROVEITAMENTO"], 3: ["TIPO DE MACROÁREA", "Comments"], 4: ["Name"]}
    fields = spark.createDataFrame([(k, n) for k, ns in names.items() for n in ns], "layer_id int, field string")
    found = {(r["layer_id"], r["target"]): r["field"] for r in mapping.suggest_mapping(fields).collect()}
    assert found == {
        (1, "macroarea"): "Comments",
        (1, "reference_area_m2"): "Area",
        (1, "parcelavel"): "P_Área de Projeto",
        (1, "quadra_id"): "QUADRA",
        (2, "macroarea"): "TIPO DE MACROÁREA",
        (2, "land_use"): "uso_do_solo",
        (2, "ca_max"): "07.COEFICIENTE DE APROVEITAMENTO",
        (3, "macroarea"): "Comments",
    }


def test_attribute_table(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿Name;Area\nL-1;3\nL-2;4\n", encoding="utf-8")
    rows, _ = uploads.read_tables(spark, str(tmp_path / "t.csv"))
    assert [r["attributes"] for r in rows.orderBy("row").collect()] == [{"Name": "L-1", "Area": "3"}, {"Name": "L-2", "Area": "4"}]
    lines = spark.createDataFrame([(1, 1, ["a", "b", "a"]), (1, 2, ["x"]), (1, 3, ["x", "y", "z"])], "table_id int, row int, cells array<string>")
    assert {(r["fault"], r["where"]) for r in layers.attribute_faults(lines).collect()} == {("ragged_row", "2"), ("duplicate_column", "a")}


def test_largest_gap(spark):
    rows = spark.createDataFrame([(1, 400.0, p) for p in (10.0, 30.0, 390.0)], "project_id int, ring_length double, position double")
    assert overlay.largest_gap(rows, ["project_id"]).first()["gap"] == 360.0


def test_drop_layer(spark):
    rows = spark.createDataFrame([(1, "a", None, "x"), (2, "b", "a", "attribute"), (2, "c", None, "x")], "layer_id int, feature_id string, parent_feature_id string, relation_method string")
    found = {r["feature_id"]: (r["parent_feature_id"], r["relation_method"]) for r in layers.drop_layer(rows, 1).collect()}
    assert found == {"b": (None, "unresolved"), "c": (None, "x")}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert {n for n in __spark_entry__.oracle_sql()} <= {n for n in __spark_entry__.queries()}
