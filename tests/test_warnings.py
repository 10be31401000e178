"""Warnings on frontage and blocks in the cases that the tables lack."""

from pyspark.sql import functions as F

from parcelwise.functions import geometry
from parcelwise.operators import blocks, frontage

ROW = "project_id bigint, feature_id bigint, macroarea string, quadra_id string, x double, y double, w double, h double"


def boxes(spark, *rows):
    frame = spark.createDataFrame(list(rows), ROW)
    return frame.withColumn("geom", F.when(F.col("w") > 0, geometry.box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))))


def test_frontage_warnings(spark):
    features = boxes(
        spark,
        (1, 1, "lote", "a", 0.0, 3.0, 10.0, 10.0),
        (1, 2, "lote", "a", 0.0, 40.0, 10.0, 10.0),
        (1, 3, "lote", "a", 0.0, 0.0, 0.0, 0.0),
        (2, 4, "lote", "a", 0.0, 3.0, 10.0, 10.0),
        (3, 5, "avl", None, 0.0, 3.0, 10.0, 10.0),
    )
    street = boxes(spark, (1, 9, "sistema_viario", None, -5.0, 0.0, 50.0, 2.0), (2, 9, "sistema_viario", None, 0.0, 0.0, 0.0, 0.0))
    found = {(r["project_id"], r["code"], r["feature_id"], r["indicator_code"]) for r in frontage.warnings(features, street).collect()}
    far = [(1, "lot_without_street_frontage", 2), (2, "lot_without_street_frontage", 4)]
    none = [(2, "no_road_footprint_for_frontage", 4), (3, "no_road_footprint_for_frontage", None)]
    assert found == {(*f, i) for f in far for i in frontage.DISTANCES} | {(*f, i) for f in none for i in (frontage.FRONTAGE, *frontage.DISTANCES)}


def test_block_warnings(spark):
    features = boxes(spark, (1, 1, "lote", "long", 0.0, 0.0, 200.0, 10.0), (1, 2, "lote", "long", 200.0, 0.0, 51.0, 10.0), (1, 3, "lote", "limit", 0.0, 50.0, 250.0, 10.0), (1, 4, "avl", "long", 300.0, 0.0, 10.0, 10.0))
    assert {(r["quadra_id"], r["feature_id"]) for r in blocks.warnings(features).collect()} == {("long", 1), ("long", 2)}
