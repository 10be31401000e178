"""The one table of all indicators: territory sums against the single operators, and what odd layers give."""

from functools import reduce

from conftest import same
from pyspark.sql import functions as F

from parcelwise.functions import geometry
from parcelwise.operators import suite, territory

SCHEMA = "project_id bigint, feature_id bigint, macroarea string, parcelavel boolean, land_use string, quadra_id string, ca_max double, reference_area_m2 double, deep double"
ROWS = [
    (1, 1, "lote", True, "comercial", "A", 2.0, None, 10.0),
    (1, 2, "lote", True, "residencial", "A", None, 100.0, 10.0),
    (1, 3, "avl", None, None, None, None, -5.0, 3.0),
    (1, 4, "app", False, None, None, None, None, 0.0),  # no area
    (2, 1, "lote", None, "misto", "A", -1.0, None, 5.0),  # a tie of uses, none of them parcelable
    (2, 2, "lote", None, "comercial", "B", 1.5, None, 5.0),
    (3, 1, None, True, "misto", None, None, None, 4.0),  # no lot
    (4, 1, "lote", True, None, None, 1.0, None, 0.0),  # a lot without a usable geometry
]


def _features(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.withColumn("geom", geometry.box(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.col("deep"))).drop("deep")


def test_territory_rows_are_those_of_the_single_operators(spark):
    features = _features(spark, ROWS)
    alone = reduce(lambda a, b: a.unionByName(b), (f(features) for f in territory.INDICATORS.values()))
    found = suite.territory_rows(features)
    assert found.filter("sub_field is not null").count() == 0
    same(found.drop("sub_field").toPandas(), alone.toPandas())


def test_no_features_no_rows(spark):
    assert suite.territory_rows(_features(spark, [])).count() == 0


def test_a_value_row_names_its_part(spark):
    from parcelwise.operators import catalog

    values = spark.createDataFrame([(1, "quadras.stats", "A", "area_m2", 2.5, None), (1, "territorial.perimeter", None, None, 4.0, None)], "project_id bigint, indicator_code string, key string, sub_field string, value double, label string")
    found = {r["indicator_code"]: r["value_json"] for r in catalog.result_rows(values, "run").collect()}
    assert found == {"quadras.stats": '{"key":"A","sub_field":"area_m2","value":2.5}', "territorial.perimeter": '{"key":null,"value":4.0}'}
