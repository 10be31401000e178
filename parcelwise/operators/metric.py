"""Features in metres: one UTM zone for each project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import crs, geometry
from parcelwise.session import spread


def project_zones(features: DataFrame) -> DataFrame:
    """project_id and epsg of features in degrees; null where no zone holds the whole extent."""
    boxes = spread(features.select("project_id", geometry.bounds(F.col("geom")).alias("b")))
    extent = spread(boxes.groupBy("project_id").agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1")))
    return extent.select("project_id", crs.select_epsg(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).cast("int").alias("epsg"))


def to_metres(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The features projected once, each project in its zone (epsg), as files that all indicators read; and the projects without a zone."""
    rows = spread(features)
    zones = spread(project_zones(rows))
    placed = rows.join(zones.filter("epsg is not null"), "project_id")
    return spread(placed.withColumn("geom", geometry.map_points(F.col("geom"), lambda x, y: crs.to_utm(x, y, F.col("epsg"))))), zones.filter("epsg is null").select("project_id")
