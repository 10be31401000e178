"""The rings of a dissolved perimeter, and the gaps between the roads that cross them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.operators import overlay
from parcelwise.operators import rings as assembly


def rings(perimeter: DataFrame) -> DataFrame:
    """Shells and holes of each project's dissolved perimeter, edge by edge, with the metres from the ring's start."""
    return assembly.union_rings(perimeter, ["project_id"])


def max_boundary_gap(perimeter: DataFrame, roads: DataFrame) -> DataFrame:
    """project_id, value: the largest stretch of a ring without a road across or along it; a ring without roads counts whole."""
    edges = rings(perimeter).withColumn("feature_id", F.col("ring")).withColumn("sid", F.struct("ring", "seq"))
    lines = overlay.segments(roads, ["project_id"]).withColumn("sid", F.struct(F.col("part").cast("bigint").alias("ring"), F.col("seq").cast("bigint").alias("seq")))
    pairs = overlay.neighbours(edges, lines, ["project_id"], "sid")
    cuts = pairs.select("project_id", "a_sid", F.explode(overlay.cut_places(overlay.side("a"), overlay.side("b"))).alias("t"), F.hypot(F.col("a_x2") - F.col("a_x1"), F.col("a_y2") - F.col("a_y1")).alias("size"))
    # ends of a perimeter edge that lie on a road: the two ends of an overlap
    ends = pairs.select("project_id", "a_sid", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"), F.hypot(F.col("a_x2") - F.col("a_x1"), F.col("a_y2") - F.col("a_y1")).alias("size"), *(F.col(f"{p}_{c}") for p in "ab" for c in ("x1", "y1", "x2", "y2")))
    on = {"x1": F.col("a_x1") + (F.col("a_x2") - F.col("a_x1")) * F.col("t"), "y1": F.col("a_y1") + (F.col("a_y2") - F.col("a_y1")) * F.col("t")}
    touching = overlay.segment_distance2(on | {"x2": on["x1"] + 1e-9, "y2": on["y1"]}, overlay.side("b")) <= overlay.SNAP**2
    places = cuts.union(ends.filter(touching).select("project_id", "a_sid", "t", "size"))
    starts = edges.select("project_id", F.col("sid").alias("a_sid"), "start", "ring_length")
    found = places.join(starts, ["project_id", "a_sid"]).select("project_id", F.col("a_sid.ring").alias("ring"), "ring_length", F.round(F.pmod(F.col("start") + F.col("t") * F.col("size"), F.col("ring_length")), 6).alias("position")).distinct()
    gaps = overlay.largest_gap(found, ["project_id", "ring"])
    lengths = edges.groupBy("project_id", "ring").agg(F.first("ring_length").alias("ring_length"))
    each = lengths.join(gaps, ["project_id", "ring"], "left").withColumn("gap", F.coalesce("gap", "ring_length"))
    return each.groupBy("project_id").agg(F.max("gap").alias("value"))
