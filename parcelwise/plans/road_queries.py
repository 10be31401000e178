"""Queries over road lattices, one for each part, whose graph has a closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.functions import geometry
from parcelwise.operators import roads
from parcelwise.session import table


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("project_id"), (1 + F.col("p_size") % 4).cast("int").alias("m"), (1 + F.col("p_partkey") % 3).cast("int").alias("n"))


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """m streets north and n streets east, 10 m apart and 5 m longer at each end; every other street east is proposed."""
    sizes = _sizes(spark, sf_dir)
    north = sizes.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    north = north.select("project_id", F.concat(F.lit("N"), "k").alias("feature_id"), F.lit(roads.EXISTING).alias("road_status"), geometry.line(geometry.point(F.col("k") * 10, F.lit(-5)), geometry.point(F.col("k") * 10, F.col("n") * 10 - 5)).alias("geom"))
    east = sizes.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    status = F.when(F.col("k") % 2 == 1, roads.PROPOSED).otherwise(roads.EXISTING)
    east = east.select("project_id", F.concat(F.lit("E"), "k").alias("feature_id"), status.alias("road_status"), geometry.line(geometry.point(F.lit(-5), F.col("k") * 10), geometry.point(F.col("m") * 10 - 5, F.col("k") * 10)).alias("geom"))
    return north.unionByName(east)


def road_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _sizes(spark, sf_dir)
    unlinks = sizes.filter("project_id % 4 = 0").select("project_id", F.lit("U").alias("feature_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    perimeter = sizes.select("project_id", F.lit(0).alias("feature_id"), geometry.box(F.lit(-1), F.lit(-1), F.lit(4), F.col("n") * 10).alias("geom"))
    edges = roads.network(lattice(spark, sf_dir), unlinks)
    found = roads.measures(edges, perimeter)
    return found.select("project_id", *(F.round(c, 6).alias(c) for c in ("total_length", "existing_length", "proposed_length", "link_node_ratio", "intersection_density")), "n_edges", "n_nodes", "intersections", "proposed_connections")


_SQL = """with s as (select p_partkey as project_id, (1 + p_size % 4)::bigint as m, (1 + p_partkey % 3)::bigint as n, case when p_partkey % 4 = 0 then 1 else 0 end as u from part),
g as (select *, m * n + 2 * (m + n) - u as n_nodes, m * (n + 1) + n * (m + 1) - 2 * u as n_edges from s)
select project_id, (20 * m * n)::double as total_length, (10 * m * n + (n + 1) // 2 * 10 * m)::double as existing_length, (n // 2 * 10 * m)::double as proposed_length,
  round(n_edges / n_nodes, 6) as link_node_ratio, round((n - u) * 1e6 / (5 * (10 * n + 1)), 6) as intersection_density, n_edges, n_nodes, m * n - u as intersections, m * (n // 2) as proposed_connections from g"""


def road_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattices, each with one of five faults: a line without length, one along another, a lone proposed one, one without a status, an unlink off all lines."""
    sizes = _sizes(spark, sf_dir)
    kind, m = F.col("project_id") % 5, F.col("m") * 10 - 5
    line = lambda x0, y0, x1, y1: geometry.line(geometry.point(F.lit(x0), F.lit(y0)), geometry.point(x1, F.lit(y1)))
    extra = {0: ("Z", line(3, 3, F.lit(3), 3)), 1: ("O", line(-2.5, 0, F.lit(2.5), 0)), 2: ("P", line(1000, 1000, F.lit(1010), 1000)), 3: ("S", line(-5, -2.5, m, -2.5))}
    name, geom = F.lit(None).cast("string"), F.lit(None).cast(geometry.GEOMETRY)
    for k, (said, made) in extra.items():
        name, geom = F.when(kind == k, said).otherwise(name), F.when(kind == k, made).otherwise(geom)
    status = F.when(kind == 2, roads.PROPOSED).when(kind != 3, roads.EXISTING)
    more = sizes.filter(kind < 4).select("project_id", name.alias("feature_id"), status.alias("road_status"), geom.alias("geom"))
    unlinks = sizes.filter(kind == 4).select("project_id", F.lit("U").alias("feature_id"), F.lit(1000.0).alias("x"), F.lit(1000.0).alias("y"))
    found = roads.network_warnings(lattice(spark, sf_dir).unionByName(more), unlinks)
    return found.select("project_id", "code", "severity", F.array_join("feature_ids", ",").alias("features"))


_WARNED = """with s as (select p_partkey as project_id, (1 + p_size % 4)::bigint as m, (1 + p_partkey % 3)::bigint as n, p_partkey % 5 as k from part)
select project_id, 'invalid_road_geometry' as code, 'warning' as severity, 'Z' as features from s where k = 0
union all select project_id, 'overlapping_road_centerlines', 'warning', 'E0,O' from s where k = 1
union all select project_id, 'disconnected_road_network', 'info', array_to_string(list_concat(list_transform(range(n), lambda i: 'E' || i), list_concat(list_transform(range(m), lambda i: 'N' || i), ['P'])), ',') from s where k = 2
union all select project_id, 'proposed_roads_not_connected_to_existing', 'warning', 'P' from s where k = 2
union all select project_id, 'road_status_missing', 'info', 'S' from s where k = 3
union all select project_id, 'invalid_road_unlink', 'warning', 'U' from s where k = 4"""


def queries() -> dict:
    return {"road_measures": road_measures, "road_warnings": road_warnings}


def oracle_sql() -> dict[str, str]:
    return {"road_measures": _SQL, "road_warnings": _WARNED}
