"""Queries over lots along one street, whose frontages and walking distances have a closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.functions import geometry
from parcelwise.operators import frontage, roads
from parcelwise.plans.derived import PARCELS_SQL, parcels


def streets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A street south of each project's first block, 1 to 4 m away: its footprint, and its centreline with eight side streets."""
    projects = rows.select("project_id").distinct().withColumn("gap", (1 + F.col("project_id") % 4).cast("double"))
    near, far = -F.col("gap"), -F.col("gap") - 2
    footprint = projects.select("project_id", F.lit("S").alias("feature_id"), geometry.box(F.lit(-20), far, F.lit(120), near).alias("geom"))
    middle = near - 1
    main = projects.select("project_id", F.lit("M").alias("feature_id"), F.lit(roads.EXISTING).alias("road_status"), geometry.line(geometry.point(F.lit(-5), middle), geometry.point(F.lit(85), middle)).alias("geom"))
    stubs = projects.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    stubs = stubs.select("project_id", F.concat(F.lit("N"), "k").alias("feature_id"), F.lit(roads.EXISTING).alias("road_status"), geometry.line(geometry.point(F.col("k") * 10 + 5, middle), geometry.point(F.col("k") * 10 + 5, F.lit(-30))).alias("geom"))
    return footprint, main.unionByName(stubs)


def frontage_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parcels(spark, sf_dir)
    found = frontage.frontage_length(rows.filter("macroarea = 'lote'"), streets(rows)[0])
    return found.withColumn("value", F.round("value", 6))


def distance_non_residential(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parcels(spark, sf_dir)
    footprint, lines = streets(rows)
    return frontage.non_residential_distance(rows, footprint, roads.network(lines)).withColumn("value", F.round("value", 6))


def distance_green(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parcels(spark, sf_dir)
    footprint, lines = streets(rows)
    return frontage.green_distance(rows, footprint, roads.network(lines)).withColumn("value", F.round("value", 6))


def frontage_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets as above, but none in every fifth project."""
    rows = parcels(spark, sf_dir)
    return frontage.warnings(rows, streets(rows)[0].filter("project_id % 5 <> 0"))


_STREET = f"with {PARCELS_SQL}, f as (select *, 1 + project_id % 4 as gap, slot < 8 and project_id % 4 < 3 as faces from parcels), n as (select *, sqrt(power((3 - gap) / 2.0, 2) + power(gap + 1, 2)) as last_mile from f where faces)"


def _distance_sql(target: str) -> str:
    return f"""{_STREET} select o.project_id, o.feature_id, round(min(abs(o.slot - t.slot) * 10 + o.last_mile + t.last_mile), 6) as value
from n o left join n t on t.project_id = o.project_id and t.feature_id <> o.feature_id and {target}
where o.macroarea = 'lote' and o.land_use in ('residencial', 'misto') group by all"""


def queries() -> dict:
    return {f.__name__: f for f in (frontage_length, frontage_warnings, distance_non_residential, distance_green)}


def oracle_sql() -> dict[str, str]:
    return {
        "frontage_length": f"{_STREET} select project_id, feature_id, case when faces then 10.0 + 2 * (3 - gap) else 0 end::double as value from f where macroarea = 'lote'",
        "frontage_warnings": f"""{_STREET}, l as (select * from f where macroarea = 'lote'), d as (select unnest(['lots.distance_to_green_area', 'lots.distance_to_non_residential_use']) as indicator_code), i as (select * from d union all select 'lots.frontage_length')
select p.project_id, indicator_code, 'no_road_footprint_for_frontage' as code, 'info' as severity, l.feature_id from (select distinct project_id from f where project_id % 5 = 0) p cross join i left join l using (project_id)
union all select project_id, indicator_code, 'lot_without_street_frontage', 'info', feature_id from l, d where project_id % 5 = 0 or not faces""",
        "distance_non_residential": _distance_sql("t.macroarea = 'lote' and t.land_use <> 'residencial'"),
        "distance_green": _distance_sql("t.macroarea = 'avl'"),
    }
