"""Queries over the catalog, errors, warnings, validity and result rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelwise.functions import geometry
from parcelwise.operators import catalog, results, territory, validity
from parcelwise.plans import attribute_queries
from parcelwise.plans.derived import PARCELS_SQL, parcels
from parcelwise.session import table
from parcelwise.sources import layers

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


_P = f"with {PARCELS_SQL}"
_SMALL = f"with {PARCELS_SQL.replace('areas as (select *,', 'areas as (select * replace (feature_id // 4 as project_id),')}"
_LAYERS = "has as (select distinct user_id as project_id, case event_type when 'view' then 'perimetro' when 'click' then 'territorio' when 'purchase' then 'sistema_viario' else 'quadras' end as layer_type from events where user_id % 5 > 0 or event_type <> 'view')"
_CATALOG = "catalog as (select * from (values " + ", ".join(f"('{code}', '{theme}', '{unit}', {required}, {f"'{key}'" if key else 'null'})" for code, theme, unit, _, required, _, key, _ in catalog.rows()) + ") as t(indicator_code, theme, unit, required, feature_key))"


def _small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels in projects of a few, in which often something is missing."""
    return parcels(spark, sf_dir).withColumn("project_id", F.floor(F.col("feature_id") / 4).cast("bigint"))


def _has(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of projects that events stand for; every fifth project has no perimeter."""
    kind = F.when(F.col("event_type") == "view", "perimetro").when(F.col("event_type") == "click", "territorio").when(F.col("event_type") == "purchase", "sistema_viario").otherwise("quadras")
    rows = table(spark, sf_dir, "events").filter((F.col("user_id") % 5 > 0) | (F.col("event_type") != "view"))
    return rows.select(F.col("user_id").alias("project_id"), kind.alias("layer_type")).distinct()


@query(f"with {_LAYERS}, {_CATALOG}, l as (select project_id, coalesce(has, []) as has from (select distinct user_id as project_id from events union select -1) left join (select project_id, list(layer_type) as has from has group by 1) using (project_id)) select project_id, indicator_code, theme, len(list_filter(required, lambda x: not list_contains(has, x)))::int as n_missing from l, catalog")
def runnable_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id")).union(spark.range(1).select((-F.col("id") - 1).alias("project_id")))
    return catalog.runnable(_has(spark, sf_dir), projects=projects).select("project_id", "indicator_code", "theme", F.size("missing").alias("n_missing"))


@query(f"with {_LAYERS}, {_CATALOG} select project_id, layer_type, indicator_code from has join catalog on layer_type = case feature_key when 'feature_id' then 'territorio' when 'quadra_id' then 'quadras' end")
def compatible_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.compatible(_has(spark, sf_dir)).select("project_id", "layer_type", "indicator_code")


_RESULTS = "known as (select * from (values " + ", ".join(f"('{code}', '{theme}', '{unit}', '{catalog.RESULT_VERSIONS.get(code, version)}', '{','.join(catalog.result_layers(code, required, optional))}')" for code, theme, unit, version, required, optional, _, _ in catalog.rows()) + ") as t(indicator_code, theme, unit, formula_version, layers))"


@query(f"with {_RESULTS}, v as ({attribute_queries.oracle_sql()['indicator_values']}) select project_id, indicator_code, theme, unit, formula_version, layers, key, value, label from v join known using (indicator_code)")
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of all indicators of territory features, each with its own version and layers."""
    rows = catalog.result_rows(attribute_queries.indicator_values(spark, sf_dir), "run")
    return rows.select("project_id", "indicator_code", "theme", "unit", "formula_version", F.array_join("source_layers", ",").alias("layers"), "key", "value", "label")


@query(f"""{_P}, v as (select project_id, land_use as key, round(sum(area), 6) as value from areas where macroarea = 'lote' and land_use is not null group by all)
select project_id, feature_id, value from parcels join v using (project_id) where key = land_use""")
def category_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels with the area of their use, the names written otherwise on either side."""
    rows = parcels(spark, sf_dir)
    values = territory.land_use_area(rows).withColumn("key", F.concat(F.lit("  "), F.initcap("key"), F.lit(" "))).withColumn("value", F.round("value", 6))
    return catalog.category_features(rows, values, "land_use").select("project_id", "feature_id", "value")


@query(f"""{_SMALL}, s as (select project_id, count(case when macroarea = 'lote' then 1 end) as lots, coalesce(sum(case when coalesce(macroarea, 'nulo') <> 'lote' then area end), 0) as open from areas group by project_id),
c as (select unnest(['max_computable_area', 'lot_count_with_ca', 'ca_coverage', 'built_open_ratio']) as name)
select project_id, 'density.' || name as indicator_code, 'no_valid_lot' as error from s, c where lots = 0 union all select project_id, 'density.built_open_ratio', 'no_open_area' from s where lots > 0 and open <= 0
union all select project_id, e, 'no_perimeter_area' from (select distinct project_id from areas where project_id % 3 = 0), (values ('green_areas.percent_of_project'), ('green_areas.percent_of_project_with_app')) as t(e)""")
def indicator_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of small projects of which every third has no perimeter."""
    rows = _small(spark, sf_dir)
    whole = rows.select("project_id").distinct().filter("project_id % 3 <> 0").withColumn("value", F.lit(1.0))
    return territory.errors(rows, whole)


@query(f"""{_SMALL}, s as (select project_id, sum(case when parcelavel then area end) as parcelable, count(case when macroarea = 'lote' and land_use in ('comercial', 'servicos', 'institucional', 'industrial') and ca_max >= 0 then 1 end) as a,
  count(case when macroarea = 'lote' and land_use <> 'residencial' then 1 end) as b, count(case when macroarea = 'avl' then 1 end) as c from areas group by project_id),
u as (select project_id, land_use, sum(area) as v from areas where macroarea = 'lote' and land_use is not null group by all), t as (select project_id from (select *, max(v) over (partition by project_id) as m from u) where v = m group by project_id having count(*) > 1)
select project_id, 'territorial.percent_by_category' as indicator_code, 'no_parcelavel_area' as code from s where not coalesce(parcelable > 0, false)
union all select project_id, 'density.non_residential_ca', 'no_non_residential_lot' from s where a = 0 union all select project_id, 'lots.distance_to_non_residential_use', 'no_non_residential_target' from s where b = 0
union all select project_id, 'lots.distance_to_green_area', 'no_green_area_target' from s where c = 0 union all select project_id, 'land_use.predominant_use', 'predominant_use_tie' from t""")
def project_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return territory.project_warnings(_small(spark, sf_dir))


@query("""select c_custkey as project_id, case c_custkey % 6 when 1 then 'self_intersection' when 2 then 'unclosed_ring' when 3 then 'hole_outside' when 4 then 'overlapping_parts' when 5 then 'null' end as fault from customer where c_custkey % 6 > 0""")
def geometry_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polygon of one of six kinds for each customer, of which one is valid."""
    k = F.col("c_custkey")
    at = lambda *xy: [geometry.point(F.lit(x) + k % 7, F.lit(y)) for x, y in xy]
    square = at((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))
    hole = lambda d: at((2 + d, 2), (2 + d, 4), (4 + d, 4), (4 + d, 2), (2 + d, 2))
    kinds = {
        0: F.array(geometry.ring(*square), geometry.ring(*hole(0), number=1)),
        1: F.array(geometry.ring(*at((0, 0), (10, 10), (10, 0), (0, 12), (0, 0)))),
        2: F.array(geometry.ring(*square[:-1], geometry.point(F.lit(0.5) + k % 7, F.lit(5)))),
        3: F.array(geometry.ring(*square), geometry.ring(*hole(20), number=1)),
        4: F.array(geometry.ring(*square), geometry.ring(*hole(0), part=1)),
    }
    geom = F.lit(None).cast(geometry.GEOMETRY)
    for kind, made in kinds.items():
        geom = F.when(k % 6 == kind, made).otherwise(geom)
    rows = table(spark, sf_dir, "customer").select(k.alias("project_id"), k.alias("feature_id"), geom.alias("geom"))
    return validity.faults(rows, ["project_id"]).select("project_id", "fault")


@query(f"""{_P}, f as (select project_id, feature_id, slot % 3 as layer_id, lag(feature_id) over (partition by project_id order by slot) as parent, lag(slot % 3) over (partition by project_id order by slot) as of from parcels)
select project_id, feature_id, case when of <> 0 then parent end as parent_feature_id, case when of = 0 then 'unresolved' else 'attribute' end as relation_method from f where layer_id <> 0""")
def drop_layer_unlink(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("feature_id").over(Window.partitionBy("project_id").orderBy("slot"))
    rows = parcels(spark, sf_dir).select("project_id", "feature_id", (F.col("slot") % 3).alias("layer_id"), before.alias("parent_feature_id"), F.lit("attribute").alias("relation_method"))
    return layers.drop_layer(rows, 0).select("project_id", "feature_id", "parent_feature_id", "relation_method")


@query("select event_id as run_id, round(value, 4) as value from events where event_id % 2 = 0")
def asked_run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the runs are asked for as their project's, the others as another's."""
    events = table(spark, sf_dir, "events")
    runs = events.select(F.col("user_id").alias("project_id"), F.col("event_id").alias("run_id"))
    wanted = runs.withColumn("project_id", F.when(F.col("run_id") % 2 == 0, F.col("project_id")).otherwise(F.col("project_id") + 1))
    return results.run_results(runs, events.select(F.col("event_id").alias("run_id"), F.round("value", 4).alias("value")), wanted)


@query(f"""{_P} select project_id, count(*) as n_warnings from (select project_id from parcels where case when reference_area_m2 = 0 then 1 else abs(geometric - reference_area_m2) / reference_area_m2 end >= 0.05
union all select project_id from parcels where macroarea = 'lote' and land_use is null union all select project_id from parcels where macroarea = 'lote' and ca_max is null) group by project_id""")
def warning_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = territory.warnings(parcels(spark, sf_dir)).withColumnRenamed("project_id", "run_id")
    return results.warning_count(found).withColumnRenamed("run_id", "project_id")


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return SQL
