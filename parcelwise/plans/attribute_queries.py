"""Queries over parcels: sums, shares and densities, with their SQL."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.operators import territory
from parcelwise.plans.derived import PARCELS_SQL, parcels
from parcelwise.session import stored

DIGITS = 6


def _one(spark: SparkSession, sf_dir: str, code: str) -> DataFrame:
    found = territory.INDICATORS[code](parcels(spark, sf_dir))
    if code == "land_use.predominant_use":
        return found.select("project_id", "label")
    return found.select("project_id", *(["key"] if "category" in code else []), F.round("value", DIGITS).alias("value"))


def indicator_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indicators that need parcels alone, of all projects in one long table."""
    # measured once for all indicators, not again for each
    features = stored(parcels(spark, sf_dir))
    return reduce(DataFrame.unionByName, (f(features) for f in territory.INDICATORS.values())).withColumn("value", F.round("value", DIGITS))


def indicator_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return territory.warnings(parcels(spark, sf_dir))


def green_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counting preservation areas adds to the green area."""
    features = parcels(spark, sf_dir)
    both = territory.green_area(features).unionByName(territory.green_area_with_app(features))
    wide = both.groupBy("project_id").pivot("indicator_code", ["green_areas.total_area", "green_areas.total_area_with_app"]).agg(F.first("value"))
    return wide.select("project_id", F.round(F.col("`green_areas.total_area_with_app`") - F.col("`green_areas.total_area`"), DIGITS).alias("delta"))


_NAMES = {
    "area_by_macroarea": "territorial.area_by_category",
    "percent_by_macroarea": "territorial.percent_by_category",
    "area_by_land_use": "land_use.area_by_category",
    "percent_by_land_use": "land_use.percent_by_category",
    "predominant_use": "land_use.predominant_use",
    "land_use_shannon": "land_use.diversity_shannon",
    "green_area_total": "green_areas.total_area",
    "green_area_with_app": "green_areas.total_area_with_app",
    "max_buildable_area": "density.max_computable_area",
    "lots_with_ca": "density.lot_count_with_ca",
    "ca_coverage": "density.ca_coverage",
    "built_open_ratio": "density.built_open_ratio",
    "non_residential_ca": "density.non_residential_ca",
}

_USES = "uses as (select project_id, land_use as key, sum(area) as v from areas where macroarea = 'lote' and land_use is not null group by all)"
_DENSITY = """lots as (select project_id, sum(lot_area * case when ca_max >= 0 then ca_max end) as built, count(case when ca_max >= 0 then 1 end) as n,
  sum(lot_area) as total, sum(case when ca_max >= 0 then lot_area end) as covered from areas where macroarea = 'lote' group by project_id)"""

#: Code -> (further tables, key, value or label, source) of its rows in SQL.
_SQL = {
    "territorial.area_by_category": ("", "key", "sum(area)", "(select *, coalesce(macroarea, 'nulo') as key from areas) group by project_id, key"),
    "territorial.percent_by_category": ("", "key", "v / total", "(select *, sum(v) over (partition by project_id) as total from (select project_id, coalesce(macroarea, 'nulo') as key, sum(area) as v from areas where parcelavel group by all)) where total > 0"),
    "land_use.area_by_category": (_USES, "key", "v", "uses"),
    "land_use.percent_by_category": (_USES, "key", "v / total", "(select *, sum(v) over (partition by project_id) as total from uses) where total > 0"),
    "land_use.diversity_shannon": (_USES, None, "h", "(select distinct project_id from parcels) left join (select project_id, sum(-p * ln(p)) as h from (select project_id, v / sum(v) over (partition by project_id) as p from uses) where p > 0 group by project_id) using (project_id)"),
    "green_areas.total_area": ("", None, "sum(case when macroarea = 'avl' then area else 0 end)", "areas group by project_id"),
    "green_areas.total_area_with_app": ("", None, "sum(case when macroarea in ('avl', 'app') then area else 0 end)", "areas group by project_id"),
    "density.max_computable_area": (_DENSITY, None, "coalesce(built, 0)", "lots"),
    "density.lot_count_with_ca": (_DENSITY, None, "n::double", "lots"),
    "density.ca_coverage": (_DENSITY, None, "case when total > 0 then coalesce(covered, 0) / total end", "lots"),
    "density.built_open_ratio": (_DENSITY, None, "coalesce(built, 0) / open", "lots join (select project_id, sum(area) as open from areas where coalesce(macroarea, 'nulo') <> 'lote' group by project_id) using (project_id) where open > 0"),
    "density.non_residential_ca": ("", None, "b", "(select distinct project_id from areas where macroarea = 'lote') left join (select project_id, sum(area * ca_max) / nullif(sum(area), 0) as b from areas where macroarea = 'lote' and ca_max >= 0 and land_use in ('comercial', 'servicos', 'institucional', 'industrial') group by project_id) using (project_id)"),
}
_PREDOMINANT = "(select distinct project_id from parcels) left join (select project_id, case when count(*) = 1 then min(key) end as best from (select *, max(v) over (partition by project_id) as most from uses) where v = most group by project_id) using (project_id)"


def _sql(code: str) -> str:
    if code == "land_use.predominant_use":
        return f"with {PARCELS_SQL}, {_USES} select project_id, best as label from {_PREDOMINANT}"
    more, key, value, source = _SQL[code]
    return f"with {PARCELS_SQL}{', ' * bool(more)}{more} select project_id{', key' if key else ''}, round({value}, {DIGITS}) as value from {source}"


def _all_sql() -> str:
    rows = []
    for code, (_, key, value, source) in _SQL.items():
        rows.append(f"select project_id, '{code}' as indicator_code, {key or 'null'}::varchar as key, round({value}, {DIGITS}) as value, null::varchar as label from {source}")
    rows.append(f"select project_id, 'land_use.predominant_use', null, null, best from {_PREDOMINANT}")
    return f"with {PARCELS_SQL}, {_USES}, {_DENSITY} " + " union all ".join(f"({r})" for r in rows)


_WARNINGS_SQL = f"""with {PARCELS_SQL}
select project_id, code, case when code = 'area_reference_divergence' then 'warning' else 'info' end as severity, feature_id from (
  select project_id, feature_id, 'area_reference_divergence' as code from parcels where case when reference_area_m2 = 0 then 1 else abs(geometric - reference_area_m2) / reference_area_m2 end >= 0.05
  union all select project_id, feature_id, 'lot_without_land_use' from parcels where macroarea = 'lote' and land_use is null
  union all select project_id, feature_id, 'lot_ca_missing' from parcels where macroarea = 'lote' and ca_max is null)"""


def queries() -> dict:
    return {name: partial(_one, code=code) for name, code in _NAMES.items()} | {f.__name__: f for f in (indicator_values, indicator_warnings, green_delta)}


def oracle_sql() -> dict[str, str]:
    return {name: _sql(code) for name, code in _NAMES.items()} | {
        "indicator_values": _all_sql(),
        "indicator_warnings": _WARNINGS_SQL,
        "green_delta": f"with {PARCELS_SQL} select project_id, round(sum(case when macroarea in ('avl', 'app') then area else 0 end) - sum(case when macroarea = 'avl' then area else 0 end), {DIGITS}) as delta from areas group by project_id",
    }
