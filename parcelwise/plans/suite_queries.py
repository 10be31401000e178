"""All indicators of all projects in one table, whose every row has a closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.functions import geometry
from parcelwise.operators import catalog, roads, suite
from parcelwise.plans import attribute_queries, spatial_queries, street_queries
from parcelwise.plans.derived import parcels

DIGITS = 6


def layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Territory, perimeter, centrelines and footprint: the street of street_queries, every second side street only
    proposed, and a perimeter around the parcels whose south side the side streets cross."""
    rows = parcels(spark, sf_dir)
    footprint, lines = street_queries.streets(rows)
    odd = F.col("feature_id").isin("N1", "N3", "N5", "N7")
    lines = lines.withColumn("road_status", F.when(odd, roads.PROPOSED).otherwise(F.col("road_status")))
    top = rows.groupBy("project_id").agg((F.max(geometry.bounds(F.col("geom"))["y1"]) + 5).alias("top"))
    perimeter = top.select("project_id", F.lit(0).alias("feature_id"), geometry.box(F.lit(-10), F.lit(-20), F.lit(90), F.col("top")).alias("geom"))
    return rows, perimeter, lines, footprint


def all_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the 35 indicators of every project, with the version and source layers of its result."""
    rows = catalog.result_rows(suite.values(*layers(spark, sf_dir)), "run", "EPSG:31983")
    return rows.select("project_id", "indicator_code", "unit", "formula_version", "metric_crs", F.array_join("source_layers", ",").alias("layers"), "key", "sub_field", F.round("value", DIGITS).alias("value"), "label")


def _sql() -> str:
    known = ", ".join(f"('{code}', '{unit}', '{catalog.RESULT_VERSIONS.get(code, version)}', '{','.join(catalog.result_layers(code, required, optional))}')" for code, _, unit, version, required, optional, _, _ in catalog.rows())
    rows = [f"select project_id, indicator_code, key, null::varchar as sub_field, value, label from ({attribute_queries.oracle_sql()['indicator_values']})"]

    def add(code: str, value: str, source: str, key: str = "null", sub_field: str = "null") -> None:
        rows.append(f"select project_id, '{code}', {key}::varchar, {sub_field}::varchar, ({value})::double, null from {source}")

    for code, value in {"territorial.total_area": "area", "territorial.perimeter": "length", "territorial.compactness": "4 * pi() * area / (length * length)"}.items():
        add(code, value, "per")
    for end in ("", "_with_app"):
        add(f"green_areas.percent_of_project{end}", f"green{end} / area", "per")
    streets = {"total_length": "90 + 8 * (29 - gap)", "existing_length": "90 + 4 * (29 - gap)", "proposed_length": "4 * (29 - gap)", "intersection_count": "8", "proposed_connection_count": "4", "link_node_ratio": "17 / 18", "intersection_density": "8e6 / area", "max_boundary_gap": "length - 70"}
    for name, value in streets.items():
        add(f"road_network.{name}", value, "per")
    in_block = {"quadras.stats": {"area_m2": "area", "perimetro_m": "length", "quantidade_lotes": "n_lots"}, "quadras.min_rotated_rectangle": {"comprimento_m": "greatest(n * 10, deep)", "largura_m": "least(n * 10, deep)"}}
    for code, parts in in_block.items():
        for name, value in parts.items():
            add(code, value, "blo", "quadra_id", f"'{name}'")
    for code, value in {"quadras.compactness": "4 * pi() * area / (length * length)", "quadras.orientation": "case when n * 10 < deep then 0 else 90 end", "quadras.face_length_score": "1", "lots.parceling_efficiency": "lots / area"}.items():
        add(code, value, "blo", "quadra_id")
    add("lots.frontage_length", "case when faces then 10.0 + 2 * (3 - gap) else 0 end", "(select * from str where macroarea = 'lote')", "feature_id")
    for code, target in {"lots.distance_to_non_residential_use": "t.macroarea = 'lote' and t.land_use <> 'residencial'", "lots.distance_to_green_area": "t.macroarea = 'avl'"}.items():
        near = f"select o.project_id, o.feature_id, min(abs(o.slot - t.slot) * 10 + o.last_mile + t.last_mile) as v from mid o left join mid t on t.project_id = o.project_id and t.feature_id <> o.feature_id and {target} where o.macroarea = 'lote' and o.land_use in ('residencial', 'misto') group by all"
        add(code, "v", f"({near})", "feature_id")
    return f"""{spatial_queries.BLOCKS_SQL}, blo as (select * from b), str as (select *, 1 + project_id % 4 as gap, slot < 8 and project_id % 4 < 3 as faces from parcels),
mid as (select *, sqrt(power((3 - gap) / 2.0, 2) + power(gap + 1, 2)) as last_mile from str where faces),
per as (select project_id, 1 + project_id % 4 as gap, 100.0 * (max(y0 + d) + 25) as area, 2 * (max(y0 + d) + 125.0) as length, sum(case when macroarea = 'avl' then area else 0 end) as green, sum(case when macroarea in ('avl', 'app') then area else 0 end) as green_with_app from areas group by project_id),
found as ({" union all ".join(f"({r})" for r in rows)}),
known as (select * from (values {known}) as t(indicator_code, unit, formula_version, layers))
select project_id, indicator_code, unit, formula_version, 'EPSG:31983' as metric_crs, layers, key, sub_field, round(value, {DIGITS}) as value, label from found join known using (indicator_code)"""


def queries() -> dict:
    return {"all_results": all_results}


def oracle_sql() -> dict[str, str]:
    return {"all_results": _sql()}
