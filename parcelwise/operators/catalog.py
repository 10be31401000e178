"""The catalog of indicators: what each is, needs and looks like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMULA_VERSION = "1.0.0"

# Fixed values, a line each: code, unit, required layers, optional layers, key of its values, shape of its values.
INDICATORS = """
density.built_open_ratio ratio territorio - - scalar
density.ca_coverage ratio territorio - - scalar
density.lot_count_with_ca count territorio - - scalar
density.max_computable_area m2 territorio - - scalar
density.non_residential_ca ratio territorio - - scalar
green_areas.percent_of_project ratio territorio,perimetro - - scalar
green_areas.percent_of_project_with_app ratio territorio,perimetro - - scalar
green_areas.total_area m2 territorio - - scalar
green_areas.total_area_with_app m2 territorio - - scalar
land_use.area_by_category m2 territorio - - category_breakdown
land_use.diversity_shannon adimensional territorio - - scalar
land_use.percent_by_category ratio territorio - - category_breakdown
land_use.predominant_use categoria territorio - - categorical_label
lots.distance_to_green_area m territorio,sistema_viario desconexoes_viarias feature_id feature_series
lots.distance_to_non_residential_use m territorio,sistema_viario desconexoes_viarias feature_id feature_series
lots.frontage_length m territorio - feature_id feature_series
lots.parceling_efficiency ratio territorio - quadra_id feature_series
quadras.compactness adimensional territorio - quadra_id feature_series
quadras.face_length_score adimensional territorio - quadra_id feature_series
quadras.min_rotated_rectangle composto territorio - quadra_id feature_compound
quadras.orientation graus territorio - quadra_id feature_series
quadras.stats composto territorio - quadra_id feature_compound
road_network.existing_length m sistema_viario desconexoes_viarias - scalar
road_network.intersection_count count sistema_viario desconexoes_viarias - scalar
road_network.intersection_density count/km2 sistema_viario,perimetro desconexoes_viarias - scalar
road_network.link_node_ratio adimensional sistema_viario desconexoes_viarias - scalar
road_network.max_boundary_gap m sistema_viario,perimetro desconexoes_viarias - scalar
road_network.proposed_connection_count count sistema_viario desconexoes_viarias - scalar
road_network.proposed_length m sistema_viario desconexoes_viarias - scalar
road_network.total_length m sistema_viario desconexoes_viarias - scalar
territorial.area_by_category m2 territorio - - category_breakdown
territorial.compactness adimensional perimetro - - scalar
territorial.percent_by_category ratio territorio - - category_breakdown
territorial.perimeter m perimetro - - scalar
territorial.total_area m2 perimetro - - scalar
"""

# Results whose formula is newer than the catalog says, and the layers that results name in place of the required ones.
RESULT_VERSIONS = dict.fromkeys(("territorial.percent_by_category", "land_use.percent_by_category", "land_use.predominant_use", "land_use.diversity_shannon"), "1.0.1")
RESULT_LAYERS = {"land_use.": ["lote"], "green_areas.": ["avl"]}
WITH_APP = "_with_app"

#: The layer type whose features carry the key of an indicator's values.
LAYER_OF_KEY = {"feature_id": "territorio", "quadra_id": "quadras"}


def rows() -> list[tuple[str, str, str, str, list[str], list[str], str | None, str]]:
    """(code, theme, unit, formula version, required layers, optional layers, feature key, value shape), by theme and code."""
    found = []
    for line in INDICATORS.split("\n"):
        if line:
            code, unit, required, optional, key, shape = line.split()
            split = lambda names: [] if names == "-" else names.split(",")
            found.append((code, code.partition(".")[0], unit, FORMULA_VERSION, split(required), split(optional), None if key == "-" else key, shape))
    return sorted(found, key=lambda r: (r[1], r[0]))


def catalog(spark: SparkSession, theme: str | None = None) -> DataFrame:
    """The catalog as a table, of one theme or of all; an unknown theme is an error."""
    every = rows()
    if theme is not None and theme not in {r[1] for r in every}:
        raise ValueError(f"unknown theme {theme}")
    kinds = "indicator_code string, theme string, unit string, formula_version string, required_layers array<string>, optional_layers array<string>, feature_key string, value_shape string"
    return spark.createDataFrame([r for r in every if theme in (None, r[1])], kinds)


def result_layers(code: str, required: list[str], optional: list[str]) -> list[str]:
    """The source layers that a result names: the kinds of features that it sums, where it sums only such."""
    own = next((names for theme, names in RESULT_LAYERS.items() if code.startswith(theme)), None)
    if own is None:
        return required + optional
    return own + ["app"] if code.endswith(WITH_APP) else own


def runnable(layers: DataFrame, theme: str | None = None, projects: DataFrame | None = None) -> DataFrame:
    """(project_id, layer_type) -> project_id, indicator_code, theme, missing: the required layers that the project lacks, none if it can run.

    With `projects` (project_id) those without any layer have their rows too.
    """
    has = layers.groupBy("project_id").agg(F.collect_set("layer_type").alias("has"))
    if projects is not None:
        has = projects.select("project_id").distinct().join(has, "project_id", "left").select("project_id", F.coalesce("has", F.array().cast("array<string>")).alias("has"))
    pairs = has.join(F.broadcast(catalog(layers.sparkSession, theme).select("indicator_code", "theme", "required_layers")), F.lit(True))
    return pairs.select("project_id", "indicator_code", "theme", F.array_except("required_layers", "has").alias("missing"))


def compatible(features: DataFrame) -> DataFrame:
    """(..., layer_type) -> its rows with each indicator whose values such features carry: indicator_code and feature_key."""
    keyed = [(code, key, LAYER_OF_KEY[key]) for code, _, _, _, _, _, key, _ in rows() if key]
    table = features.sparkSession.createDataFrame(keyed, "indicator_code string, feature_key string, layer_type string")
    return features.join(F.broadcast(table), "layer_type")


def result_rows(values: DataFrame, run_id: str, metric_crs: str | None = None) -> DataFrame:
    """Long values (project_id, indicator_code, key, value, label) as rows of a run: with theme, unit, version, layers read and the value as JSON.

    Values of several parts also have a `sub_field`, which then stays.
    """
    each = [(code, theme, unit, RESULT_VERSIONS.get(code, version), result_layers(code, required, optional)) for code, theme, unit, version, required, optional, _, _ in rows()]
    known = values.sparkSession.createDataFrame(each, "indicator_code string, theme string, unit string, formula_version string, source_layers array<string>")
    part = ["sub_field"] if "sub_field" in values.columns else []
    text = F.when(F.col("label").isNotNull(), F.to_json(F.struct("key", "label"))).otherwise(F.to_json(F.struct("key", "value"), {"ignoreNullFields": "false"}))
    for name in part:
        text = F.when(F.col(name).isNotNull(), F.to_json(F.struct("key", name, "value"), {"ignoreNullFields": "false"})).otherwise(text)
    out = values.join(F.broadcast(known), "indicator_code").withColumns({"run_id": F.lit(run_id), "metric_crs": F.lit(metric_crs).cast("string"), "value_json": text})
    return out.select("run_id", "project_id", "indicator_code", "theme", "unit", "formula_version", "metric_crs", "source_layers", "key", *part, "value", "label", "value_json")


def save_results(values: DataFrame, run_id: str, path: str, metric_crs: str | None = None) -> None:
    """Writes the rows of a run under `path`, in a folder of its own; a run is written once."""
    result_rows(values, run_id, metric_crs).drop("run_id").write.mode("error").parquet(f"{path}/run_id={run_id}")


def category_features(features: DataFrame, values: DataFrame, on: str) -> DataFrame:
    """Features with the value of their category: both names are compared by their normalised keys."""
    from parcelwise.functions.text import normalize_key

    keyed = values.select("project_id", normalize_key(F.col("key")).alias("category"), "value")
    return features.withColumn("category", normalize_key(F.col(on))).join(keyed, ["project_id", "category"]).drop("category")
