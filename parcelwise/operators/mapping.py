"""From source properties to typed columns, by a mapping of internal to source names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import text

#: Internal field -> how its source text becomes its value.
TYPED = {
    "macroarea": text.macroarea,
    "parcelavel": text.to_bool,
    "land_use": text.land_use,
    "quadra_id": text.to_group_key,
    "road_status": text.road_status,
    "ca_max": text.to_non_negative,
    "reference_area_m2": text.to_area,
}


def map_attributes(features: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rewrites `mapped` from `source` by {internal: source name}; typed columns change only for fields of the mapping."""
    picked: dict[str, Column] = {field: F.try_element_at("source", F.lit(name)) for field, name in mapping.items() if name}
    entries = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in picked.items()]
    mapped = F.map_from_entries(F.array_compact(F.array(*entries))) if entries else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return features.withColumns({"mapped": mapped} | {field: TYPED[field](value) for field, value in picked.items() if field in TYPED})


def unreadable_areas(features: DataFrame, source_name: str) -> DataFrame:
    return features.filter(text.area_unreadable(F.try_element_at("source", F.lit(source_name)))).select("feature_id", F.try_element_at("source", F.lit(source_name)).alias("raw"))


# The columns of known exports that hold each target, the first found wins.
ALIASES = {
    "macroarea": ("Comments", "TIPO DE MACROÁREA"),
    "quadra_id": ("QUADRA",),
    "parcelavel": ("P_Área de Projeto",),
    "reference_area_m2": ("Area",),
    "land_use": ("Uso do solo",),
    "ca_max": ("07.COEFICIENTE DE APROVEITAMENTO",),
}


def suggest_mapping(fields: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """(layer_id, field) -> layer_id, target, field: the first alias, by exact normalized key, that a layer has.

    Of two fields with the same key the later by name stands.
    """
    rows = fields.sparkSession.createDataFrame([(target, rank, alias) for target, names in aliases.items() for rank, alias in enumerate(names)], "target string, rank int, alias string")
    keys = fields.groupBy("layer_id", text.normalize_key(F.col("field")).alias("key")).agg(F.max("field").alias("field"))
    found = keys.join(F.broadcast(rows.withColumn("key", text.normalize_key(F.col("alias")))), "key")
    return found.groupBy("layer_id", "target").agg(F.min(F.struct("rank", "field")).alias("best")).select("layer_id", "target", F.col("best.field").alias("field"))
