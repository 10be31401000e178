"""Indicators that are sums over the attributes and areas of territory features.

Input: features with project_id, feature_id, geom, macroarea, parcelavel,
land_use, ca_max and reference_area_m2.  Output rows are long: project_id,
indicator_code, key, value (double) and label (string); projects whose
indicator can't be computed are rows of `errors`.  All aggregates are by
project, with partial sums before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelwise.functions import geometry

DIVERGENCE = 0.05
LOT = "lote"
NON_RESIDENTIAL = ("comercial", "servicos", "institucional", "industrial")


def resolved_area(reference: Column, geometric: Column) -> Column:
    """The reference area if there is one, else the geometric one; neither overrides the other."""
    return F.coalesce(F.nanvl(reference, F.lit(None).cast("double")), geometric)


def diverges(reference: Column, geometric: Column) -> Column:
    """Whether the two areas differ by 5 % of the reference or more; a negative reference never warns."""
    reference = F.nanvl(reference, F.lit(None).cast("double"))
    share = F.when(reference == 0, F.lit(1.0)).otherwise(F.abs(geometric - reference) / reference)
    return F.coalesce(share >= DIVERGENCE, F.lit(False))


def with_geometric(features: DataFrame) -> DataFrame:
    """Adds geometric, the area of the geometry, which `measured` and `overlay.usable` then need not work out again."""
    return features if "geometric" in features.columns else features.withColumn("geometric", geometry.area(F.col("geom")))


def measured(features: DataFrame) -> DataFrame:
    """Adds geometric (unless it is there already), area (resolved) and lot_area (resolved, where a negative reference counts as none)."""
    reference = F.col("reference_area_m2").cast("double")
    rows = with_geometric(features)
    return rows.withColumn("area", resolved_area(reference, F.col("geometric"))).withColumn("lot_area", resolved_area(F.when(reference >= 0, reference), F.col("geometric")))


def _long(rows: DataFrame, code: str, value: Column, key: Column | None = None, label: Column | None = None) -> DataFrame:
    return rows.select(
        "project_id",
        F.lit(code).alias("indicator_code"),
        (key if key is not None else F.lit(None).cast("string")).alias("key"),
        value.cast("double").alias("value"),
        (label if label is not None else F.lit(None).cast("string")).alias("label"),
    )


def area_by_category(features: DataFrame) -> DataFrame:
    sums = measured(features).groupBy("project_id", F.coalesce("macroarea", F.lit("nulo")).alias("key")).agg(F.sum("area").alias("value"))
    return _long(sums, "territorial.area_by_category", F.col("value"), F.col("key"))


def _shares(sums: DataFrame, code: str) -> DataFrame:
    total = F.sum("value").over(Window.partitionBy("project_id"))
    return _long(sums.withColumn("total", total).filter("total > 0"), code, F.col("value") / F.col("total"), F.col("key"))


def percent_by_category(features: DataFrame) -> DataFrame:
    """Shares of parcelable area alone, in numerator and denominator."""
    parcelable = measured(features.filter("parcelavel"))
    return _shares(parcelable.groupBy("project_id", F.coalesce("macroarea", F.lit("nulo")).alias("key")).agg(F.sum("area").alias("value")), "territorial.percent_by_category")


def _lots(features: DataFrame) -> DataFrame:
    return measured(features.filter(F.col("macroarea") == LOT))


def _uses(features: DataFrame) -> DataFrame:
    return _lots(features).filter(F.col("land_use").isNotNull()).groupBy("project_id", F.col("land_use").alias("key")).agg(F.sum("area").alias("value"))


def land_use_area(features: DataFrame) -> DataFrame:
    return _long(_uses(features), "land_use.area_by_category", F.col("value"), F.col("key"))


def land_use_percent(features: DataFrame) -> DataFrame:
    return _shares(_uses(features), "land_use.percent_by_category")


def predominant_use(features: DataFrame) -> DataFrame:
    """The use with the largest area; null on a tie, or where no lot has a use."""
    most = F.max("value").over(Window.partitionBy("project_id"))
    leaders = _uses(features).withColumn("most", most).filter("value = most").groupBy("project_id").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    every = features.select("project_id").distinct().join(leaders, "project_id", "left")
    return _long(every, "land_use.predominant_use", F.lit(None), None, F.when(F.col("n") == 1, F.col("key")))


def shannon(features: DataFrame) -> DataFrame:
    p = F.col("value") / F.sum("value").over(Window.partitionBy("project_id"))
    found = _uses(features).withColumn("p", p).filter("p > 0").groupBy("project_id").agg(F.sum(-F.col("p") * F.ln("p")).alias("h"))
    return _long(features.select("project_id").distinct().join(found, "project_id", "left"), "land_use.diversity_shannon", F.col("h"))


def _green(features: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return measured(features).groupBy("project_id").agg(F.sum(F.when(F.col("macroarea").isin(*kinds), F.col("area")).otherwise(0.0)).alias("value"))


def green_area(features: DataFrame) -> DataFrame:
    return _long(_green(features, ("avl",)), "green_areas.total_area", F.col("value"))


def green_area_with_app(features: DataFrame) -> DataFrame:
    return _long(_green(features, ("avl", "app")), "green_areas.total_area_with_app", F.col("value"))


def green_share(features: DataFrame, perimeter_area: DataFrame, with_app: bool = False) -> DataFrame:
    """The green area's share of the project's (project_id, value); projects without a positive one are left to `errors`."""
    green = _green(features, ("avl", "app") if with_app else ("avl",))
    rows = green.join(perimeter_area.select("project_id", F.col("value").alias("whole")).filter("whole > 0"), "project_id")
    return _long(rows, "green_areas.percent_of_project" + "_with_app" * with_app, F.col("value") / F.col("whole"))


def _density(features: DataFrame) -> DataFrame:
    """Per project with a lot of valid geometry: its lots' sums."""
    lots = _lots(features).filter("geometric is not null")
    ca = F.when(F.col("ca_max") >= 0, F.col("ca_max").cast("double"))
    return lots.withColumn("ca", ca).groupBy("project_id").agg(
        F.coalesce(F.sum(F.col("lot_area") * F.col("ca")), F.lit(0.0)).alias("built"),
        F.count("ca").alias("with_ca"),
        F.sum("lot_area").alias("lots"),
        F.coalesce(F.sum(F.when(F.col("ca").isNotNull(), F.col("lot_area"))), F.lit(0.0)).alias("covered"),
    )


def max_computable_area(features: DataFrame) -> DataFrame:
    return _long(_density(features), "density.max_computable_area", F.col("built"))


def lot_count_with_ca(features: DataFrame) -> DataFrame:
    return _long(_density(features), "density.lot_count_with_ca", F.col("with_ca"))


def ca_coverage(features: DataFrame) -> DataFrame:
    return _long(_density(features), "density.ca_coverage", F.when(F.col("lots") > 0, F.col("covered") / F.col("lots")))


def built_open_ratio(features: DataFrame) -> DataFrame:
    """Buildable area over the area that is no lot; projects without open area are left to `errors`."""
    open_area = area_by_category(features).filter("key <> 'lote'").groupBy("project_id").agg(F.sum("value").alias("open"))
    return _long(_density(features).join(open_area.filter("open > 0"), "project_id"), "density.built_open_ratio", F.col("built") / F.col("open"))


def non_residential_ca(features: DataFrame) -> DataFrame:
    """The area-weighted coefficient of lots of non-residential use; null where there is none."""
    lots = _lots(features).filter(F.col("land_use").isin(*NON_RESIDENTIAL) & (F.col("ca_max") >= 0))
    sums = lots.groupBy("project_id").agg(F.sum(F.col("area") * F.col("ca_max").cast("double")).alias("built"), F.sum("area").alias("lots"))
    every = features.filter(F.col("macroarea") == LOT).select("project_id").distinct().join(sums, "project_id", "left")
    return _long(every, "density.non_residential_ca", F.when(F.col("lots") > 0, F.col("built") / F.col("lots")))


def warnings(features: DataFrame) -> DataFrame:
    """One row per project, code and feature: what was left out or looks wrong."""
    rows = measured(features)
    lot = F.col("macroarea") == LOT
    found = F.array_compact(
        F.array(
            F.when(diverges(F.col("reference_area_m2").cast("double"), F.col("geometric")), F.struct(F.lit("area_reference_divergence").alias("code"), F.lit("warning").alias("severity"))),
            F.when(lot & F.col("land_use").isNull(), F.struct(F.lit("lot_without_land_use").alias("code"), F.lit("info").alias("severity"))),
            F.when(lot & F.col("quadra_id").isNull(), F.struct(F.lit("lot_without_quadra").alias("code"), F.lit("info").alias("severity"))),
            F.when(lot & F.col("geometric").isNull(), F.struct(F.lit("invalid_lot_geometry").alias("code"), F.lit("warning").alias("severity"))),
            F.when(lot & ~F.coalesce((F.col("ca_max") >= 0) & ~F.isnan(F.col("ca_max").cast("double")), F.lit(False)), F.struct(F.lit("lot_ca_missing").alias("code"), F.lit("info").alias("severity"))),
        )
    )
    return rows.select("project_id", "feature_id", F.explode(found).alias("w")).select("project_id", "w.code", "w.severity", "feature_id")


#: Indicator code -> how it is computed from territory features alone.
INDICATORS = {
    "territorial.area_by_category": area_by_category,
    "territorial.percent_by_category": percent_by_category,
    "land_use.area_by_category": land_use_area,
    "land_use.percent_by_category": land_use_percent,
    "land_use.predominant_use": predominant_use,
    "land_use.diversity_shannon": shannon,
    "green_areas.total_area": green_area,
    "green_areas.total_area_with_app": green_area_with_app,
    "density.max_computable_area": max_computable_area,
    "density.lot_count_with_ca": lot_count_with_ca,
    "density.ca_coverage": ca_coverage,
    "density.built_open_ratio": built_open_ratio,
    "density.non_residential_ca": non_residential_ca,
}


def project_warnings(features: DataFrame, frontages: DataFrame | None = None) -> DataFrame:
    """(project_id, indicator_code, code): what a project's values leave out, where no single feature is to blame.

    Targets of walking distances are lots of any use but the residential (mixed ones too) and green
    areas; with `frontages` (project_id, feature_id, value) only those that a street reaches.
    """
    target = F.lit(True)
    rows = measured(features)
    if frontages is not None:
        rows = rows.join(frontages.select("project_id", "feature_id", F.col("value").alias("frontage")), ["project_id", "feature_id"], "left")
        target = F.coalesce(F.col("frontage") > 0, F.lit(False))
    rows = rows.groupBy("project_id").agg(
        F.sum(F.when(F.col("parcelavel"), F.col("area"))).alias("parcelable"),
        F.count_if((F.col("macroarea") == LOT) & F.col("land_use").isin(*NON_RESIDENTIAL) & (F.col("ca_max") >= 0)).alias("non_residential"),
        F.count_if(target & (F.col("macroarea") == LOT) & F.col("land_use").isNotNull() & (F.col("land_use") != "residencial")).alias("non_residential_targets"),
        F.count_if(target & (F.col("macroarea") == "avl")).alias("green_targets"),
    )
    cases = (
        (~F.coalesce(F.col("parcelable") > 0, F.lit(False)), "territorial.percent_by_category", "no_parcelavel_area"),
        (F.col("non_residential") == 0, "density.non_residential_ca", "no_non_residential_lot"),
        (F.col("non_residential_targets") == 0, "lots.distance_to_non_residential_use", "no_non_residential_target"),
        (F.col("green_targets") == 0, "lots.distance_to_green_area", "no_green_area_target"),
    )
    found = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(code).alias("indicator_code"), F.lit(name).alias("code"))) for when, code, name in cases)))
    sums = rows.select("project_id", F.explode(found).alias("w")).select("project_id", "w.*")
    order = Window.partitionBy("project_id")
    tied = _uses(features).withColumn("most", F.max("value").over(order)).filter("value = most").groupBy("project_id").agg(F.count("*").alias("n")).filter("n > 1")
    return sums.unionByName(tied.select("project_id", F.lit("land_use.predominant_use").alias("indicator_code"), F.lit("predominant_use_tie").alias("code")))


def errors(features: DataFrame, perimeter_area: DataFrame | None = None) -> DataFrame:
    """(project_id, indicator_code, error): projects in which an indicator can't be computed, and why.

    `perimeter_area` (project_id, value) also finds those without a perimeter of positive area.
    """
    valid = (F.col("macroarea") == LOT) & F.col("geometric").isNotNull()
    open_area = F.coalesce(F.sum(F.when(F.coalesce(F.col("macroarea"), F.lit("nulo")) != LOT, F.col("area"))), F.lit(0.0))
    sums = measured(features).groupBy("project_id").agg(F.count_if(valid).alias("lots"), open_area.alias("open"))
    none, no_open = F.col("lots") == 0, ~(F.col("open") > 0)
    density = ("max_computable_area", "lot_count_with_ca", "ca_coverage", "built_open_ratio")
    cases = [(none, f"density.{name}", "no_valid_lot") for name in density] + [(~none & no_open, "density.built_open_ratio", "no_open_area")]
    if perimeter_area is not None:
        sums = sums.join(perimeter_area.select("project_id", F.col("value").alias("whole")), "project_id", "left")
        bare = ~F.coalesce(F.col("whole") > 0, F.lit(False))
        cases += [(bare, f"green_areas.percent_of_project{end}", "no_perimeter_area") for end in ("", "_with_app")]
    found = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(code).alias("indicator_code"), F.lit(name).alias("error"))) for when, code, name in cases)))
    return sums.select("project_id", F.explode(found).alias("e")).select("project_id", "e.*")
