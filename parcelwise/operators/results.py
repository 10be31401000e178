"""Result history, presentation and integrity of indicator results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def current_version(versions: DataFrame) -> DataFrame:
    """(project_id, version_id, created_at) -> each project's newest version."""
    newest = F.max(F.struct("created_at", "version_id")).alias("v")
    return versions.groupBy("project_id").agg(newest).select("project_id", "v.version_id", "v.created_at")


def latest_run(runs: DataFrame) -> DataFrame:
    """(project_id, run_id, created_at, status) -> each project's newest completed run."""
    done = runs.filter("status = 'completed'").groupBy("project_id").agg(F.max(F.struct("created_at", "run_id")).alias("r"))
    return done.select("project_id", "r.run_id", "r.created_at")


def run_history(runs: DataFrame) -> DataFrame:
    """Each project's runs, numbered from the newest."""
    order = Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("position", F.row_number().over(order))


def latest_results(runs: DataFrame, values: DataFrame) -> DataFrame:
    """The results (run_id, ...) of each project's latest completed run."""
    return values.join(latest_run(runs).select("run_id", "project_id"), "run_id")


def run_results(runs: DataFrame, values: DataFrame, wanted: DataFrame) -> DataFrame:
    """The results of the wanted runs (project_id, run_id), of each only if it is that project's."""
    own = runs.select("project_id", "run_id").join(wanted.select("project_id", "run_id").distinct(), ["project_id", "run_id"])
    return values.join(own.select("run_id"), "run_id", "left_semi")


def warning_count(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("run_id").agg(F.count("*").alias("n_warnings"))


def category_shares(values: DataFrame) -> DataFrame:
    """(project_id, key, value) -> share of the total and rank, largest first; no rows where the total is not positive."""
    whole = Window.partitionBy("project_id")
    rows = values.withColumn("total", F.sum("value").over(whole)).filter("total > 0")
    return rows.select("project_id", "key", (F.col("value") / F.col("total")).alias("share"), F.row_number().over(whole.orderBy(F.desc("value"), "key")).alias("position"))


def distribution_summary(values: DataFrame) -> DataFrame:
    return values.filter("value is not null").groupBy("project_id").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))


def compound_pivot(values: DataFrame, sub_fields: list[str]) -> DataFrame:
    """(project_id, key, sub_field, value) -> a column for each sub-field."""
    return values.groupBy("project_id", "key").pivot("sub_field", sub_fields).agg(F.first("value"))


def ranked_values(values: DataFrame) -> DataFrame:
    return values.withColumn("position", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("value"), "key")))


def result_overlay(features: DataFrame, values: DataFrame, on: str) -> DataFrame:
    """Features with the value of their key; absent and non-finite values are left out."""
    finite = values.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    return features.join(finite.select("project_id", F.col("key").alias(on), "value"), ["project_id", on])


def feature_indicator_status(features: DataFrame, catalog: DataFrame, values: DataFrame, ran: DataFrame) -> DataFrame:
    """For each feature and indicator of its layer type (catalog: indicator_code, layer_type, feature_key):
    available, no_data (the run has no value), not_calculated (`ran`: project_id, indicator_code) or missing_key."""
    pairs = features.join(F.broadcast(catalog), "layer_type")
    key = F.when(F.col("feature_key") == "quadra_id", F.col("quadra_id")).otherwise(F.col("feature_id").cast("string"))
    rows = pairs.withColumn("key", key).join(values.select("project_id", "indicator_code", "key", "value"), ["project_id", "indicator_code", "key"], "left")
    rows = rows.join(ran.withColumn("ran", F.lit(True)), ["project_id", "indicator_code"], "left")
    status = F.when(F.col("key").isNull(), "missing_key").when(F.col("value").isNotNull(), "available").when(F.col("ran"), "no_data").otherwise("not_calculated")
    return rows.select("project_id", "feature_id", "indicator_code", status.alias("status"))


def theme_readiness(projects: DataFrame, required: list[tuple[str, str]], layers: DataFrame) -> DataFrame:
    """For each project and theme (required: theme, layer type): the worst state of its layers (project_id, layer_type, status)."""
    needs = F.array(*(F.struct(F.lit(theme).alias("theme"), F.lit(kind).alias("layer_type")) for theme, kind in required))
    state = F.when(F.col("status").isNull() | (F.col("status") == "error"), 2).when(F.col("status") == "uploaded", 1).otherwise(0)
    rows = projects.select("project_id", F.explode(needs).alias("need")).select("project_id", "need.*").join(layers, ["project_id", "layer_type"], "left")
    worst = rows.groupBy("project_id", "theme").agg(F.max(state).alias("worst"))
    return worst.select("project_id", "theme", F.element_at(F.array(*map(F.lit, ("available", "attention", "blocked"))), F.col("worst") + 1).alias("readiness"))


def integrity_report(styles: DataFrame, stats: DataFrame, layers: DataFrame, modes: DataFrame) -> DataFrame:
    """Style rows (style_id, layer_id, field, mode) whose layer or field is gone, or whose mode doesn't suit the field."""
    rows = styles.join(layers.select("layer_id", F.lit(True).alias("has_layer")), "layer_id", "left")
    rows = rows.join(stats.select("layer_id", "field", F.lit(True).alias("has_field")), ["layer_id", "field"], "left")
    rows = rows.join(modes.select("layer_id", "field", F.col("mode").alias("good_mode")), ["layer_id", "field"], "left")
    fault = F.when(F.col("has_layer").isNull(), "layer_missing").when(F.col("has_field").isNull(), "field_missing").when(F.col("good_mode").isNull() | ((F.col("mode") != F.col("good_mode")) & (F.col("mode") != "single")), "mode_unsuitable")
    return rows.withColumn("fault", fault).filter("fault is not null").select("style_id", "layer_id", "field", "fault")
