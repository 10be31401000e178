"""Layers: their contracts, their join with attribute tables, and their export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import geometry, text

# The geometry types that each layer type may hold.
POLYGONS, LINES = ("Polygon", "MultiPolygon"), ("LineString", "MultiLineString")
CONTRACT = {
    "perimetro": POLYGONS,
    "quadras": POLYGONS,
    "lotes": POLYGONS,
    "sistema_viario": LINES,
    "uso_solo": POLYGONS,
    "areas_verdes": POLYGONS,
    "equipamentos": ("Point", *POLYGONS),
    "edificacoes": POLYGONS,
    "desconexoes_viarias": ("Point", "MultiPoint"),
    "territorio": POLYGONS,
}

DELIMITERS = (",", ";", "\t")


def contract_faults(features: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Layers (layer_id, layer_type) whose features aren't of exactly one geometry type, or of none that the layer type may hold.

    With `every` layer (layer_id, layer_type) those without features are found too.
    """
    kinds = features.groupBy("layer_id", "layer_type").agg(F.sort_array(F.collect_set("geom_type")).alias("kinds"))
    if every is not None:
        kinds = every.select("layer_id", "layer_type").distinct().join(kinds, ["layer_id", "layer_type"], "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    allowed = F.create_map(*(x for kind, names in CONTRACT.items() for x in (F.lit(kind), F.array(*map(F.lit, names)))))
    fault = F.when(F.size("kinds") == 0, "empty").when(F.size("kinds") > 1, "mixed_geometry").when(~F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("layer_type")), F.get("kinds", F.lit(0))), F.lit(False)), "geometry_not_allowed")
    return kinds.withColumn("fault", fault).filter("fault is not null").select("layer_id", "layer_type", "kinds", "fault")


def delimiter(header: Column) -> Column:
    """The delimiter that occurs most in a header line; null on a tie or if there is none."""
    counts = [F.length(header) - F.length(F.replace(header, F.lit(d), F.lit(""))) for d in DELIMITERS]
    most = F.greatest(*counts)
    n = sum((F.when(c == most, 1).otherwise(0) for c in counts), F.lit(0))
    winner = F.coalesce(*(F.when(c == most, F.lit(d)) for c, d in zip(counts, DELIMITERS, strict=True)))
    return F.when((most > 0) & (n == 1), winner)


def attribute_faults(lines: DataFrame, most_columns: int = 200, most_rows: int | None = None) -> DataFrame:
    """(table_id, row, cells) with row 1 the header -> faults: repeated or too many columns, too many rows, rows of another width."""
    header = lines.filter("row = 1").select("table_id", F.col("cells").alias("header"))
    rows = lines.filter("row > 1").join(header, "table_id")
    ragged = rows.filter(F.size("cells") != F.size("header")).select("table_id", F.lit("ragged_row").alias("fault"), F.col("row").cast("string").alias("where"))
    repeated = header.select("table_id", F.explode("header").alias("name")).groupBy("table_id", "name").count().filter("count > 1").select("table_id", F.lit("duplicate_column"), "name")
    wide = header.filter(F.size("header") > most_columns).select("table_id", F.lit("too_many_columns"), F.size("header").cast("string"))
    out = ragged.union(repeated).union(wide)
    if most_rows is not None:
        out = out.union(lines.filter("row > 1").groupBy("table_id").count().filter(F.col("count") > most_rows).select("table_id", F.lit("too_many_rows"), F.col("count").cast("string")))
    return out


#: Times the tasks of a shuffle that count or join keys.
KEY_TASKS = 4


def _key_tasks(rows: DataFrame) -> int:
    return KEY_TASKS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_faults(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both (layer_id, key): every key that keeps a layer from a one-to-one join, with side and fault.

    Both sides are counted at once by key, in KEY_TASKS times as many tasks as a shuffle has by default, so that
    a task holds the counts of few keys and nothing else: nearly every key is a row of its own.
    """
    one = lambda rows, a, b: rows.select("layer_id", "key", F.lit(a).alias("geometry"), F.lit(b).alias("attribute"))
    both = one(left, 1, 0).union(one(right, 0, 1)).repartition(_key_tasks(left), "layer_id", "key")
    counts = both.groupBy("layer_id", "key").agg(F.sum("geometry").alias("geometry"), F.sum("attribute").alias("attribute"))
    real = F.coalesce(F.trim("key") != "", F.lit(False))
    found = []
    for side, other in (("geometry", "attribute"), ("attribute", "geometry")):
        n = F.col(side)
        # a null layer meets no other
        alone = (F.col(other) == 0) | F.col("layer_id").isNull()
        for fault, wrong in (("empty_key", (n > 0) & ~real), ("duplicate_key", (n > 1) & real), ("unmatched_key", (n > 0) & real & alone)):
            found.append(F.when(wrong, F.struct(F.lit(side).alias("side"), F.lit(fault).alias("fault"))))
    return counts.select("layer_id", "key", F.explode(F.array_compact(F.array(*found))).alias("f")).select("layer_id", "key", "f.*")


def join_attributes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Features (layer_id, key, feature_id, source) with their attributes (layer_id, key, attributes); attributes win.

    A layer with any fault of `join_faults` gives no row.
    """
    bad = join_faults(left.select("layer_id", "key"), right.select("layer_id", "key")).select("layer_id").distinct()
    tasks = _key_tasks(left)
    sides = [x.repartition(tasks, "layer_id", "key") for x in (left, right.select("layer_id", "key", "attributes"))]
    rows = sides[0].join(sides[1], ["layer_id", "key"]).repartition(tasks, "layer_id").join(bad, "layer_id", "left_anti")
    return rows.withColumn("source", text.merge_maps(F.col("source"), F.col("attributes"))).drop("attributes")


def join_summary(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per layer: the numbers of features, of attribute rows, and of keys in both."""
    a = left.groupBy("layer_id").agg(F.count("*").alias("n_geometry"))
    b = right.groupBy("layer_id").agg(F.count("*").alias("n_attribute"))
    both = left.select("layer_id", "key").distinct().join(right.select("layer_id", "key").distinct(), ["layer_id", "key"]).groupBy("layer_id").agg(F.count("*").alias("n_matched"))
    return a.join(b, "layer_id", "full").join(both, "layer_id", "left").na.fill(0, ["n_geometry", "n_attribute", "n_matched"])


def profile_fault(profile: Column, has_table: Column, has_key: Column) -> Column:
    """What an upload of a profile lacks: `combined` forbids a table, `split` needs one and its key."""
    return F.when((profile == "combined") & has_table, "table_not_allowed").when((profile == "split") & ~has_table, "table_missing").when((profile == "split") & ~has_key, "key_missing").when(~profile.isin("combined", "split"), "unknown_profile")


def duplicate_layers(layers: DataFrame) -> DataFrame:
    """Versions with more than one layer of a type: none of them is ever picked."""
    return layers.groupBy("version_id", "layer_type").agg(F.count("*").alias("n_layers")).filter("n_layers > 1")


def missing_layers(projects: DataFrame, layers: DataFrame, required: list[str]) -> DataFrame:
    """(project_id, layer_type) that a run needs, the perimeter always, and the project lacks."""
    needs = F.array(*(F.lit(x) for x in dict.fromkeys(["perimetro", *required])))
    return projects.select("project_id", F.explode(needs).alias("layer_type")).join(layers.select("project_id", "layer_type"), ["project_id", "layer_type"], "left_anti")


def export_geojson(features: DataFrame) -> DataFrame:
    """One GeoJSON text for each feature: its id, and source and mapped properties, of which mapped win."""
    properties = F.to_json(text.merge_maps(F.col("source"), F.col("mapped")))
    return features.select("layer_id", "feature_id", F.concat(F.lit('{"type":"Feature","id":"'), F.col("feature_id").cast("string"), F.lit('","geometry":'), geometry.to_geojson(F.col("geom_type"), F.col("geom")), F.lit(',"properties":'), properties, F.lit("}")).alias("feature"))


def drop_layer(features: DataFrame, layer_id) -> DataFrame:
    """The features without a layer; links to its features become unresolved, and the linked features stay."""
    gone = features.filter(F.col("layer_id") == layer_id).select(F.col("feature_id").alias("parent_feature_id"), F.lit(True).alias("gone"))
    rows = features.filter(~F.col("layer_id").eqNullSafe(layer_id)).join(gone, "parent_feature_id", "left")
    lost = F.col("gone").isNotNull()
    return rows.withColumn("relation_method", F.when(lost, "unresolved").otherwise(F.col("relation_method"))).withColumn("parent_feature_id", F.when(~lost, F.col("parent_feature_id"))).drop("gone")
