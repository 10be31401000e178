"""Field profiles, recommendations and samples of layers' attributes.

Input: features with layer_id, feature_id and `source`, a map of text.  All
profiles come from one explode of the map and sums by (layer, field).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelwise.session import stored

#: Distinct values up to which a field's values are listed, and categories are drawn.
MOST_CATEGORIES = 32
#: Bins of a round in the search for ranks, and intervals up to which they are broadcast.
BINS, MOST_SPANS = 1024, 50_000
NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"


def fields(features: DataFrame) -> DataFrame:
    """layer_id, feature_id, field, value: one row per attribute."""
    return features.select("layer_id", "feature_id", F.explode("source").alias("field", "value"))


def field_stats(features: DataFrame) -> DataFrame:
    """Per field: how often present and empty, distinct values that are not blank, numbers and their range."""
    rows = fields(features).withColumn("filled", F.when(F.trim("value") != "", F.col("value")))
    number = F.when(F.col("filled").rlike(NUMBER), F.col("filled").try_cast("double"))
    # the distinct values first: their counts carry everything else, so no value list is held
    values = rows.groupBy("layer_id", "field", "filled").agg(F.count("*").alias("n"), F.first(number).alias("number"))
    return values.groupBy("layer_id", "field").agg(
        F.sum("n").alias("present_count"),
        F.coalesce(F.sum(F.when(F.col("filled").isNull(), F.col("n"))), F.lit(0)).alias("empty_count"),
        F.count("filled").alias("cardinality"),
        F.coalesce(F.sum(F.when(F.col("number").isNotNull(), F.col("n"))), F.lit(0)).alias("numeric_count"),
        F.min("number").alias("numeric_min"),
        F.max("number").alias("numeric_max"),
    )


def field_values(features: DataFrame, most: int = MOST_CATEGORIES + 1) -> DataFrame:
    """The first values, sorted, of fields with at most `most` of them."""
    few = field_stats(features).filter(F.col("cardinality") <= most).select("layer_id", "field")
    values = fields(features).filter(F.trim("value") != "").select("layer_id", "field", "value").distinct().join(few, ["layer_id", "field"])
    return values.withColumn("rank", F.row_number().over(Window.partitionBy("layer_id", "field").orderBy("value"))).filter(F.col("rank") <= most)


def field_mode(stats: DataFrame, boolean: Column | None = None) -> DataFrame:
    """What a field holds and how it may be drawn; `mode` is null with a reason where it may not."""
    filled = F.col("present_count") - F.col("empty_count")
    boolean = F.lit(False) if boolean is None else boolean
    rules = (
        (filled <= 0, "empty", None, "field_empty"),
        (boolean, "boolean", "categorical", None),
        ((F.col("numeric_count") == filled) & (F.col("cardinality") == 1), "numeric", "single", None),
        (F.col("numeric_count") == filled, "numeric", "sequential", None),
        (F.col("numeric_count") > 0, "mixed", None, "mixed_types"),
        (F.col("cardinality") > MOST_CATEGORIES, "text", None, "categorical_cardinality_exceeded"),
        (F.lit(True), "text", "categorical", None),
    )
    out = F.lit(None).cast("struct<kind:string,mode:string,reason:string>")
    for when, kind, mode, reason in reversed(rules):
        out = F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(mode).cast("string").alias("mode"), F.lit(reason).cast("string").alias("reason"))).otherwise(out)
    return stats.withColumn("rule", out).select("layer_id", "field", "rule.kind", "rule.mode", "rule.reason")


def field_sample(features: DataFrame, n_features: int = 20, n_values: int = 5) -> DataFrame:
    """Up to five distinct values, sorted, of a layer's first twenty features by id."""
    first = features.withColumn("rank", F.row_number().over(Window.partitionBy("layer_id").orderBy("feature_id"))).filter(F.col("rank") <= n_features)
    values = fields(first).filter(F.trim("value") != "").groupBy("layer_id", "field").agg(F.sort_array(F.collect_set("value")).alias("sample"))
    return values.withColumn("sample", F.slice("sample", 1, n_values))


def mapped_stats(features: DataFrame, text: tuple[str, ...], numeric: tuple[str, ...], boolean: tuple[str, ...]) -> DataFrame:
    """The same counts for typed columns that have a value at all; numbers have no list of values, so no cardinality."""
    parts = []
    for name in (*text, *numeric, *boolean):
        value = F.col(name)
        parts.append(F.struct(F.lit(name).alias("field"), F.count(value).alias("present_count"), (F.lit(None).cast("bigint") if name in numeric else F.count_distinct(value)).alias("cardinality"), (F.min(value).cast("double") if name in numeric else F.lit(None).cast("double")).alias("numeric_min"), (F.max(value).cast("double") if name in numeric else F.lit(None).cast("double")).alias("numeric_max")))
    rows = features.groupBy("layer_id").agg(F.array(*parts).alias("parts")).select("layer_id", F.explode("parts").alias("p")).select("layer_id", "p.*")
    return rows.filter("present_count > 0")


def class_domain(values: DataFrame, numeric: bool) -> DataFrame:
    """(layer_id, field, value) -> the domain of a thematic map: the range, or the sorted distinct values."""
    if numeric:
        return values.groupBy("layer_id", "field").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return values.select("layer_id", "field", "value").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("layer_id", "field").orderBy("value")))


def order_statistics(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """(key, value), (key, rank from 0) -> key, rank, value: the value at a rank of its key's sorted values.

    Each round counts the values of the open intervals in BINS bins and goes on with the bins in which
    ranks lie, until such a bin holds one distinct value: no key's values are held or sorted.  Nulls and
    values that aren't finite have no rank; a rank beyond the key's values has no row.
    """
    rows = values.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))).select("key", F.col("value").cast("double").alias("value"))
    spans = rows.groupBy("key").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
    todo = stored(ranks.select("key", "rank").distinct().join(spans, "key").filter("rank >= 0 and rank < n").select("key", "rank", F.col("rank").alias("left"), "low", "high"))
    done = None
    while True:
        found = todo.filter("low = high").select("key", "rank", F.col("low").alias("value"))
        done = found if done is None else done.unionByName(found)
        spans = todo.filter("low < high").select("key", "low", "high").distinct()
        n = spans.count()
        if not n:
            return done
        # intervals of a key are apart, so that a value is in one at most
        near = rows.join(F.broadcast(spans) if n <= MOST_SPANS else spans, "key").filter(F.col("value").between(F.col("low"), F.col("high")))
        # halves, as the width of all doubles is none
        place = (F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        bin_ = F.least(F.lit(BINS - 1), F.floor(place * BINS).cast("int")).alias("bin")
        bins = near.groupBy("key", "low", "high", bin_).agg(F.count("*").alias("n"), F.min("value").alias("b_low"), F.max("value").alias("b_high"))
        before = F.sum("n").over(Window.partitionBy("key", "low", "high").orderBy("bin")) - F.col("n")
        met = todo.join(bins.withColumn("before", before), ["key", "low", "high"]).filter((F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("n")))
        todo = stored(met.select("key", "rank", (F.col("left") - F.col("before")).alias("left"), F.col("b_low").alias("low"), F.col("b_high").alias("high")))


def quantiles(values: DataFrame, n: int) -> DataFrame:
    """(key, value) -> key, class, break: the n - 1 inner quantiles, between two values in proportion to the place."""
    finite = values.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    counts = finite.groupBy("key").agg(F.count("*").alias("n"))
    places = counts.select("key", F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("class"), "n").withColumn("place", F.col("class") / n * (F.col("n") - 1))
    ends = places.select("key", "class", "place", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct()
    found = order_statistics(values, ends).join(ends, ["key", "rank"])
    low, high = F.min("value"), F.max("value")
    return found.groupBy("key", "class", "place").agg((low + (high - low) * (F.col("place") - F.floor("place"))).alias("break")).select("key", "class", "break")


def class_breaks(values: DataFrame, scale: str, n: int, thresholds: tuple[float, ...] = ()) -> DataFrame:
    """(key, value) -> key, class, break: the n - 1 inner breaks of a scale, by key."""
    low, high, k = F.col("low"), F.col("high"), F.col("class")
    if scale == "quantile":
        return quantiles(values, n)
    if scale == "threshold":
        return values.select("key").distinct().select("key", F.posexplode(F.array(*map(F.lit, thresholds))).alias("class", "break")).withColumn("class", F.col("class") + 1)
    there, back = {"linear": (lambda x: x, lambda x: x), "quantize": (lambda x: x, lambda x: x), "sqrt": (F.sqrt, lambda x: x * x), "log": (F.ln, F.exp)}[scale]
    ranges = values.groupBy("key").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return ranges.select("key", "low", "high", F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("class")).select("key", "class", back(there(low) + (there(high) - there(low)) * k / n).alias("break"))
