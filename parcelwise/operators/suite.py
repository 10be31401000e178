"""All 35 indicators of all projects as one long table: project_id, indicator_code, key, sub_field, value, label.

What several indicators need is measured once and stored: territory sums, the
dissolved perimeter, blocks, the noded network, frontages and their nearest
nodes.  A project for which an indicator can't be computed has no row of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.operators import blocks, boundary, frontage, overlay, roads, territory
from parcelwise.session import released, spread

ROW = "array<struct<indicator_code:string,key:string,sub_field:string,value:double,label:string>>"


def _row(code: str, value: Column | None = None, key: Column | None = None, sub_field: str | None = None, label: Column | None = None) -> Column:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(F.lit(code).alias("indicator_code"), text(key).alias("key"), F.lit(sub_field).cast("string").alias("sub_field"), (F.lit(None) if value is None else value).cast("double").alias("value"), text(label).alias("label"))


def _spread(rows: DataFrame, *found: Column) -> DataFrame:
    return rows.select("project_id", F.explode(F.array(*found)).alias("r")).select("project_id", "r.*")


def _sums(features: DataFrame) -> DataFrame:
    """One row per project: `areas`, `parcelable`, `uses` as arrays of (key, v), and the sums of its lots.

    Features are summed by category before anything else, so that a project is a
    few rows, however many features it has; its arrays are as long as the vocabularies.
    """
    rows = territory.measured(features)
    lot = F.coalesce(F.col("macroarea") == territory.LOT, F.lit(False))
    valid = lot & F.col("geometric").isNotNull()
    ca = F.when(F.col("ca_max") >= 0, F.col("ca_max").cast("double"))
    trade = lot & F.col("land_use").isin(*territory.NON_RESIDENTIAL) & ca.isNotNull()
    kind = F.coalesce("macroarea", F.lit("nulo")).alias("kind")
    by = rows.groupBy("project_id", kind, F.coalesce("parcelavel", F.lit(False)).alias("may"), F.when(lot, F.col("land_use")).alias("use")).agg(
        F.sum("area").alias("area"),
        F.count_if(valid).alias("valid"),
        F.sum(F.when(valid, F.col("lot_area") * ca)).alias("built"),
        F.count(F.when(valid, ca)).alias("with_ca"),
        F.sum(F.when(valid, F.col("lot_area"))).alias("lots"),
        F.sum(F.when(valid & ca.isNotNull(), F.col("lot_area"))).alias("covered"),
        F.sum(F.when(trade, F.col("area") * ca)).alias("trade_built"),
        F.sum(F.when(trade, F.col("area"))).alias("trade_area"),
        F.count_if(lot).alias("n_lots"),
    )
    names = ("valid", "built", "with_ca", "lots", "covered", "trade_built", "trade_area", "n_lots")
    part = lambda name, key, value=None: F.struct(F.lit(name).alias("part"), key.cast("string").alias("key"), (F.col("area") if value is None else value).cast("double").alias("v"))
    each = [part("areas", F.col("kind")), F.when(F.col("may"), part("parcelable", F.col("kind"))), F.when(F.col("use").isNotNull(), part("uses", F.col("use")))]
    each += [part(n, F.lit(None), F.col(n)) for n in names]
    sums = by.select("project_id", F.explode(F.array_compact(F.array(*each))).alias("p")).groupBy("project_id", "p.part", "p.key").agg(F.sum("p.v").alias("v"))
    of = lambda name: F.when(F.col("part") == name, F.col("v"))
    lists = [F.collect_list(F.when(F.col("part") == n, F.struct("key", "v"))).alias(n) for n in ("areas", "parcelable", "uses")]
    return sums.groupBy("project_id").agg(*lists, *(F.sum(of(n)).alias(n) for n in names))


def _total(name: str, wanted=lambda x: F.lit(True)) -> Column:
    """The sum of an array's values; what is null counts as nothing."""
    return F.aggregate(F.filter(name, wanted), F.lit(0.0), lambda s, x: s + F.coalesce(x["v"], F.lit(0.0)))


def territory_rows(features: DataFrame) -> DataFrame:
    """The thirteen indicators of territory features, from one pass over them."""
    sums = spread(_sums(features))
    none = F.array().cast(ROW)

    def each(code: str, name: str, whole: Column | None = None) -> Column:
        if whole is None:
            return F.transform(name, lambda x: _row(code, x["v"], x["key"])).cast(ROW)
        return F.when(whole > 0, F.transform(name, lambda x: _row(code, x["v"] / whole, x["key"])).cast(ROW)).otherwise(none)

    def one(code: str, value: Column | None, when: Column | None = None, label: Column | None = None) -> Column:
        made = F.array(_row(code, value, label=label)).cast(ROW)
        return made if when is None else F.when(when, made).otherwise(none)

    uses = _total("uses")
    most = F.array_max(F.transform("uses", lambda x: x["v"]))
    leaders = F.filter("uses", lambda x: x["v"] == most)
    shares = F.filter(F.transform("uses", lambda x: x["v"] / uses), lambda p: p > 0)
    h = F.when(F.size(shares) > 0, F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.ln(p)))
    valid = F.col("valid") > 0
    built = F.coalesce("built", F.lit(0.0))
    bare = _total("areas", lambda x: x["key"] != territory.LOT)
    rows = F.concat(
        each("territorial.area_by_category", "areas"),
        each("territorial.percent_by_category", "parcelable", _total("parcelable")),
        each("land_use.area_by_category", "uses"),
        each("land_use.percent_by_category", "uses", uses),
        one("land_use.predominant_use", None, label=F.when(F.size(leaders) == 1, F.get(leaders, F.lit(0))["key"])),
        one("land_use.diversity_shannon", h),
        one("green_areas.total_area", _total("areas", lambda x: x["key"] == "avl")),
        one("green_areas.total_area_with_app", _total("areas", lambda x: x["key"].isin("avl", "app"))),
        one("density.max_computable_area", built, valid),
        one("density.lot_count_with_ca", F.col("with_ca"), valid),
        one("density.ca_coverage", F.when(F.col("lots") > 0, F.coalesce("covered", F.lit(0.0)) / F.col("lots")), valid),
        one("density.built_open_ratio", F.when(bare > 0, built / bare), valid & (bare > 0)),
        one("density.non_residential_ca", F.when(F.col("trade_area") > 0, F.col("trade_built") / F.col("trade_area")), F.col("n_lots") > 0),
    )
    return sums.select("project_id", F.explode(rows).alias("r")).select("project_id", "r.*")


def perimeter_rows(whole: DataFrame, territory_values: DataFrame) -> DataFrame:
    """Of the dissolved perimeter (blocks.perimeter) its own three, and the green areas' shares of it."""
    own = _spread(whole, _row("territorial.total_area", F.col("area")), _row("territorial.perimeter", F.col("length")), _row("territorial.compactness", F.col("compactness")))
    names = {f"green_areas.total_area{end}": f"green_areas.percent_of_project{end}" for end in ("", "_with_app")}
    code = F.create_map(*(F.lit(v) for pair in names.items() for v in pair))
    green = territory_values.filter(F.col("indicator_code").isin(*names)).join(whole.select("project_id", "area").filter("area > 0"), "project_id")
    shares = green.select("project_id", code[F.col("indicator_code")].alias("indicator_code"), "key", "sub_field", (F.col("value") / F.col("area")).alias("value"), "label")
    return own.unionByName(shares)


def block_rows(features: DataFrame) -> DataFrame:
    """Five indicators of blocks and the parceling efficiency, keyed by quadra_id."""
    stats = spread(blocks.block_stats(features))
    q = F.col("quadra_id")
    found = _spread(stats, *(_row("quadras.stats", F.col(c), q, name) for name, c in (("area_m2", "area"), ("perimetro_m", "length"), ("quantidade_lotes", "n_lots"))), _row("quadras.compactness", F.col("compactness"), q))
    sides = _spread(blocks.block_rectangles(features), *(_row("quadras.min_rotated_rectangle", F.col(c), q, name) for name, c in (("comprimento_m", "long_side"), ("largura_m", "short_side"))), _row("quadras.orientation", F.col("orientation"), q), _row("quadras.face_length_score", F.col("face_score"), q))
    return found.unionByName(sides).unionByName(_spread(blocks.parceling_efficiency(features, stats), _row("lots.parceling_efficiency", F.col("value"), q)))


def road_rows(edges: DataFrame, perimeter: DataFrame, whole: DataFrame, lines: DataFrame) -> DataFrame:
    """Eight indicators of the noded network; a project without a usable perimeter lacks the two that need one."""
    names = {"total_length": "total_length", "existing_length": "existing_length", "proposed_length": "proposed_length", "intersection_count": "intersections", "proposed_connection_count": "proposed_connections", "link_node_ratio": "link_node_ratio"}
    found = spread(roads.measures(edges, perimeter, whole))
    scalars = _spread(found, *(_row(f"road_network.{code}", F.col(c)) for code, c in names.items()))
    bounded = found.join(whole.filter("area > 0").select("project_id"), "project_id", "left_semi")
    gaps = boundary.max_boundary_gap(perimeter, lines).join(found.select("project_id"), "project_id", "left_semi")
    return scalars.unionByName(_spread(bounded, _row("road_network.intersection_density", F.col("intersection_density")))).unionByName(_spread(gaps, _row("road_network.max_boundary_gap", F.col("value"))))


def lot_rows(features: DataFrame, footprint: DataFrame, edges: DataFrame) -> DataFrame:
    """Frontage and both walking distances, keyed by feature_id; frontages and nearest nodes are found once for the three."""
    parts = frontage.frontage_parts(features, footprint)
    near = spread(frontage.access_points(features, footprint, edges, parts))
    key = F.col("feature_id")
    found = {
        frontage.FRONTAGE: frontage.frontage_length(features.filter(F.col("macroarea") == territory.LOT), footprint, parts=parts),
        "lots.distance_to_non_residential_use": frontage.non_residential_distance(features, footprint, edges, near),
        "lots.distance_to_green_area": frontage.green_distance(features, footprint, edges, near),
    }
    return reduce(DataFrame.unionByName, (_spread(rows, _row(code, F.col("value"), key)) for code, rows in found.items()))


def values(features: DataFrame, perimeter: DataFrame, lines: DataFrame, footprint: DataFrame, unlinks: DataFrame | None = None) -> DataFrame:
    """All indicators of projects with these layers: territory features, perimeter polygons, road centrelines, road footprint."""
    # each layer is read several times
    features, perimeter, lines, footprint = (spread(x) for x in (territory.with_geometric(features), perimeter, lines, footprint))
    edges = roads.network(lines, unlinks)
    whole = spread(blocks.perimeter(perimeter.filter(overlay.usable(perimeter))))
    own = territory_rows(features)
    out = spread(reduce(DataFrame.unionByName, (own, perimeter_rows(whole, own), block_rows(features), road_rows(edges, perimeter, whole, lines), lot_rows(features, footprint, edges))))
    released(features, perimeter, lines, footprint, edges, whole)
    return out
