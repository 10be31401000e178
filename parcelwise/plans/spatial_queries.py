"""Queries over unions, blocks and selections, with closed-form SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.functions import geometry
from parcelwise.operators import blocks, boundary, overlay, territory
from parcelwise.plans.derived import PARCELS_SQL, parcels
from parcelwise.session import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def _rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rectangles for each customer's project, overlapping, touching or apart."""
    k = F.col("c_custkey")
    one = geometry.box(F.lit(0), F.lit(0), 10 + k % 7, 8 + k % 5)
    two = geometry.box(k % 12, k % 9, k % 12 + 9, k % 9 + 11)
    return table(spark, sf_dir, "customer").select(k.alias("project_id"), F.posexplode(F.array(one, two)).alias("feature_id", "geom"))


_UNION = """r as (select c_custkey as project_id, 10 + c_custkey % 7 as w1, 8 + c_custkey % 5 as h1, least(10 + c_custkey % 7, c_custkey % 12 + 9) - c_custkey % 12 as w, least(8 + c_custkey % 5, c_custkey % 9 + 11) - c_custkey % 9 as h from customer),
u as (select project_id, (w1 * h1 + 99 - greatest(w, 0) * greatest(h, 0))::double as area, (2 * (w1 + h1) + 40 - case when w >= 0 and h >= 0 then 2 * (w + h) else 0 end)::double as length from r)"""


@query(f"with {_UNION} select project_id, round(area, 4) as area, round(length, 4) as length, round(4 * pi() * area / (length * length), 6) as compactness from u")
def perimeter_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks.perimeter(_rectangles(spark, sf_dir))
    return rows.select("project_id", F.round("area", 4).alias("area"), F.round("length", 4).alias("length"), F.round("compactness", 6).alias("compactness"))


def _extent(features: DataFrame) -> DataFrame:
    """One perimeter box around each project's parcels."""
    b = geometry.bounds(F.col("geom"))
    box = features.select("project_id", b.alias("b")).groupBy("project_id").agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))
    return box.select("project_id", F.lit(0).alias("feature_id"), geometry.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("geom"))


def _green_sql(kinds: str) -> str:
    return f"""with {PARCELS_SQL} select project_id, round(sum(case when macroarea in ({kinds}) then area else 0 end) / ((max(x0 + w) - min(x0)) * (max(y0 + d) - min(y0))), 6) as value from areas group by project_id"""


def _green_share(spark: SparkSession, sf_dir: str, with_app: bool) -> DataFrame:
    rows = parcels(spark, sf_dir)
    whole = blocks.perimeter(_extent(rows)).select("project_id", F.col("area").alias("value"))
    return territory.green_share(rows, whole, with_app).select("project_id", F.round("value", 6).alias("value"))


BLOCKS_SQL = f"""with {PARCELS_SQL}, l as (select project_id, quadra_id, slot, d, area, geometric, lag(slot) over w as ps, lag(d) over w as pd from areas where macroarea = 'lote' window w as (partition by project_id, quadra_id order by slot)),
b as (select project_id, quadra_id, count(*) as n_lots, sum(geometric) as area, sum(20 + 2 * d) - sum(case when ps = slot - 1 then 2 * least(d, pd) else 0 end) as length, sum(area) as lots,
  max(slot) - min(slot) + 1 as n, max(d) as deep from l group by all)"""


@query(f"{BLOCKS_SQL} select project_id, quadra_id, n_lots, round(area, 4) as area, round(length, 4) as length, round(4 * pi() * area / (length * length), 6) as compactness from b")
def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks.block_stats(parcels(spark, sf_dir))
    return rows.select("project_id", "quadra_id", "n_lots", F.round("area", 4).alias("area"), F.round("length", 4).alias("length"), F.round("compactness", 6).alias("compactness"))


@query(f"{BLOCKS_SQL} select project_id, quadra_id, round(lots / area, 6) as value from b")
def parceling_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.parceling_efficiency(parcels(spark, sf_dir)).withColumn("value", F.round("value", 6))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lot's block as one box, turned by nothing: the closed form of its smallest rectangle is known."""
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    wide, deep = (20 + k % 300).cast("double"), (7 + k % 11).cast("double")
    turned = k % 2 == 1
    box = geometry.box(F.lit(0), F.lit(0), F.when(turned, deep).otherwise(wide), F.when(turned, wide).otherwise(deep))
    return orders.select(F.floor(F.col("o_custkey") / 8).cast("bigint").alias("project_id"), k.alias("feature_id"), F.concat(F.lit("B"), k.cast("string")).alias("quadra_id"), F.lit("lote").alias("macroarea"), box.alias("geom"))


@query("""with b as (select o_custkey // 8 as project_id, 'B' || o_orderkey as quadra_id, (20 + o_orderkey % 300)::double as long_side, (7 + o_orderkey % 11)::double as short_side, o_orderkey % 2 = 1 as north from orders)
select project_id, quadra_id, long_side, short_side, case when north then 0.0 else 90.0 end::double as orientation,
  round(case when long_side <= 120 then 1.0 when long_side >= 250 then 0.1 else 1 - (long_side - 120) / 130 * 0.9 end, 6)::double as face_score, long_side > 250 as out_of_compliance from b""")
def block_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks.block_rectangles(_boxes(spark, sf_dir))
    return rows.select("project_id", "quadra_id", *(F.round(c, 6).alias(c) for c in ("long_side", "short_side", "orientation", "face_score")), "out_of_compliance")


@query("""select o_custkey // 8 as project_id, 'quadras.face_length_score' as indicator_code, 'block_face_out_of_compliance' as code, 'warning' as severity, 'B' || o_orderkey as quadra_id, o_orderkey as feature_id from orders where o_orderkey % 300 > 230""")
def block_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.warnings(_boxes(spark, sf_dir))


@query(f"""{BLOCKS_SQL} select p.project_id, p.feature_id, case when b.n_lots is not null and p.macroarea = 'lote' then p.project_id || '/' || p.quadra_id end as parent_feature_id,
  case when b.n_lots is not null and p.macroarea = 'lote' then 'attribute' else 'unresolved' end as relation_method, case when p.macroarea = 'lote' then b.n_lots end as lots from parcels p left join b using (project_id, quadra_id)""")
def derive_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, children = blocks.derive_blocks(parcels(spark, sf_dir))
    counted = children.join(made.select(F.col("block_id").alias("parent_feature_id"), F.col("quantidade_lotes").alias("lots")), "parent_feature_id", "left")
    return counted.select("project_id", "feature_id", "parent_feature_id", "relation_method", "lots")


@query(f"{BLOCKS_SQL} select b.project_id, b.quadra_id, case when parts > 1 then 'MultiPolygon' else 'Polygon' end as geom_type, parts as n_parts, round(area, 4) as area, round(length, 4) as length, n_lots from b join (select project_id, quadra_id, count(case when ps is null or ps < slot - 1 then 1 end) as parts from l group by all) using (project_id, quadra_id)")
def block_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived blocks as polygons: lots side by side make one part."""
    made, _ = blocks.derive_blocks(parcels(spark, sf_dir))
    parts = (F.element_at("geom", -1)["part"] + 1).cast("bigint").alias("n_parts")
    return made.select("project_id", "quadra_id", "geom_type", parts, F.round(geometry.area(F.col("geom")), 4).alias("area"), F.round(geometry.length(F.col("geom")), 4).alias("length"), F.col("quantidade_lotes").alias("n_lots"))


def _sources(rows: DataFrame, wide: bool) -> DataFrame:
    """A box for each parcel, in, over or beside it, or around it."""
    k, b = F.col("feature_id"), geometry.bounds(F.col("geom"))
    x, y = (b["x0"] - k % 3, b["y0"] - k % 2) if wide else (b["x0"] + 1 + k % 3, b["y0"] + k % 4)
    far = (b["x0"] + 8 + k % 5, b["y0"] + 7 + k % 9) if wide else (x + 2 + k % 13, y + 1 + k % 19)
    return rows.select("project_id", "feature_id", geometry.box(x, y, *far).alias("geom"))


_SELECT = f"""with {PARCELS_SQL}, t as (select project_id, feature_id, x0, y0, x0 + w as x1, y0 + d as y1 from parcels),
narrow as (select project_id, x0 + 1 + feature_id % 3 as a0, y0 + feature_id % 4 as b0, x0 + 3 + feature_id % 3 + feature_id % 13 as a1, y0 + 1 + feature_id % 4 + feature_id % 19 as b1 from parcels),
wide as (select project_id, x0 - feature_id % 3 as a0, y0 - feature_id % 2 as b0, x0 + 8 + feature_id % 5 as a1, y0 + 7 + feature_id % 9 as b1 from parcels)
select distinct project_id, feature_id from t join """
_RELATIONS = {
    "intersects": "a0 <= x1 and a1 >= x0 and b0 <= y1 and b1 >= y0",
    "contains": "a0 >= x0 and a1 <= x1 and b0 >= y0 and b1 <= y1",
    "within": "x0 >= a0 and x1 <= a1 and y0 >= b0 and y1 <= b1",
    "dwithin": "power(greatest(a0 - x1, x0 - a1, 0), 2) + power(greatest(b0 - y1, y0 - b1, 0), 2) <= 25",
}


def _select(spark: SparkSession, sf_dir: str, relation: str) -> DataFrame:
    rows = parcels(spark, sf_dir)
    return overlay.related(rows.select("project_id", "feature_id", "geom"), _sources(rows, relation == "within"), ["project_id"], relation, 5.0)


@query(f"with {PARCELS_SQL} select project_id, feature_id from parcels where land_use = 'misto' and macroarea = 'lote'")
def select_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parcels(spark, sf_dir).withColumn("mapped", F.create_map(F.lit("macroarea"), F.col("macroarea")))
    return overlay.attribute_filter(rows, {"land_use": "misto", "macroarea": "lote"}).select("project_id", "feature_id")


@query("""select c_custkey as project_id, case when c_custkey % 3 = 0 then 400.0 else greatest(300 - 2 * (10 + c_custkey % 50), 100 + 2 * (10 + c_custkey % 50)) end::double as value from customer""")
def boundary_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square of 100 m for each customer, and in two of three a road across it."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("project_id"), (10 + k % 50).cast("double").alias("x"))
    square = rows.select("project_id", F.lit(0).alias("feature_id"), geometry.box(F.lit(0), F.lit(0), F.lit(100), F.lit(100)).alias("geom"))
    road = rows.filter("project_id % 3 <> 0").select("project_id", F.lit(1).alias("feature_id"), geometry.line(geometry.point(F.col("x"), F.lit(-5)), geometry.point(F.col("x"), F.lit(105))).alias("geom"))
    return boundary.max_boundary_gap(square, road).withColumn("value", F.round("value", 6))


def queries() -> dict:
    return Q | {f"select_{r}": partial(_select, relation=r) for r in _RELATIONS} | {"green_share": partial(_green_share, with_app=False), "green_share_with_app": partial(_green_share, with_app=True)}


def oracle_sql() -> dict[str, str]:
    return SQL | {f"select_{r}": f"{_SELECT}{'wide' if r == 'within' else 'narrow'} s using (project_id) where {w}" for r, w in _RELATIONS.items()} | {"green_share": _green_sql("'avl'"), "green_share_with_app": _green_sql("'avl', 'app'")}
