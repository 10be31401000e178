"""Layers that Spark derives from the given tables, and the same in SQL.

Parcels come from orders: a project for every eight customers, so that projects
grow with the data; eight parcels side by side make a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelwise.functions import geometry
from parcelwise.functions.text import land_use
from parcelwise.session import table

MACRO = ("lote", "lote", "lote", "lote", "lote", "lote", "sistema_viario", "avl", "app", "aci")


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of layer territorio: boxes of 10 m by 8 to 12 m with the attributes of the typed columns."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    slot = F.row_number().over(Window.partitionBy("project_id").orderBy("o_orderkey")) - 1
    rows = orders.withColumn("project_id", F.floor(F.col("o_custkey") / 8).cast("bigint")).withColumn("slot", slot)
    key = F.col("o_orderkey")
    x0, y0 = (F.col("slot") % 8 * 10).cast("double"), (F.floor(F.col("slot") / 8) * 20).cast("double")
    deep = (8 + F.col("slot") % 5).cast("double")
    kind = F.element_at(F.array(*map(F.lit, MACRO)), (key % 10 + 1).cast("int"))
    use = (
        F.when(key % 6 == 0, "Residencial")
        .when(key % 6 == 1, "comercial")
        .when(key % 6 == 2, "Residencial; Serviços")
        .when(key % 6 == 3, "INSTITUCIONAL")
        .when(key % 6 == 4, "(none)")
    )
    return rows.select(
        "project_id",
        key.alias("feature_id"),
        F.lit("Polygon").alias("geom_type"),
        geometry.box(x0, y0, x0 + 10, y0 + deep).alias("geom"),
        F.when(key % 11 != 3, kind).alias("macroarea"),
        F.when(key % 3 != 2, key % 3 == 0).alias("parcelavel"),
        land_use(use).alias("land_use"),
        F.concat(F.lit("Q-"), F.floor(F.col("slot") / 8).cast("string")).alias("quadra_id"),
        F.when(key % 7 != 6, key % 7 / 2.0).alias("ca_max"),
        F.when(key % 4 == 0, F.col("o_totalprice") / 1000).alias("reference_area_m2"),
        "slot",
    )


PARCELS_SQL = """
parcels as (
  select project_id, feature_id, slot, case when feature_id % 11 <> 3 then m end as macroarea,
    case when feature_id % 3 <> 2 then feature_id % 3 = 0 end as parcelavel,
    case feature_id % 6 when 0 then 'residencial' when 1 then 'comercial' when 2 then 'misto' when 3 then 'institucional' end as land_use,
    'Q-' || (slot // 8) as quadra_id, case when feature_id % 7 <> 6 then feature_id % 7 / 2.0 end as ca_max,
    case when feature_id % 4 = 0 then price / 1000 end as reference_area_m2, 10.0 * (8 + slot % 5) as geometric,
    (slot % 8) * 10.0 as x0, (slot // 8) * 20.0 as y0, 10.0 as w, 8.0 + slot % 5 as d
  from (select o_orderkey as feature_id, o_custkey // 8 as project_id, o_totalprice as price,
    ['lote', 'lote', 'lote', 'lote', 'lote', 'lote', 'sistema_viario', 'avl', 'app', 'aci'][(o_orderkey % 10 + 1)::int] as m,
    row_number() over (partition by o_custkey // 8 order by o_orderkey) - 1 as slot from orders)),
areas as (select *, coalesce(reference_area_m2, geometric) as area,
  coalesce(case when reference_area_m2 >= 0 then reference_area_m2 end, geometric) as lot_area from parcels)"""
