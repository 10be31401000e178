"""Queries over uploaded files that Spark writes from the given tables: as many rows as orders, sound files and broken ones."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelwise.functions import geometry
from parcelwise.session import shared_dir, table
from parcelwise.sources import uploads

TABLES, COLLECTIONS = 24, 12


def _written(spark: SparkSession, lines: DataFrame, end: str = "\n") -> str:
    """(t, n, line) -> the folder of one text file for each t, its lines by n; a given number of partitions is one that Spark keeps."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    lines.repartition(TABLES, "t").sortWithinPartitions("t", "n").select("t", F.col("line").alias("value")).write.partitionBy("t").text(path, lineSep=end)
    return path


def _number(file: str) -> Column:
    return F.regexp_extract(file, "/t=([0-9]+)/", 1).cast("int")


def _orders(spark: SparkSession, sf_dir: str, files: int) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % files).cast("int").alias("t"), F.col("o_orderkey").alias("n"), "o_orderstatus", "o_orderpriority")
    return rows.withColumn("row", F.row_number().over(Window.partitionBy("t").orderBy("n")))


def _choose(kind: Column, values: dict[int, Column | str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for k, value in values.items():
        out = F.when(kind == k, value).otherwise(out)
    return out


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tables of eight kinds: three separators, cells over several lines, ragged, with a column twice, without one separator, with an open quote."""
    rows, kind = _orders(spark, sf_dir, TABLES), F.col("t") % 8
    mark = _choose(kind, {0: ",", 2: "\t"}, ";")
    note = _choose(kind, {0: F.concat(F.lit('"'), "o_orderpriority", F.lit(', ""now"""')), 3: F.concat(F.lit('"'), "o_orderpriority", F.lit('\nnext"'))}, "")
    note = F.when(note == "", F.col("o_orderpriority")).otherwise(note)
    ragged = (kind == 4) & ((F.col("row") == 1) | (F.col("n") % 50 == 0))
    line = F.concat(F.col("n").cast("string"), mark, "o_orderstatus", mark, note, F.when(ragged, ";more").when((kind == 2) & (F.col("n") % 10 == 0), "\n").otherwise(""))
    head = _choose(kind, {0: "k,status,note", 1: "﻿k;status;note", 2: "k\tstatus\tnote", 5: "k;status;status", 6: "k,status;note", 7: 'k;sta"tus;note'}, "k;status;note")
    heads = rows.select("t").distinct().select("t", F.lit(-1).cast("bigint").alias("n"), head.alias("line"))
    path = _written(spark, heads.unionByName(rows.select("t", F.col("n").cast("bigint").alias("n"), line.alias("line"))))
    return uploads.read_tables(spark, path, most_rows=None)


def attribute_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _tables(spark, sf_dir)
    cell = lambda name: F.try_element_at("attributes", F.lit(name)).alias(name)
    return rows.select(_number("table_id").alias("table_id"), F.col("row").cast("bigint").alias("row"), cell("k"), cell("status"), cell("note"))


def attribute_table_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, faults = _tables(spark, sf_dir)
    return faults.select(_number("table_id").alias("table_id"), "fault", F.col("where").alias("place"))


def _collections(spark: SparkSession, sf_dir: str) -> list[str]:
    """Collections of four kinds: on several lines, on one line, not closed, and without features."""
    rows, kind = _orders(spark, sf_dir, COLLECTIONS), F.col("t") % 4
    k = F.col("n")
    x, y = (k % 7 + 1).cast("string"), (k % 5 + 1).cast("string")
    feature = F.concat(
        F.when(F.col("row") > 1, ",").otherwise(""),
        F.lit('{"type":"Feature","properties":{"s":"'), "o_orderpriority", F.lit(' } \\" {","in":{"a":[{}]}},"id":"'), k.cast("string"),
        F.lit('","geometry":{"type":"Polygon","coordinates":[[[0,0],['), x, F.lit(",0],["), x, F.lit(","), y, F.lit("],[0,"), y, F.lit("],[0,0]]]}}"),
    )
    ends = rows.groupBy("t").agg((F.max("n") + 1).alias("last"))
    head = F.lit('{"type":"FeatureCollection","crs":{"properties":{"name":"x"}},"features":[')
    tail = F.when(kind == 2, "]").otherwise("]}")
    lines = rows.filter(kind != 3).select("t", "n", feature.alias("line")).union(ends.select("t", F.lit(-1), head)).union(ends.select("t", "last", tail))
    return [_written(spark, lines.filter(kind != 1)), _written(spark, lines.filter(kind == 1), " ")]


def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = uploads.read_geojson(spark, _collections(spark, sf_dir))
    return rows.select(_number("layer_id").alias("layer_id"), "position", "external_id", "geom_type", geometry.area(F.col("geom")).alias("area"), F.try_element_at("source", F.lit("s")).alias("s"))


def geojson_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads.geojson_faults(spark, _collections(spark, sf_dir)).select(_number("layer_id").alias("layer_id"), "fault")


def _sql(files: int) -> str:
    return f"with o as (select (o_custkey % {files})::int as t, o_orderkey as n, o_orderstatus, o_orderpriority, row_number() over (partition by o_custkey % {files} order by o_orderkey) as place from orders)"


def queries() -> dict:
    return {f.__name__: f for f in (attribute_tables, attribute_table_faults, geojson_features, geojson_faults)}


def oracle_sql() -> dict[str, str]:
    return {
        "attribute_tables": f"""{_sql(TABLES)} select t as table_id, place + 1 as row, n::varchar as k, o_orderstatus as status,
  o_orderpriority || case t % 8 when 0 then ', "now"' when 3 then chr(10) || 'next' else '' end as note from o where t % 8 < 4""",
        "attribute_table_faults": f"""{_sql(TABLES)} select t as table_id, 'ragged_row' as fault, (place + 1)::varchar as place from o where t % 8 = 4 and (place = 1 or n % 50 = 0)
union all select distinct t, 'duplicate_column', 'status' from o where t % 8 = 5 union all select distinct t, 'no_single_delimiter', null from o where t % 8 = 6 union all select distinct t, 'open_quote', null from o where t % 8 = 7""",
        "geojson_features": f"""{_sql(COLLECTIONS)} select t as layer_id, (place - 1)::int as position, n::varchar as external_id, 'Polygon' as geom_type, ((n % 7 + 1) * (n % 5 + 1))::double as area, o_orderpriority || ' }} " {{' as s from o where t % 4 < 2""",
        "geojson_faults": f"{_sql(COLLECTIONS)} select distinct t as layer_id, case t % 4 when 2 then 'unbalanced' else 'empty' end as fault from o where t % 4 > 1",
    }
