"""Many uploaded files in one job: GeoJSON and attribute tables, cut into records at borders found over all tasks.

A file is read as pieces of text by as many tasks as it has splits.  What a
piece means depends on all text before it: whether it begins in a quoted text,
how deep in brackets, in which record.  These are running sums, taken in two
steps: within a split, and over the sums of the splits, which are few.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parcelwise.functions import geometry, text
from parcelwise.session import stored
from parcelwise.sources.layers import DELIMITERS, attribute_faults, delimiter

#: Splits whose sums are broadcast, at most: about 1 MB.
SPLITS = 5000
FEATURE = "type string, id string, geometry struct<type:string, coordinates:string>, properties map<string,string>"


def _files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """file and size of every file, contents not read; Spark lists no file of zero bytes, so such files have no row anywhere here."""
    return spark.read.option("recursiveFileLookup", True).format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"))


def _pieces(spark: SparkSession, paths: list[str] | str, end: str | None = None) -> DataFrame:
    """file, split, place and piece: the texts between ends (lines by default); split and place give their order."""
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader if end is None else reader.option("lineSep", end)
    meta = F.col("_metadata")
    return reader.text(paths).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("piece"))


def running(rows: DataFrame, **sums: Column) -> DataFrame:
    """Adds to (file, split, place) under each name the sum of its column over the rows before it in the file."""
    rows = rows.withColumns({f"_{name}": column.cast("bigint") for name, column in sums.items()})
    over_splits = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    in_split = Window.partitionBy("file", "split").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("file", "split").agg(*(F.sum(f"_{name}").alias(name) for name in sums))
    before = totals.select("file", "split", *(F.coalesce(F.sum(name).over(over_splits), F.lit(0)).alias(f"_{name}_before") for name in sums))
    local = rows.withColumns({name: F.coalesce(F.sum(f"_{name}").over(in_split), F.lit(0)) for name in sums})
    out = local.join(before, ["file", "split"])
    return out.withColumns({name: F.col(name) + F.col(f"_{name}_before") for name in sums}).drop(*(f"_{name}" for name in sums), *(f"_{name}_before" for name in sums))


def _in_split(batches: Iterator[pa.RecordBatch], names: list[str], by: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns _<name> of a split's rows, which come in their order, as sums over the rows before."""
    last, carried = None, dict.fromkeys(names, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        places = [batch.column(c).dictionary_encode().indices.to_numpy() for c in by]
        first = np.append(True, np.any([p[1:] != p[:-1] for p in places], axis=0))
        start = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        ends = [[batch.column(c)[k].as_py() for c in by] for k in (0, batch.num_rows - 1)]
        for name in names:
            step = batch.column(f"_{name}").to_numpy()
            before = np.cumsum(step) - step
            total = before - before[start] + np.where(start == 0, carried[name] if ends[0] == last else 0, 0)
            carried[name] = int(total[-1] + step[-1])
            batch = batch.append_column(name, pa.array(total))
        last = ends[1]
        yield batch


def _local(rows: DataFrame, sums: dict[str, Column], by: list[str]) -> DataFrame:
    """The sums over the rows before in a split.  Rows must come as a scan gives them: those of a split in one task, in their order, as they also leave here."""
    rows = rows.withColumns({f"_{name}": F.coalesce(column.cast("bigint"), F.lit(0).cast("bigint")) for name, column in sums.items()})
    schema = T.StructType([*rows.schema.fields, *(T.StructField(name, T.LongType()) for name in sums)])
    return rows.mapInArrow(partial(_in_split, names=list(sums), by=by), schema).drop(*(f"_{name}" for name in sums))


def _ends(rows: DataFrame, sums: dict[str, Column], by: list[str]) -> DataFrame:
    """(by, name_before, name_after): the sums before and after each split; stored."""
    totals = rows.groupBy(*by).agg(*(F.coalesce(F.sum(column.cast("bigint")), F.lit(0).cast("bigint")).alias(name) for name, column in sums.items()))
    after = [F.sum(name).over(Window.partitionBy("file").orderBy(*by[1:])).alias(f"{name}_after") for name in sums]
    return stored(totals.select(*by, *sums, *after).select(*by, *(F.col(f"{name}_after") for name in sums), *((F.col(f"{name}_after") - F.col(name)).alias(f"{name}_before") for name in sums)))


def _joined(rows: DataFrame, of_splits: DataFrame, by: list[str]) -> DataFrame:
    """Rows with what is stored of their split, in their order: up to SPLITS splits are broadcast, with more (small) ones rows are dealt anew and sorted."""
    if of_splits.count() <= SPLITS:
        return rows.join(F.broadcast(of_splits), by)
    return rows.join(of_splits.hint("merge"), by).repartition("file", "split").sortWithinPartitions("file", "split", "place")


def _lifted(local: DataFrame, ends: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """The sums over the rows before in the file."""
    out = _joined(local, ends.select(*by, *(f"{name}_before" for name in names)), by)
    return out.withColumns({name: F.col(name) + F.col(f"{name}_before") for name in names}).drop(*(f"{name}_before" for name in names))


def _count(string: Column, mark: str) -> Column:
    return F.length(string) - F.length(F.replace(string, F.lit(mark), F.lit("")))


def _marked(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """The pieces of GeoJSON files up to each closing brace, with the depth in braces (curly) and brackets (square) before them since their split began, and their steps; stored."""
    rows = _pieces(spark, paths, "}").withColumn("bare", F.regexp_replace("piece", r"(?s)\\.", ""))
    by, sums = ["file", "split"], {"quotes": _count(F.col("bare"), '"'), "bytes": F.octet_length("piece") + 1}
    ends = _ends(rows, sums, by)
    rows = _lifted(_local(rows, sums, by), ends, list(sums), by)
    # the last piece of a file may lack its brace, which shows in the file's size; a byte order mark is not part of the piece
    total = stored(ends.groupBy("file").agg(F.max("bytes_after").alias("total")).join(_files(spark, paths), "file").join(ends.select("file", "split"), "file").select("file", "split", "total", "size"))
    rows = _joined(rows, total, by)
    last = F.col("bytes") + F.octet_length("piece") + 1 == F.col("total")
    ended = ~(last & (F.col("size") - F.col("total")).isin(-1, 2))
    inside = F.col("quotes") % 2 == 1
    outside = F.regexp_replace(F.when(inside, F.concat(F.lit('"'), "bare")).otherwise(F.col("bare")), '"[^"]*+("|$)', "")
    ends_inside = (F.col("quotes") + _count(F.col("bare"), '"')) % 2 == 1
    rows = rows.withColumns({"outside": outside, "ends_inside": ends_inside, "brace": ended & ~ends_inside})
    rows = rows.withColumns({"curly_step": _count(F.col("outside"), "{") - _count(F.col("outside"), "}") - F.col("brace").cast("int"), "square_step": _count(F.col("outside"), "[") - _count(F.col("outside"), "]")})
    rows = rows.select("file", "split", "place", "piece", "ends_inside", "brace", "curly_step", "square_step")
    return stored(_local(rows, {"curly": F.col("curly_step"), "square": F.col("square_step")}, by))


def _depths(marked: DataFrame) -> DataFrame:
    """The stored pieces with the depth in braces (curly) and brackets (square) in their file before and after."""
    by = ["file", "split"]
    rows = _lifted(marked, _ends(marked, {"curly": F.col("curly_step"), "square": F.col("square_step")}, by), ["curly", "square"], by)
    return rows.withColumns({"curly_after": F.col("curly") + F.col("curly_step"), "square_after": F.col("square") + F.col("square_step")})


def _feature_texts(marked: DataFrame) -> DataFrame:
    """file, position and body of each object in an array at the top of a file; a group is one object."""
    closes = F.col("brace") & (F.col("curly_after") == 1) & (F.col("square_after") == 1)
    # a stored file may be read by several tasks: their shares of a split, in its order
    meta = F.col("_metadata")
    share = F.concat_ws("/", meta["file_name"], F.lpad(meta["file_block_start"].cast("string"), 19, "0"))
    by, sums = ["file", "split", "share"], {"position": F.col("closes")}
    rows = _depths(marked.withColumn("share", share)).withColumn("closes", closes).filter("curly_after >= 1 and square_after >= 1")
    rows = _lifted(_local(rows, sums, by), _ends(rows, sums, by), ["position"], by).drop("share")
    follows = (F.col("square") == 1) & F.col("piece").rlike(r"^\s*,?\s*\{")
    first = F.when(follows, F.regexp_replace("piece", r"^[\s,]+", "")).otherwise(F.regexp_extract("piece", r'(?s)"features"\s*:\s*\[\s*(\{.*)', 1))
    rows = rows.withColumn("piece", F.when(F.col("curly") <= 1, first).otherwise(F.col("piece")))
    parts = F.sort_array(F.collect_list(F.struct("split", "place", "piece")))
    made = rows.groupBy("file", "position").agg(parts.alias("parts"), F.max("closes").alias("whole")).filter("whole")
    return made.select("file", "position", F.concat(F.array_join(F.transform("parts", lambda p: p["piece"]), "}"), F.lit("}")).alias("body"))


def _features(marked: DataFrame) -> DataFrame:
    return _feature_texts(marked).select("file", "position", F.from_json("body", FEATURE).alias("f")).filter("f.type = 'Feature'")


def _file_faults(spark: SparkSession, paths: list[str] | str, marked: DataFrame) -> DataFrame:
    """file, fault of every file: null where it can be read and closes what it opens."""
    ends = marked.groupBy("file").agg(F.sum("curly_step").alias("curly"), F.sum("square_step").alias("square"), F.max_by("ends_inside", F.struct("split", "place")).alias("inside"), F.bool_and(F.is_valid_utf8("piece")).alias("readable"))
    open_ = (F.col("curly") != 0) | (F.col("square") != 0) | F.col("inside")
    return _files(spark, paths).join(ends, "file", "left").select("file", F.when(~F.col("readable"), "invalid_utf8").when(open_, "unbalanced").alias("fault"))


def read_geojson(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Feature collections, one file a layer: layer_id (the file), position, external_id, geom_type, geom, source (repaired).

    Files are split over tasks, however their lines are broken; no group is larger than a feature.
    Features come from the array `features` at the top.  Files that can't be read whole give no row;
    these and files without a feature are rows of `geojson_faults`.
    """
    marked = _marked(spark, paths)
    sound = _file_faults(spark, paths, marked).filter("fault is null").select("file")
    f = F.col("f")
    return (
        _features(marked)
        .join(sound, "file", "left_semi")
        .select(
            F.col("file").alias("layer_id"),
            F.col("position").cast("int").alias("position"),
            f["id"].alias("external_id"),
            f["geometry"]["type"].alias("geom_type"),
            geometry.from_geojson(f["geometry"]["type"], f["geometry"]["coordinates"]).alias("geom"),
            text.repair_map(f["properties"]).alias("source"),
        )
    )


def geojson_faults(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(layer_id, fault) of files: invalid_utf8, unbalanced (braces, brackets or quotes left open), else empty (no feature)."""
    marked = _marked(spark, paths)
    counts = _features(marked).groupBy("file").agg(F.count("*").alias("n"))
    rows = _file_faults(spark, paths, marked).join(counts, "file", "left")
    return rows.select(F.col("file").alias("layer_id"), F.coalesce("fault", F.when(F.col("n").isNull(), "empty")).alias("fault")).filter("fault is not null")


def _records(spark: SparkSession, paths: list[str] | str) -> tuple[DataFrame, DataFrame]:
    """Tables' records (table_id, row, record, separator), the header as row 1; and the faults of tables that can't be cut into records."""
    rows = running(_pieces(spark, paths), quotes=_count(F.col("piece"), '"'))
    rows = stored(rows.withColumn("starts", (F.col("quotes") % 2 == 0) & (F.col("piece") != "")))
    order = F.struct("split", "place")
    files = rows.groupBy("file").agg(
        F.min_by("piece", order).alias("header"),
        F.max_by(F.col("quotes") + _count(F.col("piece"), '"'), order).alias("quotes"),
        F.bool_and(F.is_valid_utf8("piece")).alias("readable"),
    )
    files = _files(spark, paths).join(files, "file", "left").withColumn("header", F.regexp_replace("header", "^﻿", "")).withColumn("separator", delimiter(F.col("header")))
    blank = F.coalesce(F.trim("header") == "", F.lit(True))
    fault = F.when(~F.col("readable"), "invalid_utf8").when(blank, "empty_table").when(F.col("separator").isNull(), "no_single_delimiter").when(F.col("quotes") % 2 == 1, "open_quote")
    files = stored(files.select(F.col("file").alias("table_id"), "separator", fault.alias("fault")))
    good = files.filter("fault is null").select(F.col("table_id").alias("file"), "separator")
    numbered = running(rows.filter("starts or quotes % 2 = 1").join(good, "file"), begun=F.col("starts"))
    numbered = numbered.withColumn("row", F.col("begun") + F.col("starts").cast("int"))
    lines = F.sort_array(F.collect_list(F.struct("split", "place", "piece")))
    made = numbered.groupBy("file", "separator", "row").agg(F.array_join(F.transform(lines, lambda p: p["piece"]), "\n").alias("record"))
    made = made.withColumn("record", F.when(F.col("row") == 1, F.regexp_replace("record", "^﻿", "")).otherwise(F.col("record")))
    return made.select(F.col("file").alias("table_id"), "row", "record", "separator"), files.filter("fault is not null").select("table_id", "fault", F.lit(None).cast("string").alias("where"))


def _cells(record: Column, separator: Column) -> Column:
    """The cells of a record; quoted ones may hold separators, line ends and doubled quotes."""
    found = None
    for mark in DELIMITERS:
        pattern = f'(?s){mark}(?:"[^"]*+(?:""[^"]*+)*+"[^{mark}]*+|[^{mark}]*+)'
        here = F.regexp_extract_all(F.concat(F.lit(mark), record), F.lit(pattern), F.lit(0))
        found = F.when(separator == mark, here) if found is None else found.when(separator == mark, here)
    quoted = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)$'

    def plain(cell: Column) -> Column:
        inner = F.substr(cell, F.lit(2))
        return F.when(inner.startswith('"'), F.replace(F.regexp_replace(inner, quoted, "$1$2"), F.lit('""'), F.lit('"'))).otherwise(inner)

    return F.transform(found, plain)


def read_tables(spark: SparkSession, paths: list[str] | str, most_columns: int = 200, most_rows: int | None = 20_000) -> tuple[DataFrame, DataFrame]:
    """Attribute tables, one file each: their rows (table_id, row, attributes) and their faults (table_id, fault, where).

    Each table has the delimiter that its own header shows; UTF-8 with or without a byte order mark;
    quoted cells may span lines, whose ends become one line feed each.  Rows are numbered without blank lines, the header being row 1.
    Faults: invalid_utf8, empty_table, no_single_delimiter, open_quote (an odd number of quotes, of
    which one in the middle of an unquoted cell counts too), and those of `attribute_faults`.  A
    table with any fault gives no rows.
    """
    records, broken = _records(spark, paths)
    lines = stored(records.select("table_id", "row", _cells(F.col("record"), F.col("separator")).alias("cells")))
    faults = stored(broken.unionByName(attribute_faults(lines, most_columns, most_rows)))
    header = lines.filter("row = 1").select("table_id", F.col("cells").alias("header"))
    rows = lines.filter("row > 1").join(header, "table_id").join(faults.select("table_id").distinct(), "table_id", "left_anti")
    return rows.select("table_id", "row", F.map_from_arrays("header", "cells").alias("attributes")), faults
