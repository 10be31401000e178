"""Uploaded files cut into records by many tasks, against Python's own readers."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from parcelwise.sources import layers, uploads


@pytest.fixture(params=["100", "134217728"])
def split(spark, request):
    """Splits of a few bytes, so that borders fall into texts and brackets, and whole files."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def feature(k, kind="Point", coordinates=(1.0, 2.0), **properties):
    return {"type": "Feature", "id": f"f{k}", "geometry": {"type": kind, "coordinates": coordinates}, "properties": properties}


HARD = [
    feature(0, a='quoted " and } and {', b="back\\slash\\"),
    feature(1, nested={"x": {"y": [{"z": 1}, {"z": 2}]}}, features=[{"type": "Feature"}]),
    feature(2, text='"features": [{', lines="one\ntwo"),
    feature(3, "Polygon", [[[0, 0], [1, 0], [1, 1], [0, 0]]]),
]


def test_features_over_splits(spark, tmp_path, split):
    crs = {"type": "name", "properties": {"name": "x"}}
    folder = tmp_path / "g"
    folder.mkdir()
    root = {"type": "FeatureCollection", "crs": crs, "links": [{"href": "}"}], "features": HARD, "after": [{"b": []}]}
    (folder / "one_line.geojson").write_text(json.dumps(root))
    (folder / "indented.geojson").write_text(json.dumps(root, indent=2) + "\n\n")
    (folder / "mark.geojson").write_text("﻿" + json.dumps({"features": HARD[:2], "type": "FeatureCollection"}), encoding="utf-8")
    rows = uploads.read_geojson(spark, str(folder)).withColumn("file", F.regexp_extract("layer_id", "([^/]+)$", 1)).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r["file"], r["position"])):
        found.setdefault(r["file"], []).append(r)
    assert {f: [r["external_id"] for r in rs] for f, rs in found.items()} == {"one_line.geojson": ["f0", "f1", "f2", "f3"], "indented.geojson": ["f0", "f1", "f2", "f3"], "mark.geojson": ["f0", "f1"]}
    for name in ("one_line.geojson", "indented.geojson"):
        assert found[name][0]["source"]["a"] == HARD[0]["properties"]["a"] and found[name][0]["source"]["b"] == "back\\slash\\"
        assert found[name][2]["source"]["text"] == '"features": [{' and found[name][3]["geom_type"] == "Polygon"
    assert not uploads.geojson_faults(spark, str(folder)).count()


def test_geojson_faults(spark, tmp_path, split):
    whole = json.dumps({"type": "FeatureCollection", "features": HARD})
    cases = {"good": whole, "newline": whole + "\n", "cut": whole[:-1], "cut_more": whole[: len(whole) // 2], "cut_brace": whole[: whole.index("}}") + 1], "empty": '{"type":"FeatureCollection","features":[]}', "other": '{"type":"Feature"}', "nothing": "\n"}
    for name, content in cases.items():
        (tmp_path / f"{name}.geojson").write_text(content)
    (tmp_path / "bytes.geojson").write_bytes(whole.encode().replace(b"one", b"\xff\xfe"))
    found = {r["layer_id"].rsplit("/", 1)[1].split(".")[0]: r["fault"] for r in uploads.geojson_faults(spark, str(tmp_path)).collect()}
    assert found == {"cut": "unbalanced", "cut_more": "unbalanced", "cut_brace": "unbalanced", "empty": "empty", "other": "empty", "nothing": "empty", "bytes": "invalid_utf8"}


def test_layer_without_features(spark):
    features = spark.createDataFrame([(1, "lotes", "Polygon")], "layer_id int, layer_type string, geom_type string")
    every = spark.createDataFrame([(1, "lotes"), (2, "lotes")], "layer_id int, layer_type string")
    assert [(r["layer_id"], r["fault"]) for r in layers.contract_faults(features, every).collect()] == [(2, "empty")]


TABLES = {
    "comma": 'a,b,c\n1,"x, y",z\n\n2,"line one\nline two","say ""hi"""\n,,\n',
    "semicolon": "﻿Name;Área\r\nL-1;3,5\r\nL-2;\r\n",
    "tab": 'k\tv\n1\t"tab\there"\n2\t""\n',
    "quoted_header": '"a b";c\n"1";2\n',
}
BAD = {
    "ragged": ("a;b\n1;2\n\n3\n4;5;6\n", {("ragged_row", "3"), ("ragged_row", "4")}),
    "twice": ("a;a;b\n1;2;3\n", {("duplicate_column", "a")}),
    "tie": ("a;b,c\n1;2\n", {("no_single_delimiter", None)}),
    "single": ("a\n1\n", {("no_single_delimiter", None)}),
    "open": ('a;b\n"1;2\n', {("open_quote", None)}),
    "blank": ("\na;b\n", {("empty_table", None)}),
    "nothing": (" \n", {("empty_table", None)}),
    "long": ("a;b\n" + "1;2\n" * 30, {("too_many_rows", "30")}),
    "wide": (";".join(f"c{i}" for i in range(9)) + "\n", {("too_many_columns", "9")}),
}


def test_tables_over_splits(spark, tmp_path, split):
    for name, content in TABLES.items():
        (tmp_path / f"{name}.csv").write_bytes(content.encode())
    for name, (content, _) in BAD.items():
        (tmp_path / f"{name}.csv").write_bytes(content.encode())
    (tmp_path / "bytes.csv").write_bytes(b"a;b\n\xff;1\n")
    rows, faults = uploads.read_tables(spark, str(tmp_path), most_columns=8, most_rows=20)
    name = lambda r: r["table_id"].rsplit("/", 1)[1].split(".")[0]
    found: dict = {}
    for r in sorted(rows.collect(), key=lambda r: (name(r), r["row"])):
        found.setdefault(name(r), []).append((r["row"], r["attributes"]))
    expected = {}
    for key, content in TABLES.items():
        mark = {"comma": ",", "tab": "\t"}.get(key, ";")
        table = [row for row in csv.reader(io.StringIO(content.removeprefix("﻿"), newline=""), delimiter=mark) if row]
        expected[key] = [(k, dict(zip(table[0], row, strict=True))) for k, row in enumerate(table[1:], 2)]
    assert found == expected
    seen: dict = {}
    for r in faults.collect():
        seen.setdefault(name(r), set()).add((r["fault"], r["where"]))
    assert seen == {k: f for k, (_, f) in BAD.items()} | {"bytes": {("invalid_utf8", None)}}


def test_pieces_are_not_shuffled(spark, tmp_path, split):
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": HARD}))
    marked = uploads._marked(spark, str(tmp_path))
    depths = uploads._depths(marked)
    assert "Exchange" not in depths._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    assert depths.filter("curly_after = 0 and square_after = 0").count() == 1


def test_more_splits_than_are_broadcast(spark, tmp_path, split, monkeypatch):
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": HARD}))
    (tmp_path / "b.geojson").write_text(json.dumps({"features": HARD[:3]}, indent=1))
    monkeypatch.setattr(uploads, "SPLITS", 0)
    rows = uploads.read_geojson(spark, str(tmp_path)).collect()
    found = sorted((r["layer_id"][-9], r["position"], r["external_id"]) for r in rows)
    assert found == [("a", k, f"f{k}") for k in range(4)] + [("b", k, f"f{k}") for k in range(3)]
