"""What must not grow with the tables: plans, the driver's share, and rows for sizes that no box has."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parcelwise.functions import geometry
from parcelwise.operators import blocks, meeting, overlay, pairwise, roads
from parcelwise.sources import layers

KEYS = ["project_id"]


def boxes(spark, n=8):
    rows = spark.range(n).select(F.floor(F.col("id") / 1000).alias("project_id"), F.col("id").alias("feature_id"), (F.col("id") * 10).alias("x"))
    return rows.select(*KEYS, "feature_id", geometry.box(F.col("x"), F.lit(0), F.col("x") + 10, F.lit(10)).alias("geom"))


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_exploded_side_goes_through_the_driver(spark):
    features = boxes(spark)
    edges = overlay.segments(features, KEYS).withColumn("sid", F.struct("feature_id", "seq"))
    points = features.select(*KEYS, F.col("feature_id").alias("point_id"), (F.col("feature_id") * 10.0 + 5).alias("x"), F.lit(5.0).alias("y"))
    pairs = overlay.neighbours(edges, edges, KEYS, "sid")
    inside = overlay.containing(points, edges, KEYS)
    assert inside.count() == 8
    for frame in (pairs, inside, overlay.union_edges(features, KEYS).join(features, KEYS)):
        assert "Broadcast" not in plan(frame)


def test_a_segment_takes_rows_only_for_sizes_that_there_are(spark):
    edges = overlay.segments(boxes(spark), KEYS)
    # all boxes are of one size: none waits at a larger one, nor for a smaller one
    side = meeting.leveled(edges.select(*KEYS, "feature_id", *(F.col(c).alias(b) for b, c in zip(meeting.BOX, ("x1", "y1", "x1", "y1"), strict=True))))
    assert side.select("level").distinct().count() == 1
    level = side.first()["level"]
    own = meeting._placed(side, KEYS, "b", [level], False)
    assert [r["turn"] for r in own.select("turn").distinct().collect()] == [0]
    lower = meeting._placed(side, KEYS, "b", [level - 1, level], False)
    assert sorted(r["turn"] for r in lower.select("turn").distinct().collect()) == [0, 1]


def test_a_network_is_stored_once(spark):
    line = geometry.line(geometry.point(F.col("k") * 10, F.lit(-5)), geometry.point(F.col("k") * 10, F.lit(5)))
    across = geometry.line(geometry.point(F.lit(-5), F.lit(0)), geometry.point(F.lit(25), F.lit(0)))
    lines = spark.range(3).withColumnRenamed("id", "k").select(F.lit(1).cast("bigint").alias("project_id"), F.concat(F.lit("N"), "k").alias("feature_id"), F.lit("existente").alias("road_status"), line.alias("geom"))
    lines = lines.union(spark.range(1).select(F.lit(1).cast("bigint"), F.lit("E"), F.lit("existente"), across))
    edges = roads.network(lines)
    assert edges.count() == 10
    assert "Exchange" not in plan(edges)


def test_faulty_keys_are_counted_at_once(spark):
    sides = [[(1, "a"), (1, "a"), (1, "b"), (1, " "), (1, None), (None, "a")], [(1, "a"), (1, "c"), (1, "c"), (None, "a")]]
    left, right = (spark.createDataFrame(rows, "layer_id bigint, key string") for rows in sides)
    faults = layers.join_faults(left, right)
    assert plan(faults).count("Exchange") == 1 and "Join" not in plan(faults)
    assert sorted(map(tuple, faults.collect()), key=str) == sorted(
        [
            (1, "a", "geometry", "duplicate_key"),
            (1, "b", "geometry", "unmatched_key"),
            (1, " ", "geometry", "empty_key"),
            (1, None, "geometry", "empty_key"),
            (1, "c", "attribute", "duplicate_key"),
            (1, "c", "attribute", "unmatched_key"),
            (None, "a", "geometry", "unmatched_key"),
            (None, "a", "attribute", "unmatched_key"),
        ],
        key=str,
    )


def test_pairs_of_edges_are_no_rows(spark):
    features = boxes(spark)
    found = overlay.related(features, features, KEYS, "dwithin", 5.0)
    joined = plan(found)[plan(found).index("MapInArrow") :]
    assert "Generate" not in joined[: joined.index("SortMergeJoin")]
    assert found.count() == 8


def test_distances_of_pairs_are_those_of_the_columns(spark):
    draw = np.random.default_rng(1)
    values = draw.integers(0, 6, (400, 8)).astype(float)
    values = values[(values[:, 0] != values[:, 2]) & (values[:, 4] != values[:, 6])]
    names = [f"{p}_{c}" for p in "ab" for c in ("x1", "y1", "x2", "y2")]
    rows = spark.createDataFrame(values.tolist(), names)
    there = [r[0] for r in rows.select(overlay.segment_distance2(overlay.side("a"), overlay.side("b"))).collect()]
    a, b = ({c: values[:, k + j] for j, c in enumerate(("x1", "y1", "x2", "y2"))} for k in (0, 4))
    assert there == pairwise.distance2(a, b).tolist()


def test_products_come_in_chunks(monkeypatch):
    monkeypatch.setattr(pairwise, "CHUNK", 7)
    a, b = np.array([0, 0, 2, 2, 2, 5]), np.array([0, 1, 2, 2, 5, 5, 5])
    found = [(r, i, j) for part in pairwise.product(a, b, 7) for r, i, j in zip(*part, strict=True)]
    assert found == [(a[i], i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]]


def test_runs_of_a_sliced_batch_keep_their_rows():
    edge = {"part": 0, "ring": 0, "seq": 0, "x1": 1.0, "y1": 0.0, "x2": None, "y2": 1.0}
    kind = pa.struct([(c, pa.int32()) for c in ("part", "ring", "seq")] + [(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")])
    column = pa.array([[edge] * n for n in (3, 1, 2)], pa.list_(kind)).slice(1)
    runs = pairwise.Edges(column)
    assert runs.row.tolist() == [0, 1, 1] and np.isnan(runs.fields["x2"]).all()


def test_edges_of_a_union_meet_by_bundles(spark):
    # a square of 10 m and one of 1,000 m beside it: the short edges are one bundle, a long one comes once for each piece
    rows = spark.createDataFrame([(0, 1, 0.0, 10.0), (0, 2, 10.0, 1010.0)], "project_id bigint, feature_id bigint, x0 double, x1 double")
    squares = rows.select(*KEYS, "feature_id", geometry.box(F.col("x0"), F.lit(0), F.col("x1"), F.col("x1") - F.col("x0")).alias("geom"))
    outlines = overlay._outlines(squares, KEYS)
    bundles = meeting.bundles(outlines.select(*KEYS, "feature_id", "edges"), KEYS)
    sizes = sorted((r["feature_id"], r["n"], r["count"]) for r in bundles.groupBy("feature_id", F.size("edges").alias("n")).count().collect())
    assert sizes == [(1, 4, 1), (2, 1, 64)]
    whole = overlay.union_measures(overlay.union_edges(squares, KEYS), KEYS).first()
    assert round(whole["area"], 6) == 1_000_100 and round(whole["length"], 6) == 4020


def test_inner_cuts_are_those_of_the_columns(spark):
    draw = np.random.default_rng(2)
    values = draw.integers(0, 5, (400, 8)).astype(float)
    values = values[((values[:, 0] != values[:, 2]) | (values[:, 1] != values[:, 3])) & ((values[:, 4] != values[:, 6]) | (values[:, 5] != values[:, 7]))]
    names = [f"{p}_{c}" for p in "ab" for c in ("x1", "y1", "x2", "y2")]
    rows = spark.createDataFrame([(k, *v) for k, v in enumerate(values.tolist())], ["k", *names])
    there = rows.select("k", F.explode(overlay.inner_cuts(overlay.side("a"), overlay.side("b"))).alias("t")).collect()
    a, b = ({c: values[:, k + j] for j, c in enumerate(("x1", "y1", "x2", "y2"))} for k in (0, 4))
    with np.errstate(all="ignore"):
        index, place = pairwise.inner_cuts(a, b)
    assert len(there) > 50 and sorted(zip(index.tolist(), place.tolist(), strict=True)) == sorted(map(tuple, there))


def test_rectangles_of_many_blocks_are_measured_at_once(monkeypatch):
    draw = np.random.default_rng(2)
    group = np.repeat(np.arange(300), draw.integers(1, 14, 300))
    x, y = draw.integers(0, 6, (2, len(group))).astype(float)
    x[group % 3 == 0] *= 0.1
    alone = []
    one = blocks.hull
    monkeypatch.setattr(blocks, "hull", lambda points: alone.append(1) or one(points))
    cx, cy, count = blocks.hulls(x, y, group, 300)
    assert len(alone) < 20  # each block went through Python by itself before
    sides = blocks.smallest_rectangles(cx, cy, count)
    for g, corners in enumerate(np.split(np.stack([cx, cy], axis=1), np.cumsum(count)[:-1])):
        own = np.stack([x, y], axis=1)[group == g]
        assert [tuple(p) for p in corners.tolist()] == one([tuple(p) for p in own.tolist()])
        turns = [np.array([[c, s], [-s, c]]) for (dx, dy) in np.roll(corners, -1, axis=0) - corners if (size := np.hypot(dx, dy)) > 0 for c, s in [(dx / size, dy / size)]]
        least = min((np.prod(np.ptp(own @ t.T, axis=0)) for t in turns), default=0)
        assert abs(sides[g, 0] * sides[g, 1] - least) < 1e-9 and sides[g, 0] >= sides[g, 1] >= 0


def test_lots_go_to_their_hulls_unexploded(spark):
    lots = boxes(spark, 24).withColumns({"macroarea": F.lit("lote"), "quadra_id": F.floor(F.col("feature_id") / 2).cast("string")})
    found = blocks.block_rectangles(lots)
    assert "Generate" not in plan(found)
    assert {(r["long_side"], r["short_side"], r["orientation"]) for r in found.collect()} == {(20.0, 10.0, 90.0)}
    assert found.count() == 12
