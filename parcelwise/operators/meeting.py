"""Which features come near each other: joins of boxes, each at the size of its own cells.

Space is cut into cells at every power of two.  A box lies in the cells of the
level that is just as large as itself, at most four.  Two boxes meet at the
level of the larger one, so a box also takes the cells of the larger levels that
the other side has; a pair is made in the first cell that both share.  The
candidates then are a few times the pairs, whatever the sizes and densities: a
region full of small boxes has small cells, and a large box beside it costs the
small ones one row each.

What travels with a box is a run of up to RUN edges of the feature, so that a
pair of runs can be tested where it is made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import geometry

#: Edges in a run, and the longest side of an edge's piece: longer edges are boxed piece by piece.
RUN, PIECE = 16, 64.0
SNAP = 1e-6
#: The least level of segments.
FLOOR = 2
BOX = ("bx0", "by0", "bx1", "by1")


def level_of(extent: Column) -> Column:
    """The level whose cells are just as large: 0 for 1 and less."""
    return F.ceil(F.log2(F.greatest(extent, F.lit(1.0)))).cast("int")


def leveled(boxes: DataFrame, reach: float = 0.0) -> DataFrame:
    """Boxes widened by `reach` and a hair, so that boxes that touch share a cell, with their level."""
    by = reach + SNAP
    wide = boxes.withColumns({c: F.col(c) + (by if c.endswith("1") else -by) for c in BOX})
    return wide.withColumn("level", level_of(F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0"))))


def levels(*sides: DataFrame) -> list[list[int]]:
    """The levels that each side has: some tens at most, whatever the rows."""
    rows = reduce(DataFrame.union, (s.select(F.lit(k).alias("side"), "level").distinct() for k, s in enumerate(sides))).filter("level is not null").collect()
    return [sorted(r["level"] for r in rows if r["side"] == k) for k in range(len(sides))]


def _placed(boxes: DataFrame, keys: list[str], prefix: str, above: list[int], first: bool) -> DataFrame:
    """Rows of a side for each of its cells: (keys, at, cx, cy, turn), its columns behind `prefix`.

    `turn` parts the join in two: the first side's own cells with all of the second's, and the first
    side's higher cells with the second's own.
    """
    kept = [F.col(c).alias(f"{prefix}_{c}") for c in boxes.columns if c not in keys]
    rows = boxes.select(*keys, *kept)
    own, x0, y0, x1, y1 = (F.col(f"{prefix}_{c}") for c in ("level", *BOX))
    higher = F.filter(F.array(*map(F.lit, above)).cast("array<int>"), lambda m: m > own)
    turns = lambda at, mine: F.struct(at.alias("at"), F.lit(mine).alias("turn"))
    # of the second side only what is larger than some box of the first waits for those at its own size
    lower = F.when(own > min(above, default=0), F.array(turns(own, 1))).otherwise(F.array().cast("array<struct<at:int,turn:int>>"))
    places = F.concat(F.array(turns(own, 0)), F.transform(higher, lambda m: turns(m, 1))) if first else F.concat(F.array(turns(own, 0)), lower, F.transform(higher, lambda m: turns(m, 0)))
    rows = rows.withColumn("p", F.explode(places)).withColumns({"at": F.col("p.at"), "turn": F.col("p.turn")}).drop("p")
    size = F.pow(F.lit(2.0), F.col("at"))
    return rows.withColumn("cx", F.explode(F.sequence(F.floor(x0 / size), F.floor(x1 / size)))).withColumn("cy", F.explode(F.sequence(F.floor(y0 / size), F.floor(y1 / size))))


def pairs(a: DataFrame, b: DataFrame, keys: list[str], known: list[list[int]] | None = None) -> DataFrame:
    """Pairs of leveled boxes of one group that meet, each once: a_* and b_* columns of the two sides.

    `known`: the levels that either side has; without them they are looked up, which reads both sides once more.
    """
    of_a, of_b = known or levels(a, b)
    one, two = _placed(a, keys, "a", of_b, True), _placed(b, keys, "b", of_a, False)
    size = F.pow(F.lit(2.0), F.col("at"))
    met, first = F.lit(True), F.lit(True)
    for c in ("x", "y"):
        met = met & (F.col(f"a_b{c}0") <= F.col(f"b_b{c}1")) & (F.col(f"b_b{c}0") <= F.col(f"a_b{c}1"))
        first = first & (F.col(f"c{c}") == F.floor(F.greatest(f"a_b{c}0", f"b_b{c}0") / size))
    # what each box is exploded to is not in Spark's guess of a side's size: no side is broadcast
    return one.join(two.hint("merge"), [*keys, "at", "turn", "cx", "cy"]).filter(met & first).drop("at", "turn", "cx", "cy", "a_level", "b_level")


def _long(e: Column) -> Column:
    return F.greatest(F.abs(e["x2"] - e["x1"]), F.abs(e["y2"] - e["y1"])) > PIECE


def _pieces(e: Column) -> Column:
    """An edge as edges of at most PIECE per axis; all but the first have seq -1."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / PIECE).cast("int"))
    at = lambda k, c, d: F.when(k == n, e[f"{c}2"]).otherwise(e[f"{c}1"] + d * (k / n))
    piece = lambda k: F.struct(e["part"].alias("part"), e["ring"].alias("ring"), F.when(k == 0, e["seq"]).otherwise(-1).alias("seq"), at(k, "x", dx).alias("x1"), at(k, "y", dy).alias("y1"), at(k + 1, "x", dx).alias("x2"), at(k + 1, "y", dy).alias("y2"))
    return F.transform(F.sequence(F.lit(0), n - 1), piece)


def runs(features: DataFrame, keys: list[str], reach: float = 0.0, also: list[str] | None = None) -> DataFrame:
    """Features as runs of edges: keys, feature_id, edges, whole (the run has all edges), box and level; edges without length are left out."""
    edges = F.filter(geometry.edges(F.col("geom")), lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))
    return edge_runs(features.select(*keys, "feature_id", *(also or []), edges.alias("edges")), keys, reach, also)


def edge_runs(rows: DataFrame, keys: list[str], reach: float = 0.0, also: list[str] | None = None) -> DataFrame:
    """The same of rows that have their edges (part, ring, seq, x1, y1, x2, y2) already."""
    pieces = F.when(F.exists("edges", _long), F.flatten(F.transform("edges", _pieces))).otherwise(F.col("edges"))
    # inline: a generator is not merged with what follows, so that each array is worked out once
    rows = rows.select(*keys, "feature_id", *(also or []), F.inline(F.array(F.struct(pieces.alias("pieces")))))
    starts = F.when(F.size("pieces") > 0, F.sequence(F.lit(1), F.size("pieces"), F.lit(RUN))).otherwise(F.array().cast("array<int>"))
    cut = rows.withColumn("start", F.explode(starts)).withColumn("whole", F.size("pieces") <= RUN)
    cut = cut.select(*keys, "feature_id", *(also or []), "whole", F.inline(F.array(F.struct(F.slice("pieces", F.col("start"), RUN).alias("edges")))))
    ends = {c: (F.greatest, F.array_max) if c.endswith("1") else (F.least, F.array_min) for c in BOX}
    around = F.struct(*(least(most(f"edges.{c[1]}1"), most(f"edges.{c[1]}2")).alias(c) for c, (least, most) in ends.items()))
    return leveled(cut.select("*", F.inline(F.array(around))), reach)


def bundles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their edges (sid, x1, y1, x2, y2) as bundles: keys, feature_id, edges, box and level.

    A bundle is a run of up to RUN edges, or one long edge, which comes once for each of its pieces in the piece's box.
    """
    short, long_ = F.filter("edges", lambda e: ~_long(e)), F.filter("edges", _long)
    starts = F.when(F.size(short) > 0, F.sequence(F.lit(1), F.size(short), F.lit(RUN))).otherwise(F.array().cast("array<int>"))
    runs_ = F.transform(starts, lambda k: F.struct(F.slice(short, k, RUN).alias("edges"), F.slice(short, k, RUN).alias("boxed")))
    whole = lambda e: F.struct(F.lit(0).alias("part"), F.lit(0).alias("ring"), F.lit(0).alias("seq"), *(e[c].alias(c) for c in ("x1", "y1", "x2", "y2")))
    piece = lambda e: F.transform(_pieces(whole(e)), lambda p: F.struct(F.array(e).alias("edges"), F.array(F.struct(e["sid"].alias("sid"), *(p[c].alias(c) for c in ("x1", "y1", "x2", "y2")))).alias("boxed")))
    found = F.when(F.exists("edges", _long), F.concat(runs_, F.flatten(F.transform(long_, piece)))).otherwise(runs_)
    cut = rows.select(*keys, "feature_id", F.inline(found))
    ends = {c: (F.greatest, F.array_max) if c.endswith("1") else (F.least, F.array_min) for c in BOX}
    around = F.struct(*(least(most(f"boxed.{c[1]}1"), most(f"boxed.{c[1]}2")).alias(c) for c, (least, most) in ends.items()))
    flat = leveled(cut.select(*keys, "feature_id", "edges", F.inline(F.array(around))))
    return flat.withColumn("level", F.greatest("level", F.lit(FLOOR)))


def boxes(features: DataFrame, keys: list[str], reach: float = 0.0) -> DataFrame:
    """One leveled box for each feature with points: keys, feature_id, box and level."""
    # inline: a generator is not merged with what follows, so that the box is worked out once
    found = features.select(*keys, "feature_id", F.inline(F.array(geometry.bounds(F.col("geom"))))).filter("x0 is not null")
    return leveled(found.withColumnsRenamed({c[1:]: c for c in BOX}), reach)


def segment_pairs(rows: DataFrame, other: DataFrame, keys: list[str], id_: str, reach: float = 0.0) -> DataFrame:
    """Pairs of segments (keys, `id_`, feature_id, x1, y1, x2, y2) whose boxes come within `reach`: a_* and b_* columns.

    A pair comes once; one of long segments once for each pair of their pieces that meet.  The levels
    are looked up first, which reads both sides once more: a segment takes rows only for sizes that there are.
    """
    whole = F.struct(*(F.lit(0).alias(c) for c in ("part", "ring", "seq")), *("x1", "y1", "x2", "y2"))
    sides = []
    for side, by in ((rows, reach), (other, 0.0)):
        pieces = side.select(*keys, id_, "feature_id", "x1", "y1", "x2", "y2", F.explode(F.when(_long(whole), _pieces(whole)).otherwise(F.array(whole))).alias("e"))
        box = {c: (F.greatest if c.endswith("1") else F.least)(f"e.{c[1]}1", f"e.{c[1]}2").alias(c) for c in BOX}
        flat = pieces.select(*keys, id_, "feature_id", "x1", "y1", "x2", "y2", *box.values())
        sides.append(leveled(flat, by).withColumn("level", F.greatest("level", F.lit(FLOOR))))
    return pairs(*sides, keys).drop(*(f"{p}_{c}" for p in "ab" for c in BOX))
