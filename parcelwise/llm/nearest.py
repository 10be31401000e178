"""Approximate nearest neighbours: stable projections, kd-trees and a chi-square stop.

Vectors are projected to a few dimensions by 2-stable (Gaussian) directions, so
that the squared projected distance of a pair at distance d is d² times a
chi-square variable.  Projected space is cut into cells by a kd-tree that is fit
on a bounded sample; every row goes into a cell, and each cell into blocks of
bounded size.  In a block the points come in the order of their projected
distance from the query: a kd-tree opens its leaves by the distance of their
boxes, and a point's turn is when no unopened leaf can hold a nearer one.  Each
point is verified by its true distance, until with the kth distance found so far
the chi-square test says that a nearer neighbour is unlikely to be left.

The search has two rounds.  A query first looks into the blocks of its own cell;
with the kth distance found there, the same test names the other cells that may
still hold a neighbour, and it visits only those.

Equal vectors: of each input batch, the k + 1 smallest ids of a vector are kept
(no other can be among k neighbours), so a vector that fills a third of the
table costs k + 1 rows a batch.

Defined results: a vector that is null, of no dimension, zero, or with a null or
non-finite component, or without an id, takes no part, nor does one of another dimension than the
table's most common; fewer candidates than k give fewer rows; ties go to the
smaller vec_id; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelwise.llm import ragged
from parcelwise.session import stored

#: Rows of the sample on which the cells are fit.
SAMPLE_ROWS = 20_000
#: Rows of a block: one task's kd-tree.
BLOCK_ROWS = 8192
LEAF_ROWS = 32
#: Queries that meet a block at once.
QUERY_ROWS = 2048


def directions(dim: int, low: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, low))


def chi_square_cdf(x: np.ndarray, k: int) -> np.ndarray:
    """The chi-square distribution with an even number k of degrees of freedom."""
    half = np.minimum(np.asarray(x, float) / 2, 700.0)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, k // 2):
        term = term * half / i
        total += term
    return 1 - np.exp(-half) * total


def chi_square_bound(p: float, k: int) -> float:
    """Where the chi-square distribution reaches p."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, k) < p else (low, mid)
    return high


@dataclass
class Tree:
    """A kd-tree over low-dimensional points: its leaves' rows and boxes."""

    order: np.ndarray
    begin: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, leaf_rows: int) -> Tree:
        """Halves the widest dimension at the median until a leaf is small."""
        order, todo, leaves = np.arange(len(points)), [(0, len(points))], []
        while todo:
            a, b = todo.pop()
            rows = order[a:b]
            if b - a <= leaf_rows:
                leaves.append((a, b, points[rows].min(axis=0), points[rows].max(axis=0)))
                continue
            axis = int(np.argmax(np.ptp(points[rows], axis=0)))
            half = (b - a) // 2
            order[a:b] = rows[np.argpartition(points[rows, axis], half, kind="introselect")]
            todo += [(a + half, b), (a, a + half)]
        leaves.sort(key=lambda x: x[0])
        return cls(order, np.array([x[0] for x in leaves] + [len(points)]), np.array([x[2] for x in leaves]), np.array([x[3] for x in leaves]))

    def distances(self, point: np.ndarray) -> np.ndarray:
        """The squared projected distance of each leaf's box."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0.0)
        return (gap * gap).sum(axis=1)


@dataclass(frozen=True)
class Cells:
    """The upper kd-tree: planes, and the box of each cell (open at the sides)."""

    matrix: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, matrix: np.ndarray, n_cells: int) -> Cells:
        points = sample @ matrix
        dims = matrix.shape[1]
        boxes = [(np.arange(len(points)), np.full(dims, -np.inf), np.full(dims, np.inf))]
        while len(boxes) < n_cells:
            k = max(range(len(boxes)), key=lambda i: len(boxes[i][0]))
            rows, low, high = boxes.pop(k)
            axis = int(np.argmax(np.ptp(points[rows], axis=0))) if len(rows) else 0
            cut = float(np.median(points[rows, axis])) if len(rows) else 0.0
            left = points[rows, axis] < cut
            if not left.any() or left.all():
                boxes.append((rows, low, high))
                break
            up, down = high.copy(), low.copy()
            up[axis], down[axis] = cut, cut
            boxes += [(rows[left], low, up), (rows[~left], down, high)]
        return cls(matrix, np.array([b[1] for b in boxes]), np.array([b[2] for b in boxes]))

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point from each cell's box; the own cell is at 0 (its first, on a border)."""
        out = np.empty((len(points), len(self.low)))
        for k in range(len(self.low)):
            gap = np.maximum(np.maximum(self.low[k] - points, points - self.high[k]), 0.0)
            out[:, k] = (gap * gap).sum(axis=1)
        return out

    def home(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        for k in range(len(self.low)):
            out[((points >= self.low[k]) & (points < self.high[k])).all(axis=1)] = k
        return out


def _clean(batches: Iterator[pa.RecordBatch], dim: int, k: int, every: int) -> Iterator[pa.RecordBatch]:
    """Valid vectors as doubles in bytes; of equal ones in a batch, the k + 1 smallest ids and all query ids."""
    for batch in batches:
        column = batch.column("embedding")
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ids = batch.column("vec_id")
        batch_ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        good = (sizes == dim) & ~ids.is_null().to_numpy(zero_copy_only=False)
        kept = column.filter(pa.array(good))
        values = np.ascontiguousarray(kept.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)).reshape(-1, dim)
        batch_ids = batch_ids[good]
        fine = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
        values, batch_ids = values[fine], batch_ids[fine]
        if not len(values):
            continue
        order = np.argsort(batch_ids, kind="stable")
        values, batch_ids = np.ascontiguousarray(values[order] + 0.0), batch_ids[order]
        _, which = ragged.distinct(values.view(np.uint8).ravel(), np.arange(len(values)) * dim * 8, np.full(len(values), dim * 8))
        by = np.argsort(which, kind="stable")
        head = np.concatenate([[True], which[by][1:] != which[by][:-1]])
        begin = np.flatnonzero(head)
        nth = np.arange(len(by)) - np.repeat(begin, np.diff(np.append(begin, len(by))))
        first = by[nth <= k]
        candidate = np.zeros(len(values), bool)
        candidate[first] = True
        query = batch_ids % every == 0
        rows = np.flatnonzero(candidate | query)
        raw = ragged.binaries(values[rows].ravel(), np.arange(len(rows) + 1) * dim * 8)
        yield pa.RecordBatch.from_arrays([pa.array(batch_ids[rows]), raw, pa.array(candidate[rows]), pa.array(query[rows])], names=["vec_id", "vector", "candidate", "query"])


def _matrix(raw: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), float).reshape(-1, dim)


def _assign(frames: Iterator[pd.DataFrame], cells: Cells) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.assign(cell=cells.home(_matrix(frame["vector"], len(cells.matrix)) @ cells.matrix))


FOUND = "query_id bigint, vec_id bigint, distance double, verified bigint"
#: Points that are verified between two tests.
STEP = 32


def _search(frame: pd.DataFrame, cells: Cells, k: int, bound: float) -> pd.DataFrame:
    """The k nearest of each query in one block; `reach` is the kth squared distance known before, if any.

    `verified` is the number of points whose true distance was taken, on a query's first row.
    """
    dim = len(cells.matrix)
    is_query = frame["reach"].notna().to_numpy()
    queries, rows = frame[is_query], frame[~is_query]
    out: list[tuple[np.ndarray, ...]] = []
    if len(queries) and len(rows):
        vectors, ids = _matrix(rows["vector"], dim), rows["vec_id"].to_numpy()
        points = vectors @ cells.matrix
        tree = Tree.build(points, LEAF_ROWS)
        vectors, points, ids = vectors[tree.order], points[tree.order], ids[tree.order]
        for query, reach, raw in zip(queries["vec_id"], queries["reach"], queries["vector"], strict=True):
            target = np.frombuffer(raw, float)
            near_ids, near, n = _nearest(target, target @ cells.matrix, query, reach, vectors, points, ids, tree, k, bound)
            out.append((np.full(len(near), query), near_ids, near, np.where(np.arange(len(near)) == 0, n, 0)))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "distance", "verified"), columns, strict=True)))


def _nearest(target: np.ndarray, low: np.ndarray, query: int, reach: float, vectors: np.ndarray, points: np.ndarray, ids: np.ndarray, tree: Tree, k: int, bound: float) -> tuple[np.ndarray, np.ndarray, int]:
    """One query's incremental search: (ids, squared distances, points verified)."""
    far = tree.distances(low)
    # projections of equal vectors may differ in the last bits: such are never too far
    slack = 1e-24 * float(low @ low)
    leaves = np.argsort(far, kind="stable")
    far = np.append(far[leaves], np.inf)
    near_ids, near, verified, opened = np.zeros(0, np.int64), np.zeros(0), 0, 0
    waiting, gaps = np.zeros(0, np.int64), np.zeros(0)
    while True:
        # a projected point beyond `edge` may come after one of a leaf that is still closed
        more = leaves[opened : opened + 8][far[opened : opened + 8][: len(leaves) - opened] <= bound * reach + slack]
        opened += len(more)
        edge = far[opened] if len(more) else np.inf
        fresh = np.concatenate([np.arange(tree.begin[x], tree.begin[x + 1]) for x in more]) if len(more) else np.zeros(0, np.int64)
        fresh = fresh[ids[fresh] != query]
        gap = points[fresh] - low
        waiting, gaps = np.concatenate([waiting, fresh]), np.concatenate([gaps, (gap * gap).sum(axis=1)])
        order = np.argsort(gaps, kind="stable")
        waiting, gaps = waiting[order], gaps[order]
        turn = int(np.searchsorted(gaps, edge, "right"))
        at = 0
        while at < turn and gaps[at] <= bound * reach + slack:
            stop = min(at + STEP, int(np.searchsorted(gaps[:turn], bound * reach + slack, "right")))
            gap = vectors[waiting[at:stop]] - target
            near, near_ids = np.concatenate([near, (gap * gap).sum(axis=1)]), np.concatenate([near_ids, ids[waiting[at:stop]]])
            best = np.lexsort((near_ids, near))[:k]
            near, near_ids = near[best], near_ids[best]
            verified += stop - at
            at = stop
            if len(near) == k:
                reach = min(reach, near[-1])
        if not len(more) or at < turn:
            return near_ids, near, verified
        waiting, gaps = waiting[at:], gaps[at:]


def _visits(frames: Iterator[pd.DataFrame], cells: Cells, bound: float) -> Iterator[pd.DataFrame]:
    """For each query, the cells that may hold a nearer neighbour than the kth found at home."""
    for frame in frames:
        vectors = _matrix(frame["vector"], len(cells.matrix))
        far = cells.distances(vectors @ cells.matrix)
        reach = frame["reach"].to_numpy()
        q, c = np.nonzero((far <= bound * reach[:, None]) & (np.arange(far.shape[1]) != frame["cell"].to_numpy()[:, None]))
        yield pd.DataFrame({"vec_id": frame["vec_id"].to_numpy()[q], "vector": frame["vector"].to_numpy()[q], "cell": c, "reach": reach[q]})


def top(found: DataFrame, k: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", order).filter(F.col("rank") <= k)


def neighbours(vectors: DataFrame, k: int = 10, every: int = 100, low: int = 32, certainty: float = 0.92, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`vec_id`, `embedding` -> query_id, rank, vec_id, score, verified: the k nearest found of each row whose id is divisible by `every`.

    `low` (even) projected dimensions; a search stops once a nearer neighbour
    would, with probability `certainty`, have shown up in projected space by then.
    `verified` is the number of vectors whose distance from the query was taken.
    """
    spark = vectors.sparkSession
    columns = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    dims = columns.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, verified bigint")
    dim = dims[0]["dim"]
    clean = stored(columns.mapInArrow(partial(_clean, dim=dim, k=k, every=every), "vec_id bigint, vector binary, candidate boolean, query boolean"))
    total = clean.count()
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector").toPandas()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, verified bigint")
    cells = Cells.fit(_matrix(sample["vector"], dim), directions(dim, low), max(1, min(len(sample) // 16, round(total / block_rows))))
    placed = stored(clean.mapInPandas(partial(_assign, cells=cells), "vec_id bigint, vector binary, candidate boolean, query boolean, cell bigint"))
    # blocks of a cell, so that a cell with many rows is many tasks
    n_blocks = placed.filter("candidate").groupBy("cell").agg(F.ceil(F.count("*") / (2 * block_rows)).cast("int").alias("n_blocks"))
    rows = placed.filter("candidate").join(F.broadcast(n_blocks), "cell").select("vec_id", "vector", "cell", F.pmod(F.xxhash64("vec_id"), F.col("n_blocks")).cast("int").alias("block"), F.lit(None).cast("double").alias("reach"))
    bound = chi_square_bound(certainty, low)

    def search(asked: DataFrame) -> DataFrame:
        # slices of a cell's queries, so that a block meets a bounded number of them at once
        n_slices = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("n_slices"))
        sliced = F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1)).alias("slice")
        given = rows.join(F.broadcast(n_slices), "cell").select("vec_id", "vector", "cell", "block", sliced, "reach")
        own = F.pmod(F.xxhash64("vec_id", F.lit("slice")), F.col("n_slices")).cast("int").alias("slice")
        each = asked.join(F.broadcast(n_blocks), "cell").join(F.broadcast(n_slices), "cell").select("vec_id", "vector", "cell", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), own, "reach")
        return given.unionByName(each).groupBy("cell", "block", "slice").applyInPandas(lambda frame: _search(frame, cells, k, bound), FOUND)

    queries = placed.filter("query").select("vec_id", "vector", "cell")
    home = stored(search(queries.withColumn("reach", F.lit(float("inf")))))
    reach = top(home, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("reach"))
    asked = queries.join(reach.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    more = stored(asked.mapInPandas(partial(_visits, cells=cells, bound=bound), "vec_id bigint, vector binary, cell bigint, reach double"))
    both = stored(home.unionByName(search(more)))
    effort = both.groupBy("query_id").agg(F.sum("verified").alias("verified"))
    found = top(both.drop("verified"), k).join(effort, "query_id")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.sqrt("distance").alias("score"), "verified")
