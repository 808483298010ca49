"""Exact top-k inner products by a Voronoi kNN join.

Components become integers.  Pivots split the vectors into Voronoi cells; a cell's
summary is its number of vectors and its largest distance from the pivot.

For a query q and a vector x of the cell of pivot p, q.x lies within |q| |x - p| of
q.p.  The lower ends over all cells, taken from the highest down until they stand for k
other vectors, bound the query's k-th score from below.  Each query first meets its own
cell, and its k-th score there is a second such bound.  A cell whose upper end is below
both cannot matter to the query; only to the others the query is replicated.

A cell meets its queries in blocks of about ``BLOCK`` vectors and lanes of about
``LANE`` queries, so a cell of a third of all vectors is never gathered.  A query
travels once per block, a vector once per lane; in a task a block's vectors come
first, its queries are streamed past them, and each keeps at most k vectors that reach
its bound.  The k best of all these are the result.  Bounds are rounded outwards,
scores are integers.

Rules for unusual rows: vectors that are null, hold null or non-finite components, or
differ in length from the most common length take no part; a null id is neither query
nor candidate; rows that repeat an id are candidates each, but not to a query of that
id; fewer than k candidates give them all; an empty table gives an empty result;
floor(scale * x) is held to 64 bits and scores beyond 64 bits wrap; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.sources.sinks import materialize

PIVOTS = 48
#: Vectors of a cell, and queries to it, that meet in one task.
BLOCK = 1 << 15
LANE = 1 << 15
#: Queries scored at once.
QUERIES_AT_ONCE = 128
NO_FLOOR = -(1 << 63)


def quantized(vectors: DataFrame, scale: int, key: str, vector: str) -> DataFrame:
    """``id, v``: floor(scale * x) of every usable vector, as an array of whole numbers."""
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    usable = (
        F.col(key).isNotNull()
        & F.col(vector).isNotNull()
        & (F.size(vector) > 0)
        & F.forall(
            doubles,
            lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
        )
    )
    whole = F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    rows = vectors.where(usable).select(F.col(key).cast("long").alias("id"), whole.alias("v"))
    usual = (
        rows.groupBy(F.size("v").alias("n"))
        .agg(F.count(F.lit(1)).alias("count"), F.min(F.array_min("v")), F.max(F.array_max("v")))
        .orderBy(F.desc("count"), "n")
        .first()
    )
    n, _, least, most = usual or (0, 0, 0, 0)
    kind = "array<int>" if -(1 << 31) < least <= most < 1 << 31 else "array<bigint>"
    return rows.where(F.size("v") == n).withColumn("v", F.col("v").cast(kind))


def choose_pivots(rows: DataFrame, n: int) -> np.ndarray:
    """``n`` vectors with the smallest digests, equal ones once: a bounded sample."""
    found = rows.select("v").orderBy(F.xxhash64(F.lit(61), "id"), "id").limit(4 * n).collect()
    distinct = list(dict.fromkeys(tuple(r["v"]) for r in found))[:n]
    return np.array(distinct, np.float64)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def with_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``cell``, the nearest pivot, and ``radius``, the distance from it."""
    kind = rows.schema["v"].dataType.simpleString()
    norms = (pivots**2).sum(axis=1)

    def assign(batches):
        for batch in batches:
            x = matrix(batch.column(1)) if len(batch) else np.zeros((0, pivots.shape[1]))
            far = (x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + norms
            cell = far.argmin(axis=1)
            radius = np.sqrt(np.maximum(far[np.arange(len(x)), cell], 0))
            yield pa.record_batch(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(radius)],
                names=["id", "v", "cell", "radius"],
            )

    return rows.mapInArrow(assign, f"id long, v {kind}, cell int, radius double")


def bounds(
    q: np.ndarray, least: np.ndarray, summary: tuple[np.ndarray, ...], pivots: np.ndarray, k: int
) -> np.ndarray:
    """Which cells each query needs: a matrix of queries by cells.

    ``least`` is what each query's k-th score reaches at least.
    """
    cell, count, radius = summary
    middle = q @ pivots[cell].T
    spread = np.sqrt((q**2).sum(axis=1))[:, None] * radius
    slack = 1e-6 * (1 + np.abs(middle) + spread)
    low, high = middle - spread - slack, middle + spread + slack
    order = np.argsort(-low, axis=1)
    standing = np.cumsum(count[order], axis=1)
    # one vector may be the query itself
    at = np.argmax(standing >= k + 1, axis=1)
    enough = standing[:, -1] >= k + 1
    floor = np.take_along_axis(low, np.take_along_axis(order, at[:, None], 1), 1)[:, 0]
    return high >= np.maximum(np.where(enough, floor, -np.inf), least)[:, None]


def needed(queries: DataFrame, summary, pivots: np.ndarray, k: int) -> DataFrame:
    """``id, v, floor, cells``: the cells each query needs beside its own."""
    kind = queries.schema["v"].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            if not len(batch):
                continue
            keys, v, floor, own = (batch.column(c) for c in ("id", "v", "floor", "cell"))
            least = np.asarray(floor.fill_null(NO_FLOOR)).astype(np.float64)
            far = bounds(matrix(v), least, summary, pivots, k)
            far &= summary[0][None, :] != np.asarray(own)[:, None]
            row, at = np.nonzero(far)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(batch)))])
            cells = pa.ListArray.from_arrays(
                pa.array(offsets.astype(np.int32)), pa.array(summary[0][at].astype(np.int32))
            )
            yield pa.record_batch([keys, v, floor, cells], names=["id", "v", "floor", "cells"])

    return queries.mapInArrow(scan, f"id long, v {kind}, floor long, cells array<int>")


def best_of_block(q, qi, floors, x, xi, k: int) -> pa.RecordBatch:
    """``query_id, vec_id, score``: up to ``k`` of the block for each query; ``xi`` ascends."""
    # doubles are exact while scores stay below 2**53
    big = np.abs(q).max(initial=0) * float(np.abs(x).max(initial=0)) * q.shape[1] >= 2**53
    scores = (q.astype(np.int64) @ x.astype(np.int64).T) if big else q.astype(np.float64) @ x.T
    reach = scores >= floors[:, None]
    out = [[], [], []]
    for j in range(len(qi)):
        s = scores[j]
        open_ = np.flatnonzero(reach[j])
        open_ = open_[xi[open_] != qi[j]]
        if len(open_) > k:  # ties go to the smaller id
            edge = np.partition(s[open_], len(open_) - k)[len(open_) - k]
            above = open_[s[open_] > edge]
            open_ = np.concatenate([above, open_[s[open_] == edge][: k - len(above)]])
        out[0].append(np.full(len(open_), qi[j]))
        out[1].append(xi[open_])
        out[2].append(s[open_].astype(np.int64))
    return pa.record_batch(
        [pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["query_id", "vec_id", "score"]
    )


def solve(asked: DataFrame, data: DataFrame, dims: int, k: int) -> DataFrame:
    """``query_id, vec_id, score``: for each query the best of every block of its ``cells``.

    ``asked``: ``id, v, floor, cells``; ``data``: ``id, v, cell, row``.
    """
    spread = asked.select("id", "v", "floor", F.explode("cells").alias("cell"))
    parts = data.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    lanes = spread.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / LANE).cast("int").alias("lanes"))
    plan = F.broadcast(parts.join(lanes, "cell"))  # one row per pivot
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    vectors = data.join(plan, "cell").select(
        "cell", F.pmod(F.xxhash64(F.lit(63), "row"), F.col("parts")).cast("int").alias("part"),
        every("lanes").alias("lane"), F.lit(0).alias("kind"), "id", F.lit(None).cast("long").alias("floor"), "v",
    )
    queries = spread.join(plan, "cell").select(
        "cell", every("parts").alias("part"),
        F.pmod(F.xxhash64(F.lit(67), "id"), F.col("lanes")).cast("int").alias("lane"),
        F.lit(1).alias("kind"), "id", "floor", "v",
    )
    place = ["cell", "part", "lane"]
    stream = vectors.unionByName(queries).repartition(*place).sortWithinPartitions(*place, "kind")

    def scan(batches):
        key, held, x, xi = None, [], None, None
        for batch in batches:
            if not len(batch):
                continue
            *where, kind, ids = (np.asarray(batch.column(i)) for i in range(5))
            floors = np.asarray(batch.column(5).fill_null(NO_FLOOR))
            v = np.asarray(batch.column(6).flatten()).reshape(-1, dims)
            edges = np.flatnonzero(np.any([np.diff(c) != 0 for c in (*where, kind)], axis=0)) + 1
            for low, high in zip([0, *edges], [*edges, len(ids)]):
                here = tuple(int(c[low]) for c in where)
                if here != key:
                    key, held, x = here, [], None
                if kind[low] == 0:
                    held.append((ids[low:high], v[low:high]))
                    continue
                if not held:  # a block to which no vector fell
                    continue
                if x is None:
                    xi, x = (np.concatenate(c) for c in zip(*held))
                    order = np.argsort(xi, kind="stable")
                    xi, x = xi[order], x[order]
                    big = np.abs(x).max(initial=0) >= 2**31
                    x = x if big else x.astype(np.float64)
                for a in range(low, high, QUERIES_AT_ONCE):
                    b = min(a + QUERIES_AT_ONCE, high)
                    yield best_of_block(v[a:b], ids[a:b], floors[a:b], x, xi, k)

    return stream.mapInArrow(scan, "query_id long, vec_id long, score long")


def top_k(
    vectors: DataFrame,
    k: int = 20,
    query_every: int = 20,
    scale: int = 64,
    pivots: int = PIVOTS,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: queries are the vectors whose id ``query_every`` divides."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    rows = materialize(quantized(vectors, scale, key, vector), "whole-vectors")
    centres = choose_pivots(rows, pivots)
    if not len(centres):
        return spark.createDataFrame([], result)
    dims = centres.shape[1]
    # numbered rows: those that repeat an id are cut into blocks as well
    celled = materialize(
        with_cells(rows, centres).withColumn("row", F.monotonically_increasing_id()), "celled-vectors"
    )
    found = celled.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("radius").alias("r")
    ).collect()  # at most one row per pivot
    summary = tuple(np.array([r[c] for r in found]) for c in ("cell", "n", "r"))
    data = celled.select("id", "v", "cell", "row")
    queries = celled.where(F.pmod("id", F.lit(query_every)) == 0).select("id", "v", "cell")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    own = queries.select("id", "v", F.lit(None).cast("long").alias("floor"), F.array("cell").alias("cells"))
    near = materialize(ranked(solve(own, data, dims, k)), "near-vectors")
    reached = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    far = materialize(
        needed(queries.join(reached, "id", "left"), summary, centres, k), "far-cells"
    )
    both = near.drop("rank").unionByName(solve(far, data, dims, k))
    return ranked(both).select("query_id", "rank", "vec_id", "score")
