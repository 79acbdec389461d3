"""Centroid clustering of integer vectors with a pivot table (LAESA).

Each kept vector's exact squared distances to a few fixed pivots are stored once.  In every round the differences between
these distances and the pivots' distances to a centroid bound the vector's distance to the centroid from below; only
centroids whose bound doesn't exceed the best distance so far get an exact integer distance.

Defined cases: a vector counts if it has exactly ``size`` components, none null or non-finite.  Components of 2 ** 21 or
more in size are beyond exact 64-bit distances; such vectors aren't kept.  A null vec_id is clustered like any other and
taken as a first centroid last.  Repeated rows stay rows.  Ties go to the smaller centroid number.  With fewer vectors than
``k`` there are fewer centroids; an empty table gives no rows.  Sums beyond a long are null.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.store import save

SIZE, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Pivots, and vectors among which they are chosen (far from each other).  The choice changes no result.
PIVOTS, CANDIDATES = 8, 256
#: Components of this size and more are not kept: squared distances of smaller ones fit a long.
LIMIT = 2.0**21
#: Relative room for the rounding of square roots.
_ROOM = 2.0**-49


def _integers(size: int):
    """Rows with ``size`` finite components, as floor(SCALE * component)."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.equal(pc.fill_null(pc.list_value_length(batch.column("embedding")), -1), size))
            lists = batch.column("embedding")
            parts = lists.flatten().cast(pa.float64())
            x = parts.to_numpy(zero_copy_only=False).reshape(-1, size)  # nulls become NaN
            ok = (np.abs(np.where(np.isfinite(x), x, np.inf)) < LIMIT).all(1)
            v = np.floor(SCALE * x[ok]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(ok)), _lists(v)], ["vec_id", "v"])

    return run


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.array(rows.ravel()))


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def squares(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows to one point."""
    d = rows - point
    return np.einsum("ij,ij->i", d, d)


def farthest(rows: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows, each with the largest sum of distances to those before; the first row begins."""
    chosen, total = [0], np.zeros(len(rows))
    while len(chosen) < min(count, len(rows)):
        total += np.sqrt(squares(rows, rows[chosen[-1]]).astype(np.float64))
        total[chosen] = -1
        chosen.append(int(np.argmax(total)))
    return rows[chosen]


def _measure(pivots: np.ndarray):
    def run(batches):
        for batch in batches:
            v = _matrix(batch, "v", pivots.shape[1])
            p = np.stack([squares(v, x) for x in pivots], 1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), _lists(p)], ["vec_id", "v", "pivot_squares"])

    return run


def nearest(v: np.ndarray, pivot_squares: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, exact squared distance) of each row, and how many exact distances it took."""
    near = np.sqrt(pivot_squares.astype(np.float64))
    low = np.zeros((len(v), len(centroids)))
    for k, c in enumerate(centroids):
        far = np.sqrt(squares(pivots, c).astype(np.float64))
        gap = np.abs(near - far) - (near + far) * _ROOM
        low[:, k] = np.maximum(gap.max(1), 0) ** 2 * (1 - _ROOM)
    cluster = low.argmin(1)
    first = v - centroids[cluster]
    distance = np.einsum("ij,ij->i", first, first)
    seen, exact = cluster.copy(), len(v)
    for k, c in enumerate(centroids):
        rows = np.flatnonzero((low[:, k] <= distance) & (seen != k))
        exact += len(rows)
        d = squares(v[rows], c)
        better = (d < distance[rows]) | (d == distance[rows]) & (k < cluster[rows])
        cluster[rows[better]], distance[rows[better]] = k, d[better]
    return cluster, distance, exact


def _sums(centroids: np.ndarray, pivots: np.ndarray):
    """Per task: members, exact distances taken and component sums of each cluster."""

    def run(batches):
        size = centroids.shape[1]
        n, exact, total = np.zeros(len(centroids), np.int64), 0, np.zeros(centroids.shape, np.int64)
        for batch in batches:
            v = _matrix(batch, "v", size)
            cluster, _, taken = nearest(v, _matrix(batch, "pivot_squares", len(pivots)), centroids, pivots)
            exact += taken
            for k in np.unique(cluster):
                own = v[cluster == k]
                n[k] += len(own)
                total[k] += own.sum(0)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(n[held]), _lists(total[held])], ["cluster", "n", "total"])

    return run


def _assign(centroids: np.ndarray, pivots: np.ndarray):
    def run(batches):
        for batch in batches:
            cluster, distance, _ = nearest(
                _matrix(batch, "v", centroids.shape[1]), _matrix(batch, "pivot_squares", len(pivots)), centroids, pivots)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


_RESULT = "vec_id long, cluster int, distance long"


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each kept row of ``vectors`` (vec_id, embedding), and the final centroids.

    Centroids begin as the ``k`` kept vectors with the smallest SHA-256 of ``1:<vec_id>`` (ties: by id, then components).
    Only component sums per centroid and the pivot candidates reach the driver.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_integers(size), "vec_id long, v array<int>")
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    heads = kept.orderBy(order.asc_nulls_last(), "vec_id", "v").limit(max(k, CANDIDATES)).collect()
    if not heads:
        return spark.createDataFrame([], _RESULT), np.zeros((0, size), np.int64)
    heads = np.array([r.v for r in heads], np.int64)
    centroids, pivots = heads[:k], farthest(heads, PIVOTS)
    measured = save(kept.mapInArrow(_measure(pivots), "vec_id long, v array<int>, pivot_squares array<long>"), "pivots")
    for _ in range(rounds):
        sums = measured.mapInArrow(_sums(centroids, pivots), "cluster int, n long, total array<long>")
        found = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(size)]).alias("total")).collect()
        centroids = centroids.copy()
        for r in found:
            centroids[r.cluster] = [x // r.n for x in r.total]
    return measured.mapInArrow(_assign(centroids, pivots), _RESULT), centroids


def cluster_report(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE) -> DataFrame:
    """``cluster`` with each cluster's and the whole inertia and a digest of the final centroid."""
    found, centroids = cluster(vectors, k, rounds, size)
    found = save(found, "clusters")
    long = F.sum(F.col("distance").cast("decimal(38,0)"))
    own = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(long).collect()}
    fits = lambda x: x if x < 2**63 else None
    rows = [(c, fits(own[c]), fits(sum(own.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in own]
    facts = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
