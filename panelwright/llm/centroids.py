"""Clustering around centroids in whole numbers, with a fast screening that can't change a result.

The nearest centroid is looked for by one matrix product of 32-bit floats. Its rounding error is bounded, so each
distance is an interval; a centroid whose interval begins above the lowest end of all is out. Where more than one is
left, their distances are computed again in 64-bit integers, and the smallest number of the nearest ones wins. Tasks
sum up the vectors of each centroid, Spark adds the sums, and the driver only sees as many numbers as the centroids have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import table
from panelwright.llm.vectors import scaled, usable

DIMS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SEED = 2
#: Relative rounding error of a 32-bit and of a 64-bit float.
UNIT32 = 2.0**-24
UNIT64 = 2.0**-53


def limit(dims: int) -> int:
    """Components beyond this stay at it, so that a squared distance is below 2**62."""
    return 1 << ((62 - max(dims - 1, 0).bit_length()) // 2 - 1)


def intervals(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances of whole-numbered rows to whole-numbered centroids.

    A product of d terms, each factor rounded once to 32 bits and summed in any order, is off by at most
    ((1 + u)**(d + 2) - 1) |x||c| < (d + 3) u |x||c| for (d + 2) u < 0.01. What is done in 64 bits is off by (d + 6) units of its terms at most.
    """
    dims = x.shape[1]
    inner = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    xx, cc = (x * x).sum(1)[:, None], (centroids * centroids).sum(1)[None, :]
    near = xx + cc - 2 * inner
    slack = 2 * (dims + 3) * UNIT32 * 1.01 * np.sqrt(xx) * np.sqrt(cc) + 4 * (dims + 6) * UNIT64 * (xx + cc)
    return near - slack, near + slack


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row and the exact squared distance."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = intervals(x, centroids)
    row, number = np.nonzero(low <= high.min(1)[:, None])
    exact = ((x[row].astype(np.int64) - centroids[number].astype(np.int64)) ** 2).sum(1)
    order = np.lexsort((number, exact, row))
    first = order[np.concatenate(([True], np.diff(row[order]) != 0))]
    return number[first], exact[first]


def starting_centroids(kept: DataFrame, count: int, seed: int, dims: int, scale: float) -> np.ndarray:
    """The vectors of the smallest hashes, in the order of these; rows without an id come last, equal hashes by vector."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select("vec", hashed.alias("h")).orderBy(F.col("h").asc_nulls_last(), "vec").limit(count).collect()
    return scaled(pa.array([r.vec for r in first], pa.list_(pa.float64())), dims, scale, limit(dims)) if first else np.zeros((0, dims))


def _sums(dims: int, scale: float, centroids: np.ndarray, distances: bool):
    """A pass that sends, per centroid of a task, its number of vectors and the sums of their components or of the distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(centroids), np.int64)
        sums = np.zeros((len(centroids), 1 if distances else dims), object)
        for batch in batches:
            x = scaled(batch.column(0), dims, scale, limit(dims))
            cluster, distance = nearest(x, centroids)
            counts += np.bincount(cluster, minlength=len(centroids))
            values = distance[:, None] if distances else x.astype(np.int64)
            order = np.argsort(cluster, kind="stable")
            found, start = np.unique(cluster[order], return_index=True)
            # in halves of 32 bits, as a sum of distances may be beyond 64
            for half, weight in ((values >> 32, 1 << 32), (values & 0xFFFFFFFF, 1)):
                if len(found):
                    sums[found] += np.add.reduceat(half[order], start).astype(object) * weight
        for cluster in np.flatnonzero(counts).tolist():
            total = [int(counts[cluster]), *map(int, sums[cluster])]
            yield pa.record_batch(
                [pa.array([cluster] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()), pa.array(list(map(Decimal, total)), pa.decimal128(38, 0))],
                ["cluster", "place", "v"],
            )

    return run


def _added(kept: DataFrame, run) -> dict[int, dict[int, int]]:
    parts = kept.select("vec").mapInArrow(run, "cluster int, place int, v decimal(38,0)")
    found: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "place").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r.cluster, {})[r.place] = int(r.v)
    return found


def clusters(
    vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, seed: int = SEED,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """Per vector: ``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Kept are vectors of exactly ``dims`` components, none null or non-finite, which become floor(scale * x); beyond
    2**27 (of 64 components) they stay there, so that a squared distance is a long. Sums of distances beyond a long stay at the largest one.
    The first centroids are the vectors of the smallest sha256 of ``seed:id``; rows without an id come last among
    them, and rows of equal ids in the order of their vectors. With fewer vectors than ``count`` each is a centroid. Equal centroids
    are possible: ties go to the smaller number, and an empty one stays where it is. Every row has its own result,
    repeated and null ids included; an empty table gives an empty result. Other columns don't matter.

    ``vectors`` is read ``rounds`` + 3 times: hand in a stored table.
    """
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec")).where(usable(F.col("vec")) & (F.size(F.col("vec")) == dims))
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    at = starting_centroids(kept, count, seed, dims, scale)
    if not len(at):
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        for cluster, total in _added(kept, _sums(dims, scale, at, False)).items():
            at[cluster] = [total[i + 1] // total[0] for i in range(dims)]
    most = (1 << 63) - 1
    inertia = {c: total[1] for c, total in _added(kept, _sums(dims, scale, at, True)).items()}
    each = F.array(*[F.lit(min(inertia.get(c, 0), most)).cast("long") for c in range(len(at))])
    digests = F.array(*[F.lit(hashlib.sha256(",".join(map(str, map(int, c))).encode()).hexdigest()) for c in at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(scaled(batch.column(1), dims, scale, limit(dims)), at)
            yield pa.record_batch([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(run, f"vec_id {kind}, cluster int, distance long").select(
        "vec_id", "cluster", "distance", F.get(each, F.col("cluster")).alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), most)).cast("long").alias("inertia"), F.get(digests, F.col("cluster")).alias("centroid_sha256"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))
