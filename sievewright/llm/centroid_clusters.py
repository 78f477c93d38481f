"""Centroid clustering: every vector keeps its exact integer dot products with the centroids.

Components become integers (`whole`), so that sums, means and distances are exact and the same on any cluster. A round adds
to the stored dot products only what the changed components of the centroids bring, and takes the nearest centroid anew from
``|v|^2 - 2 v.c + |c|^2``; a centroid that did not move costs nothing. A round's table is written to the shared folder and
the one before it goes. The driver holds the centroids alone: ``centroids`` x ``SIDE`` integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, folder, stored

SIDE, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Integers of components end here: no distance between two vectors leaves 64 bits.
LARGEST = 1 << 27


def finite(vector: Column) -> Column:
    """Whether no component is null, NaN or infinite; false for a null vector."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def whole(vector: Column, scale: int, largest: int) -> Column:
    """floor(scale * x) of each component, held within ``largest`` on both sides."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(float(-largest)), F.least(F.lit(float(largest)), x.cast("double") * scale))).cast("int"))


def _updated(change: np.ndarray, centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Dot products after the centroids' change, and the nearest centroid; of equally near ones the first."""
    moved = [(k, at, change[k, at]) for k in range(len(change)) if len(at := np.flatnonzero(change[k]))]
    size = (centres * centres).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v, norm, dots = batch.columns[:4]
            matrix = v.flatten().to_numpy().astype(np.int64).reshape(len(ids), SIDE)
            products = dots.flatten().to_numpy().reshape(len(ids), len(centres)).copy()
            for k, at, by in moved:
                products[:, k] += matrix[:, at] @ by
            distance = norm.to_numpy()[:, None] - 2 * products + size
            nearest = distance.argmin(1)
            each = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * len(centres))
            yield pa.record_batch([ids, v, norm, pa.ListArray.from_arrays(each, pa.array(products.ravel())), pa.array(nearest.astype(np.int32)), pa.array(distance[np.arange(len(ids)), nearest])], ["vec_id", "v", "norm", "dots", "cluster", "distance"])

    return run


def _sums(centroids: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's number of vectors and sums of components (the last place) by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((centroids, SIDE + 1), np.int64)
        for batch in batches:
            cluster, matrix = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, SIDE)
            for k in np.unique(cluster):
                own = matrix[cluster == k]
                sums[k] += np.append(own.sum(0), len(own))
        held = np.flatnonzero(sums[:, SIDE])
        place = np.tile(np.arange(SIDE + 1, dtype=np.int32), len(held))
        yield pa.record_batch([pa.array(np.repeat(held.astype(np.int32), SIDE + 1)), pa.array(place), pa.array(sums[held].ravel())], ["cluster", "place", "total"])

    return run


def cluster_vectors(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """vectors (vec_id, embedding) to (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    Vectors of another length than ``SIDE`` and those with a null, NaN or infinite component have no row. The first centroids
    are the vectors with the least hash of ``seed:vec_id``; a null vec_id is never one, but has its row. With fewer vectors
    there are fewer centroids; without any the result is empty. Repeated rows are vectors of their own; ties go to the
    smaller number; a centroid without vectors stays. Components beyond ``LARGEST`` / ``SCALE`` (two million) count as that, and
    sums over 64 bits are told as the largest long. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.where((F.size("embedding") == SIDE) & finite(F.col("embedding"))).select("vec_id", whole(F.col("embedding"), SCALE, LARGEST).alias("v"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = [r.v for r in rows.where("vec_id is not null").orderBy(order, "v").limit(centroids).collect()]
    if not first:
        return rows.select("vec_id", *(F.lit(None).cast(kind).alias(c) for c, kind in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")))).where("false")
    target = np.array(first, np.int64)
    centres = np.zeros_like(target)
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    state, held, path = rows.select("vec_id", "v", square.alias("norm"), F.array_repeat(F.lit(0).cast("long"), len(first)).alias("dots")), None, None
    kind = rows.schema["vec_id"].dataType.simpleString()
    for k in range(rounds + 1):
        change, centres = target - centres, target.copy()
        if path and not change.any():  # nothing moved: no later round would differ
            break
        path = folder(spark, "clusters")
        state = stored(state.select("vec_id", "v", "norm", "dots").mapInArrow(_updated(change, centres), f"vec_id {kind}, v array<int>, norm long, dots array<long>, cluster int, distance long"), "round", path)
        if held:
            discard(spark, held)
        held = path
        if k < rounds:
            totals = {(r.cluster, r.place): r.total for r in state.select("cluster", "v").mapInArrow(_sums(len(first)), "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect()}
            for c in {c for c, _ in totals}:
                target[c] = np.array([totals[c, j] for j in range(SIDE)], np.int64) // totals[c, SIDE]
    spread = {r.cluster: int(r.inertia) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia")).collect()}
    top = (1 << 63) - 1
    told = [(c, min(i, top), min(sum(spread.values()), top), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for c, i in spread.items()]
    of_cluster = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
