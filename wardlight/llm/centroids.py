"""k-means over integer vectors in bit planes, exact at every step.

A vector's components become integers, floor(SCALE * x).  Plane i holds bit i of all components, one bit a component in one 64-bit
word, and the last plane is the sign's (two's complement).  The dot product of two vectors is then the sum, over pairs of planes, of the
product of the planes' weights and the count of bits set in both; lengths are dot products, and a squared distance is made of the
three.  No floating-point number is involved.

Planes are made once and kept; a round sends each task the centroids' planes (k rows) and gets back k rows of sums a task, summed up by
Spark before k rows reach the driver.  So nothing grows on the driver, and no group of vectors meets in one task.

Defined cases: vectors of another length, null, or with null or non-finite components are left out, and so are those with a component of
2**26 or more in integers, whose distances would not be safe in 64 bits; a vector without id counts, but is no starting centroid; of equal starting
hashes (a repeated id) the vector that is smaller comes first; equal vectors each give a row; ties of distance go to the smaller number;
with fewer vectors than k there are fewer centroids; an empty table gives an empty table; an inertia that is no 64-bit number is null;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

DIMS, SCALE, LIMIT = 64, 1024, 1 << 26
K, ROUNDS, SEED = 8, 10, 3
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def weights(planes: int) -> np.ndarray:
    return np.array([1 << i for i in range(planes - 1)] + [-(1 << planes - 1)], np.int64)


def to_planes(values: np.ndarray) -> np.ndarray:
    """Rows of 64 integers as rows of planes, as many as the largest needs."""
    widest = max(int(np.where(values < 0, ~values, values).max(initial=0)).bit_length() + 1, 1)
    bits = (values[:, None, :] >> np.arange(widest)[None, :, None] & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8").reshape(len(values), widest)


def from_planes(planes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little")
    return np.einsum("npd,p->nd", bits, weights(planes.shape[1]))


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of all rows of planes x with all rows of planes y, by weighted counts of common bits."""
    out = np.zeros((len(x), len(y)), np.int64)
    for i, v in enumerate(weights(x.shape[1]).tolist()):
        for j, w in enumerate(weights(y.shape[1]).tolist()):
            out += v * w * np.bitwise_count(x[:, i, None] & y[None, :, j]).astype(np.int64)
    return out


def lengths(x: np.ndarray) -> np.ndarray:
    """Dot product of each row with itself."""
    w, out = weights(x.shape[1]).tolist(), np.zeros(len(x), np.int64)
    for i in range(len(w)):
        for j in range(i + 1):
            out += (1 + (i != j)) * w[i] * w[j] * np.bitwise_count(x[:, i] & x[:, j]).astype(np.int64)
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and squared distance, for rows of planes."""
    d = lengths(x)[:, None] + lengths(centroids)[None, :] - 2 * dots(x, centroids)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column("v")), DIMS), False))
        flat = rows.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIMS)  # a null component is not a number
        with np.errstate(invalid="ignore", over="ignore"):
            scaled = np.floor(flat * SCALE)
            good = (np.abs(scaled) < LIMIT).all(axis=1)
        planes = to_planes(scaled[good].astype(np.int64))
        raw = pa.array([p.tobytes() for p in planes], pa.binary())
        yield pa.RecordBatch.from_arrays([rows.column("vec_id").filter(pa.array(good)), raw], names=["vec_id", "planes"])


def _groups(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and planes of the rows of a batch, by number of planes."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for wide in np.unique(size).tolist():
        at = np.flatnonzero(size == wide)
        yield at, np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), "<u8").reshape(len(at), wide // 8)


def _sums(centroids: np.ndarray):
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, far = np.zeros(k, np.int64), np.zeros((k, DIMS), np.int64), [0] * k
        for b in batches:
            for _, x in _groups(b.column("planes")):
                best, d = nearest(x, centroids)
                np.add.at(n, best, 1)
                np.add.at(total, best, from_planes(x))
                for c in np.unique(best).tolist():
                    far[c] += int(d[best == c].sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(n), pa.array(list(total), pa.list_(pa.int64())), pa.array(map(str, far))], names=["cluster", "n", "total", "far"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, d = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for at, x in _groups(b.column("planes")):
                best[at], d[at] = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(best, pa.int32()), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return run


def _round(kept: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int], int]]:
    """Count, sums and inertia by cluster: k rows come to the driver."""
    by_task = kept.mapInArrow(_sums(centroids), "cluster int, n long, total array<long>, far string")
    # sums of components as decimals, so that no count of vectors is too many
    sums = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(DIMS)]
    rows = by_task.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("far").cast("decimal(38,0)")).alias("far"), *sums).collect()
    return {r["cluster"]: (r["n"], [int(r[f"t{i}"]) for i in range(DIMS)], int(r["far"])) for r in rows}


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, squared distance, inertia of the cluster and of all, and the hash of the cluster's centroid, one row a kept vector.

    ``vectors`` has vec_id and embedding.  Centroids start as the k vectors whose ids, behind the seed, have the least hashes; after ``rounds`` rounds of
    assignment and floor means each vector is assigned once more.
    """
    T.bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    kept = T.cut(rows.mapInArrow(_quantise, "vec_id long, planes binary"))
    first = kept.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    # the k smallest hashes; among rows of one hash, which share an id, vectors are compared by their own order
    near = first.orderBy("h", "planes").limit(k).collect()
    starts = sorted((r["h"], from_planes(np.frombuffer(r["planes"], "<u8")[None, :])[0].tolist()) for r in near)
    if not starts:
        return kept.sparkSession.createDataFrame([], OUT)
    centroids = np.array([v for _, v in starts], np.int64)
    for _ in range(rounds):
        found = _round(kept, to_planes(centroids))
        after = np.array([[t // found[c][0] for t in found[c][1]] if c in found and found[c][0] else old for c, old in enumerate(centroids.tolist())], np.int64)
        if (after == centroids).all():  # all further rounds are like this one
            break
        centroids = after
    final = to_planes(centroids)
    found = _round(kept, final)
    total = sum(f for _, _, f in found.values())
    fits = lambda x: x if x < 1 << 63 else None
    table = [(c, fits(found[c][2]), fits(total), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist()) if c in found]
    about = kept.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    assigned = kept.mapInArrow(_assign(final), "vec_id long, cluster int, distance long")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
