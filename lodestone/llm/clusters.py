"""Centroids of vectors by exact rounds of Lloyd's method on integers.

Method: float32 screening with rigorous rounding-error intervals. A batch's vectors and all centroids are multiplied as float32
matrices. The product of two vectors of n components is off by no more than g = (n + 2)u / (1 - (n + 2)u) times the product of their lengths, with u = 2**-24, in whatever
order it is summed (the two are for the rounding of the components), so |c|^2 - 2vc lies in an interval that is known. A centroid whose interval begins above
the least end of all is farther than another; where one alone is left, it is the nearest, and where intervals overlap, those
centroids are compared by exact integers, the lower number first. Components of 2**40 and more, which float32 products may not hold,
are compared by exact integers alone.

Rounds read a written table of the kept vectors; a task adds up its vectors by cluster, Spark adds up the tasks' sums, and what comes to the driver
is a few rows a component of each centroid. Sums are exact: integers of 64 bits where they fit, else Python's, sent as limbs of 40 bits.

Cases: vectors with another number of components, or with a null or non-finite one, are left out. A null vec_id is hashed as an empty text. Vectors that
share the hash are ordered by components. Rows that share a vec_id are vectors each. Fewer vectors than centroids: as many centroids as vectors. No vectors: no rows. Distances and inertias beyond
64 bits are given as 2**63 - 1. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import written

#: Unit roundoff of float32.
U = 2.0**-24
#: Components below this are screened in float32, and below EXACT their distances are exact in 64 bits (64 components, differences below 2**28).
SCREENED, EXACT = 2.0**40, 2.0**27
#: Bits and number of limbs of a sum.
LIMB, LIMBS = 40, 6
MOST = (1 << 63) - 1
Centroids = list[list[int]]


def integer_vectors(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component x as a double, which holds it exactly, of the vectors that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column("e")), size))
            ids = batch.column("vec_id")
            x = batch.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)  # a null is NaN
            fine = np.isfinite(x).all(1)
            v = np.floor(x[fine] * scale)
            if len(v):
                at = pa.array(np.arange(len(v) + 1, dtype=np.int32) * size)
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(fine)), pa.ListArray.from_arrays(at, pa.array((v + 0.0).ravel()))], ["vec_id", "v"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).mapInArrow(run, "vec_id long, v array<double>")


def _ints(v: np.ndarray) -> np.ndarray:
    """Doubles that hold integers as int64 where squares of their differences fit, else as Python's integers."""
    return v.astype(np.int64) if np.abs(v).max(initial=0) < EXACT else np.array([[int(x) for x in row] for row in v], object).reshape(v.shape)


def exact_distances(v: np.ndarray, centroids: Centroids) -> np.ndarray:
    """Squared distances of each vector to its own centroid (as many of both)."""
    own = _ints(v)
    c = np.array(centroids, object).reshape(v.shape) if own.dtype == object or max((abs(x) for row in centroids for x in row), default=0) >= EXACT else np.array(centroids, np.int64).reshape(v.shape)
    return ((own - c) ** 2).sum(1)


class Screen:
    """The centroids of a round, ready to be compared with batches."""

    def __init__(self, centroids: Centroids):
        self.centroids = centroids
        self.c = np.array([[float(x) for x in row] for row in centroids])
        self.fits = bool(np.abs(self.c).max() < SCREENED)
        self.c32 = self.c.astype(np.float32).T.copy()
        self.squares = np.array([float(sum(x * x for x in row)) for row in centroids])  # rounded once
        self.lengths = np.sqrt(self.squares)
        n = self.c.shape[1] + 2
        self.gamma = n * U / (1 - n * U)

    def candidates(self, v: np.ndarray) -> np.ndarray:
        """Which centroids can be nearest to each vector."""
        out = np.ones((len(v), len(self.c)), bool)
        rows = np.flatnonzero(np.abs(v).max(1) < SCREENED) if self.fits else np.zeros(0, np.int64)
        own = v[rows]
        near = self.squares - 2.0 * (own.astype(np.float32) @ self.c32)
        length = np.sqrt((own * own).sum(1))[:, None]
        # the float64 steps are off by less than 2**-40 of their terms
        off = 2 * self.gamma * (1 + 2.0**-40) * length * self.lengths + 2.0**-40 * (self.squares + 2 * length * self.lengths)
        out[rows] = near - off <= (near + off).min(1)[:, None]
        return out

    def nearest(self, v: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of each vector, the lower of equal ones."""
        can = self.candidates(v)
        best = can.argmax(1)
        for row in np.flatnonzero(can.sum(1) > 1):  # few: their vectors lie next to a border
            many = np.flatnonzero(can[row])
            far = exact_distances(np.repeat(v[row : row + 1], len(many), 0), [self.centroids[k] for k in many])
            best[row] = many[min(range(len(many)), key=lambda k: (far[k], k))]
        return best


def _vectors(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(-1, size)


def _limbs(x: int) -> list[int]:
    """x = the sum of limb k times 2**(LIMB * k); all have its sign."""
    sign = -1 if x < 0 else 1
    return [sign * (abs(x) >> LIMB * k & (1 << LIMB) - 1) for k in range(LIMBS)]


def new_centroids(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """One round: the floors of the means of the vectors nearest to each centroid; centroids without vectors stay."""
    size = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        sums: list[list[int]] = [[0] * size for _ in centroids]
        many = [0] * len(centroids)
        for batch in batches:
            v = _vectors(batch, size)
            best = screen.nearest(v)
            for k in np.unique(best):
                own = v[best == k]
                if np.abs(own).max() < EXACT:
                    total = own.astype(np.int64).sum(0).tolist()
                else:
                    total = _ints(own).astype(object).sum(0).tolist()
                sums[k] = [a + int(b) for a, b in zip(sums[k], total)]
                many[k] += len(own)
        rows = [(k, i, j, x) for k in range(len(centroids)) if many[k] for i, s in enumerate([*sums[k], many[k]]) for j, x in enumerate(_limbs(s)) if x]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in list(zip(*rows))[:3]] + [pa.array([r[3] for r in rows], pa.int64())], ["cluster", "place", "limb", "x"])

    parts = vectors.mapInArrow(run, "cluster int, place int, limb int, x long")
    totals = {k: [0] * (size + 1) for k in range(len(centroids))}
    for row in parts.groupBy("cluster", "place", "limb").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # LIMBS a component at most
        totals[row["cluster"]][row["place"]] += int(row["x"]) << LIMB * row["limb"]
    return [[t // total[size] for t in total[:size]] if total[size] else old for old, total in zip(centroids, totals.values())]


def assigned(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """vec_id, cluster and exact squared distance of every vector."""
    size = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        for batch in batches:
            v = _vectors(batch, size)
            best = screen.nearest(v)
            far = exact_distances(v, [centroids[k] for k in best])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array([min(int(x), MOST) for x in far], pa.int64())], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> Centroids:
    """The k vectors with the least hashes of their ids, in the order of the hashes."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return [[int(x) for x in r["v"]] for r in vectors.orderBy(F.sha2(name.cast("binary"), 256), "v").limit(k).collect()]


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector of rows (vec_id, embedding)."""
    vectors = written(integer_vectors(rows, size, scale), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return assigned(vectors, [[0] * size]).selectExpr("vec_id", "cluster", "distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    for _ in range(rounds):
        centroids = new_centroids(vectors, centroids)
    final = written(assigned(vectors, centroids), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row a centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = min(sum(sums.values()), MOST)
    per = [(j, min(s, MOST), total, digest[j]) for j, s in sums.items()]
    per = rows.sparkSession.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
