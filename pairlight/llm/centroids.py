"""Operator 11, centroid clustering on exact integers with a progressive search in the Walsh-Hadamard domain."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.llm.common import materialise
from pairlight.llm.walsh import coarse_to_fine, transform

DIM = 64
ORDER = coarse_to_fine(DIM)
#: Coefficients are added up to these counts; centroids are struck out after each.
STOPS = (8, 16, 24, 32, 48, 64)
#: Up to this size of a component all sums of squares fit 64 bits; above, Python's integers are used.
FAST = 1 << 24
_LOW = 31


def coefficients(v: np.ndarray) -> np.ndarray:
    """Exact coefficients of integer vectors, coarse to fine."""
    return transform(v)[..., ORDER]


def nearest(w: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each vector, both given by coefficients; ties go to the smaller number.

    Squared differences are added coarse to fine, so a partial sum only grows.
    The centroid that leads after the first coefficients is finished at
    once; whichever exceeds its full sum is strictly worse and is not looked
    at again.  The others are finished over all coefficients.
    """
    k, n = len(centres), len(w)
    total = np.zeros((k, n), w.dtype)
    alive = np.ones((k, n), bool)
    lo = 0
    for hi in STOPS:
        for c in range(k):
            at = np.flatnonzero(alive[c])
            d = w[at, lo:hi] - centres[c, lo:hi]
            total[c, at] += (d * d).sum(1)
        if lo == 0:
            lead = w - centres[total.argmin(0)]
            best = (lead * lead).sum(1)
        if hi < DIM:
            alive &= (total <= best).astype(bool)
        lo = hi
    # What was struck out stopped above ``best``, which the leader reaches.
    cluster = total.argmin(0)
    return cluster, total[cluster, np.arange(n)] // DIM


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
    return v if not len(v) or max(abs(int(v.min())), abs(int(v.max()))) <= FAST else v.astype(object)


def _near(v: np.ndarray, centres: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    big = v.dtype == object or max(abs(x) for c in centres for x in c) > FAST
    kind = object if big else np.int64
    return nearest(coefficients(v.astype(kind)), coefficients(np.array(centres, dtype=kind)))


def _sums(centres: list[list[int]]):
    """Number and componentwise sums of each cluster within a task, the sums as high and low parts that can't overflow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(centres), np.int64)
        s = np.zeros((len(centres), 2 * DIM), np.int64)
        for b in batches:
            if not len(b):
                continue
            v = _vectors(b)
            cluster, _ = _near(v, centres)
            v = v.astype(np.int64)
            parts = np.concatenate([v >> _LOW, v & ((1 << _LOW) - 1)], axis=1)
            for c in range(len(centres)):
                mine = cluster == c
                n[c] += mine.sum()
                s[c] += parts[mine].sum(0)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(s[at].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    return run


def _assign(centres: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            cluster, distance = _near(_vectors(b), centres)
            told = [int(d) if d < 1 << 63 else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(told, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def kept_vectors(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v, the integers floor(scale * x) of every vector of 64 usable components."""
    x = F.col("embedding").cast("array<double>")
    top = float(1 << 63) / scale
    usable = (F.size(x) == DIM) & F.forall(x, lambda c: F.coalesce(F.abs(c) < F.lit(top), F.lit(False)))
    return embeddings.where(F.coalesce(usable, F.lit(False))).select("vec_id", F.transform(x, lambda c: F.floor(c * float(scale)).cast("long")).alias("v"))


def starts(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors with the smallest hashes of salt and id; null ids come last, equal ids go by components."""
    h = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in vectors.select(h.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3") -> DataFrame:
    """Clusters of all vectors: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    A vector takes part if it has exactly 64 components, none of them null,
    NaN, infinite or beyond a long once multiplied by 1024; others give no row.
    Each round reads the stored integers once; a task sends its sums of each
    cluster, which are added in one aggregate, and only k rows of sums reach the
    driver.  Rows of repeated or null ids are vectors of their own.  With fewer
    vectors than k there are fewer centroids; an empty table gives no row; other
    columns play no part.  A distance or inertia beyond a long is null.
    """
    vectors = materialise(kept_vectors(embeddings), "centroids-vectors")
    centres = starts(vectors, k, salt)
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    if not centres:
        return vectors.select("vec_id", *(F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    for _ in range(rounds):
        task = vectors.mapInArrow(_sums(centres), "cluster int, n long, s array<long>")
        part = task.select("cluster", "n", F.posexplode("s").alias("at", "x"))
        rows = part.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
        sums = {(r["cluster"], r["at"]): (int(r["x"]), r["n"]) for r in rows}
        for c in {r["cluster"] for r in rows}:
            both = [(sums[c, j][0] << _LOW) + sums[c, DIM + j][0] for j in range(DIM)]
            centres[c] = [s // sums[c, 0][1] for s in both]

    found = materialise(vectors.mapInArrow(_assign(centres), schema), "centroids-found")
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = {r["cluster"]: int(r["s"]) if r["full"] else None for r in found.groupBy("cluster").agg(whole.alias("s"), (F.count("distance") == F.count(F.lit(1))).alias("full")).collect()}
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    of = lambda values, kind: F.element_at(F.array(*(F.lit(x).cast(kind) for x in values)), F.col("cluster") + 1)
    total = None if None in per.values() else sum(per.values())
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return found.select("vec_id", "cluster", "distance", of([fits(per.get(c)) for c in range(len(centres))], "long").alias("cluster_inertia"), F.lit(fits(total)).cast("long").alias("inertia"), of(hashes, "string").alias("centroid_sha256"))
