"""Centroid clustering in integers, with centroids filtered by rotated coordinates.

Vectors become integers ``floor(SCALE * x)``.  A rotation along the principal axes
(second moments of all vectors, one pass) puts most of a distance into few
coordinates, so a table is stored once with the ``LEADING`` rotated coordinates of
every vector and the norm of the rest.  For a vector and a centroid

    |p(x) - p(c)|^2 + (r(x) - r(c))^2  <=  |x - c|^2

with p the leading coordinates and r the residual norm, whatever the rotation.  A round
reads the table, takes the centroid of least bound, computes that distance in integers,
and verifies in integers every centroid whose bound (less a slack that covers all
rounding) does not exceed it.  Nearest centroids, ties and sums are so exact.  A task
sends one row per cluster and component; only centroids come to the driver.

Edge cases: vectors that are null, of another length, or hold a null or non-finite
component are left out, and so are those with an integer of 10^30 or more, which
neither a long distance nor a 38-digit sum can hold; a distance or inertia beyond a
long is null; a null id is clustered but never a first centroid; rows that share an id
are vectors of their own (equal hashes are ordered by the vector); with fewer vectors
than ``k`` there are fewer clusters; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

K, ROUNDS, DIM, SCALE = 16, 3, 64, 64
LEADING = 16
LIMIT = 1e30
SMALL = 1 << 26  # components below this keep a squared distance of 1,024 components in 64 bits
_LONG = (1 << 63) - 1


def _matrix(col, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), dim)


def _moments(dim: int):
    """Sums of x x^T of a task: one row per component."""
    def run(batches):
        m = np.zeros((dim, dim))
        for b in batches:
            x = _matrix(b.column("x"), dim)
            m += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))],
                                         ["i", "row"])
    return run


def principal_axes(integers: DataFrame, dim: int) -> np.ndarray:
    """Orthonormal columns, largest second moment first."""
    rows = (integers.select("x").mapInArrow(_moments(dim), "i int, row array<double>")
            .select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect())
    m = np.zeros((dim, dim))
    for r in rows:
        m[r["i"], r["j"]] = r["v"]
    _, axes = np.linalg.eigh(m / max(1.0, np.abs(m).max()))
    axes = axes[:, ::-1]
    return axes if np.abs(axes.T @ axes - np.eye(dim)).max() < 1e-9 else np.eye(dim)


def project(x: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leading coordinates, residual norm) of each row."""
    p = x @ axes
    return p, np.sqrt(np.maximum((x * x).sum(axis=1) - (p * p).sum(axis=1), 0))


class Centroids:
    """Centroids as exact integers, with what the filter needs."""

    def __init__(self, rows: list[list[int]], axes: np.ndarray):
        self.rows = rows
        f = np.array(rows, np.float64).reshape(len(rows), -1)
        self.p, self.r = project(f, axes)
        self.norm = (f * f).sum(axis=1)
        self.big = np.abs(f).max(axis=1) >= SMALL
        self.ints = np.where(self.big[:, None], 0.0, f).astype(np.int64)

    def nearest(self, x: np.ndarray, p: np.ndarray, r: np.ndarray):
        """(number, squared distance as Python integers or int64, centroids verified) of each row of ``x``."""
        n, k = len(x), len(self.rows)
        lower = ((p * p).sum(axis=1)[:, None] + (self.p * self.p).sum(axis=1) - 2 * (p @ self.p.T)
                 + (r[:, None] - self.r) ** 2)
        lower -= 1e-9 * ((x * x).sum(axis=1)[:, None] + self.norm) + 1e-6
        first = lower.argmin(axis=1)
        wide = (np.abs(x).max(axis=1) >= SMALL) | self.big[first]
        xi = np.where(wide[:, None], 0.0, x).astype(np.int64)
        best = ((xi - self.ints[first]) ** 2).sum(axis=1)
        which = first.copy()
        alive = lower <= best[:, None]
        wide |= (alive & self.big).any(axis=1)
        alive[np.arange(n), first] = False
        verified = n
        for c in range(k):
            rows = np.flatnonzero(alive[:, c] & ~wide)
            verified += len(rows)
            d = ((xi[rows] - self.ints[c]) ** 2).sum(axis=1)
            win = (d < best[rows]) | ((d == best[rows]) & (c < which[rows]))
            best[rows[win]], which[rows[win]] = d[win], c
        rows = np.flatnonzero(wide)
        if len(rows) == 0:
            return which, best, verified
        exact = best.astype(object)
        for i in rows:
            v = [int(a) for a in x[i]]
            exact[i], which[i] = min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(self.rows))
        return which, exact, verified + len(rows) * (k - 1)


def _sums(centroids: Centroids, dim: int):
    """Rows (cluster, component, sum, count) of a task, as exact decimal text."""
    def run(batches):
        total, count = {}, {}
        for b in batches:
            x = _matrix(b.column("x"), dim)
            which, _, _ = centroids.nearest(x, _matrix(b.column("p"), len(centroids.p[0])),
                                            b.column("r").to_numpy(zero_copy_only=False))
            for c in np.unique(which):
                part = x[which == c]
                if np.abs(part).max() < SMALL:
                    s = [int(v) for v in part.astype(np.int64).sum(axis=0)]
                else:
                    s = [sum(int(v) for v in col) for col in part.T]
                total[c] = [a + b for a, b in zip(total[c], s)] if c in total else s
                count[c] = count.get(c, 0) + len(part)
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(keys, dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(keys)), pa.int32()),
             pa.array([str(v) for c in keys for v in total[c]], pa.string()),
             pa.array(np.repeat([count[c] for c in keys], dim), pa.int64())], ["cluster", "i", "total", "n"])
    return run


def _assigned(centroids: Centroids, dim: int):
    def run(batches):
        for b in batches:
            which, d, verified = centroids.nearest(_matrix(b.column("x"), dim), _matrix(b.column("p"), len(centroids.p[0])),
                                                   b.column("r").to_numpy(zero_copy_only=False))
            d = [int(v) if v <= _LONG else None for v in d]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(which, pa.int32()), pa.array(d, pa.int64())],
                                             ["vec_id", "cluster", "distance"])
    return run


def centroid_clustering(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
                        rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, leading: int = LEADING,
                        seed: int = 1) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256, cluster_size."""
    if dim > 1024:
        raise ValueError("dim must be at most 1024: beyond it a squared distance of small components leaves 64 bits")
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    fits = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(LIMIT / scale)))
    kept = v.where((F.size("e") == dim) & fits)

    def integers(batches):
        for b in batches:
            x = np.floor(scale * _matrix(b.column("e"), dim))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(list(x), pa.list_(pa.float64()))],
                                             ["vec_id", "x"])

    whole = kept.mapInArrow(integers, "vec_id bigint, x array<double>")
    axes = principal_axes(whole, dim)[:, :min(leading, dim)]

    def rotate(batches):
        for b in batches:
            p, r = project(_matrix(b.column("x"), dim), axes)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("x"), pa.array(list(p), pa.list_(pa.float64())), pa.array(r, pa.float64())],
                ["vec_id", "x", "p", "r"])

    table = stored(whole.mapInArrow(rotate, "vec_id bigint, x array<double>, p array<double>, r double"))
    ticket = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = table.where("vec_id is not null").orderBy(ticket, "x").limit(k).select("x").collect()
    rows = [[int(a) for a in r["x"]] for r in start]
    out = "vec_id bigint, cluster int, distance bigint"
    if not rows:
        empty = spark.createDataFrame([], out + ", cluster_inertia bigint, inertia bigint, centroid_sha256 string, cluster_size bigint")
        return empty
    for _ in range(rounds):
        found = (table.mapInArrow(_sums(Centroids(rows, axes), dim), "cluster int, i int, total string, n bigint")
                 .groupBy("cluster", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
                 .collect())
        for r in found:
            rows[r["cluster"]][r["i"]] = int(r["total"]) // r["n"]
    final = stored(table.mapInArrow(_assigned(Centroids(rows, axes), dim), out))
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = final.groupBy("cluster").agg(wide.alias("s"), F.count(F.lit(1)).alias("n"), F.count("distance").alias("m")).collect()
    fit = lambda part: (lambda s: s if all(p["n"] == p["m"] for p in part) and s <= _LONG else None)(
        sum(int(p["s"] or 0) for p in part))
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    facts = spark.createDataFrame(
        [(p["cluster"], fit([p]), fit(per), digest(rows[p["cluster"]]), p["n"]) for p in per],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, cluster_size bigint")
    # one row a cluster: k rows at most
    return final.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                                            "centroid_sha256", "cluster_size")
