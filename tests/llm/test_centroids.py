"""Centroid clustering against plain Python integers."""

import hashlib
import math
import random

import numpy as np

from dataclinic.llm.centroid_clustering import Centroids, centroid_clustering, project

SCHEMA = "vec_id bigint, embedding array<double>, cluster int, x string, n int"


def brute(rows, k, rounds, dim):
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e, *_ in rows
            if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) and abs(x) < 1e30 / 64 for x in e)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in start]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [min((dist(v, c), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(cents)):
            mine = [v for (_, v), (_, a) in zip(kept, own) if a == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine)]
    own = assign()
    fits = lambda s: s if s < 1 << 63 else None
    per = [sum(d for d, a in own if a == j) for j in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, a, fits(d), fits(per[a]), fits(sum(per)), sha[a]) for (i, _), (d, a) in zip(kept, own)), key=str)


def rows_of(n, dim, seed):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(7)]
    return [(i, [c + r.gauss(0, 0.3) for c in r.choice(centres)], 1, "x", 0) for i in range(n)]


def got(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


def test_matches_integers(spark):
    dim = 10
    rows = rows_of(300, dim, 3)
    rows += [(500 + k, rows[5][1], 1, "x", 0) for k in range(60)] + [(5, rows[9][1], 1, "x", 0), (5, rows[9][1], 1, "x", 0)]
    rows += [(None, rows[4][1], 1, "x", 0), (900, None, 1, "x", 0), (901, [1.0], 1, "x", 0), (902, [], 1, "x", 0),
             (903, [math.nan] * dim, 1, "x", 0), (904, [math.inf] + [0.0] * 9, 1, "x", 0), (905, [None] + [0.0] * 9, 1, "x", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for k, rounds, leading in ((16, 3, 4), (3, 1, 10), (500, 2, 2)):
        assert got(centroid_clustering(df, k=k, rounds=rounds, dim=dim, leading=leading)) == brute(rows, k, rounds, dim)


def test_wide_values_are_exact(spark):
    dim = 4
    rows = rows_of(60, dim, 4)
    rows += [(100 + i, [float(3 ** i), -1e7 * i, 2.0 ** 40, 0.5], 1, "x", 0) for i in range(30)]
    rows += [(200, [1e25, -1e25, 0.0, 1.0], 1, "x", 0), (201, [1e28] * 4, 1, "x", 0), (202, [1e300] * 4, 1, "x", 0)]
    assert got(centroid_clustering(spark.createDataFrame(rows, SCHEMA), k=9, dim=dim, leading=2)) == brute(rows, 9, 3, dim)


def test_ties_and_empty(spark):
    rows = [(i, [float(i % 2), 0.0], 1, "x", 0) for i in range(12)]  # equal centroids: ties, and clusters that stay empty
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(centroid_clustering(df, k=6, dim=2)) == brute(rows, 6, 3, 2)
    assert centroid_clustering(df.limit(0), dim=2).count() == 0
    null = spark.createDataFrame([(None, [1.0, 2.0], 1, "x", 0)], SCHEMA)
    assert centroid_clustering(null, dim=2).count() == 0


def test_float_table_and_bound(spark):
    r = np.random.default_rng(1)
    x = np.floor(64 * r.normal(size=(400, 64)) * np.geomspace(1, 0.01, 64))
    axes = np.linalg.qr(r.normal(size=(64, 64)))[0][:, :8]
    c = Centroids([[int(v) for v in row] for row in x[:16]], axes)
    p, res = project(x, axes)
    which, d, verified = c.nearest(x, p, res)
    full = ((x[:, None, :] - x[None, :16, :]) ** 2).sum(axis=2)
    assert (which == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :8]  # the principal axes leave most centroids unverified
    p, res = project(x, axes)
    which, d, verified = Centroids(c.rows, axes).nearest(x, p, res)
    assert (which == full.argmin(axis=1)).all() and verified < 400 * 8
    rows = [(i, [float(np.float32(v)) for v in e]) for i, e in enumerate(r.normal(size=(80, 64)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert got(centroid_clustering(df)) == brute(rows, 16, 3, 64)
