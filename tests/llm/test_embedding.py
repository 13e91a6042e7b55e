"""Embedding near-dup against brute force."""

import math
import random

import dataclinic.llm.embedding_neardup as module
from dataclinic.llm.embedding_neardup import embedding_neardup


def brute(rows, t):
    ok = [i for i, (v, e, l) in enumerate(rows) if v is not None and e and l is not None
          and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    links = {i: set() for i in range(len(rows))}
    for a in ok:
        for b in ok:
            ea, eb = rows[a][1], rows[b][1]
            if a < b and rows[a][2] == rows[b][2] and len(ea) == len(eb):
                c = sum(x * y for x, y in zip(ea, eb)) / math.sqrt(sum(x * x for x in ea) * sum(x * x for x in eb))
                if c >= t:
                    links[a].add(b)
                    links[b].add(a)
    comp = {i: rows[i][0] for i in range(len(rows))}
    for i in ok:
        seen, todo = {i}, [i]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        comp[i] = min(rows[k][0] for k in seen)
    return sorted(((rows[i][0], len(links[i]), comp[i], rows[i][0] == comp[i]) for i in range(len(rows))), key=str)


def test_matches_brute_force(spark):
    r = random.Random(2)
    vec = lambda: [float(f"{r.gauss(0, 1):.3f}") for _ in range(6)]
    centres = [vec() for _ in range(8)]
    rows = []
    for i in range(300):
        c = r.choice(centres)
        rows.append((i, [x + r.gauss(0, 0.12) for x in c], r.choice([1, 1, 1, 2, 3])))
    rows += [(400 + k, rows[7][1], 1) for k in range(20)] + [(500, rows[8][1], 1), (500, rows[8][1], 1)]
    rows += [(700, [9.0, -9.0, 9.0, -9.0, 9.0, -9.0], 8), (700, rows[7][1], 9)]
    rows += [(600, None, 1), (601, [0.0] * 6, 1), (602, [float("nan")] + [1.0] * 5, 1), (603, [None] + [1.0] * 5, 1),
             (604, vec(), None), (None, rows[7][1], 1), (605, [1.0, 2.0], 1), (606, [2.0, 4.0], 1), (607, [], 1),
             (608, [float("inf")] * 6, 1)]
    import numpy as np
    rows = [(v, None if e is None else [None if x is None else float(np.float32(x)) for x in e], l) for v, e, l in rows]
    df = spark.createDataFrame([(*x, "z", 1) for x in rows],
                               "vec_id bigint, embedding array<float>, label int, part string, cell int")
    got = sorted((tuple(x) for x in embedding_neardup(df, per_cell=20, block=16).collect()), key=str)
    assert got == brute(rows, 0.93)
    assert embedding_neardup(df.limit(0)).count() == 0
    wide = [(v, None if e is None else [None if x is None else x + 1e-12 for x in e], l) for v, e, l in rows]
    df = spark.createDataFrame(wide, "vec_id bigint, embedding array<double>, label int")
    assert sorted((tuple(x) for x in embedding_neardup(df, per_cell=20, block=16).collect()), key=str) == brute(wide, 0.93)
    whole = [(i, [r.randint(-3, 3) for _ in range(4)], 1) for i in range(120)]
    df = spark.createDataFrame(whole, "vec_id bigint, embedding array<int>, label int")
    assert sorted((tuple(x) for x in embedding_neardup(df).collect()), key=str) == brute(whole, 0.93)


def test_cells_are_split_level_by_level(spark, monkeypatch):
    r = random.Random(4)
    vec = lambda: [r.gauss(0, 1) for _ in range(5)]
    rows = []
    for _ in range(60):
        c = vec()
        rows += [[x + r.gauss(0, 0.04) for x in c] for _ in range(8)]
    rows += [[x + r.gauss(0, 0.01) for x in rows[0]] for _ in range(60)]  # no pivot separates these
    rows = [(i, e, 1 if i % 9 else 2) for i, e in enumerate(rows)]
    levels, sizes = [], []

    def spied(*a, **k):
        out = module_refined(*a, **k)
        levels.append(out[1])
        sizes.extend(x["count"] for x in out[0].groupBy("cell").count().collect())
        return out
    module_refined = module.refined
    monkeypatch.setattr(module, "refined", spied)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = embedding_neardup(df, threshold=0.995, per_cell=4, block=5, max_pivots=4, split=3, fanout=12, chunk=50)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows, 0.995)
    assert levels[0] >= 2 and max(sizes) < len(rows) / 3 and len(sizes) > 12, (levels, max(sizes), len(sizes))
