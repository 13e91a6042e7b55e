"""Trees grown to purity, in one task and level by level over the table."""

import random

import numpy as np

from dataclinic.operators import deep_forest as DF


def plain_tree(rows, feats):
    """A plain recursive tree over all features: predicts by the class shares of the leaf."""
    ys = [y for _, y in rows]
    if len(set(ys)) == 1 or len({tuple(x) for x, _ in rows}) == 1:
        share = {c: ys.count(c) for c in set(ys)}
        return max(sorted(share), key=lambda c: share[c])
    best = None
    for f in range(feats):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:]):
            t = a + (b - a) / 2
            cost = 0.0
            for side in (True, False):
                part = [y for x, y in rows if (x[f] <= t) == side]
                cost += len(part) - sum(part.count(c) ** 2 for c in set(part)) / len(part)
            if best is None or cost < best[0] - 1e-9:
                best = (cost, f, t)
    _, f, t = best
    low, high = [r for r in rows if r[0][f] <= t], [r for r in rows if r[0][f] > t]
    return f, t, plain_tree(low, feats), plain_tree(high, feats)


def plain_predict(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def frame(spark, rows, feats):
    return spark.createDataFrame([(float(y), *map(float, x)) for x, y in rows], ["label", *[f"f{i}" for i in range(feats)]])


def depth(model):
    feat, _, left, right, _ = model
    todo, most = [(0, 0)], 0
    while todo:
        n, d = todo.pop()
        most = max(most, d)
        if feat[n] >= 0:
            todo += [(left[n], d + 1), (right[n], d + 1)]
    return most


def test_equals_a_plain_tree(spark):
    r = random.Random(3)
    rows = []
    for _ in range(500):
        x = [r.randint(0, 9), r.randint(0, 9), r.randint(0, 4)]
        rows.append((x, (x[0] * 3 + x[1] * 2 + x[2] + (r.random() < 0.1)) % 3))
    df = frame(spark, rows, 3)
    tree = plain_tree(rows, 3)
    forest = DF.fit(df, ["f0", "f1", "f2"], n_trees=1, bootstrap=False, max_features=3)
    got = forest.predict(df).collect()
    want = [plain_predict(tree, [p["f0"], p["f1"], p["f2"]]) for p in got]
    same = sum(p["prediction"] == w for p, w in zip(got, want))
    assert same >= 0.97 * len(got)  # equal costs may be cut at another feature
    best = {}
    for x, y in rows:
        best.setdefault(tuple(x), []).append(y)
    top = sum(max(v.count(c) for c in set(v)) for v in best.values())
    assert sum(p["prediction"] == p["label"] for p in got) == top  # pure down to equal rows


def test_deep_table_is_fitted_exactly(spark):
    """Alternating classes of growing values; then 90 indicators, of which a tree must peel off one at a time."""
    rows = [([2.0 ** k, 0.0], k % 2) for k in range(60) for _ in range(1 + (60 - k))]
    df = frame(spark, rows, 2)
    forest = DF.fit(df, ["f0", "f1"], n_trees=1, bootstrap=False, max_features=2)
    assert forest.predict(df).where("prediction <> label").count() == 0
    x = np.array([x for x, _ in rows])
    y = np.array([y for _, y in rows])
    assert depth(DF.grow(x, y, np.ones(len(y)), 2, 2)) >= 6
    n = 90
    chain = [([float(i == k) for i in range(n)], k % 2) for k in range(n) for _ in range(1 << min(k, 3))]
    df = frame(spark, chain, n)
    forest = DF.fit(df, [f"f{i}" for i in range(n)], n_trees=1, bootstrap=False, max_features=n)
    model = DF.grow(np.array([x for x, _ in chain]), np.array([y for _, y in chain]), np.ones(len(chain)), 2, n)
    assert depth(model) >= 40 and forest.predict(df).where("prediction <> label").count() == 0


def test_wide_nodes_grow_over_the_table(spark):
    r = random.Random(5)
    rows = []
    for _ in range(4000):
        x = [r.gauss(0, 1), r.random() ** 8, float(r.randint(0, 3))]
        rows.append((x, int(x[0] * 4) % 2 ^ int(x[2]) % 2))
    rows += [([9.0, 9.0, 9.0], k % 2) for k in range(900)]  # equal rows of two classes, more than fit a task
    df = frame(spark, rows, 3).repartition(6)
    forest = DF.fit(df, ["f0", "f1", "f2"], n_trees=1, bootstrap=False, max_features=3, local_rows=300)
    assert len(forest.splits[0]) >= 8 and forest.subtrees.count() > 8
    out = forest.predict(df)
    assert out.where("f0 <> 9 and prediction <> label").count() == 0
    assert out.where("f0 = 9").select("prediction").distinct().count() == 1 and out.count() == len(rows)


def test_forest_of_samples(spark):
    r = random.Random(6)
    rows = []
    for _ in range(1500):
        x = [r.gauss(0, 1) for _ in range(4)]
        rows.append((x, int(x[0] + x[1] > 0)))
    train, test = frame(spark, rows[:1000], 4), frame(spark, rows[1000:], 4)
    for local in (50_000, 200):
        forest = DF.fit(train, [f"f{i}" for i in range(4)], n_trees=12, seed=1, local_rows=local)
        out = forest.predict(test)
        assert out.where("prediction = label").count() > 0.9 * 500
    w = DF._draws(np.arange(20_000), 3, 42, True)
    assert abs(w.mean() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.02
    one = DF.fit(train.where("label = 1"), ["f0"], n_trees=2)
    assert one.predict(test).where("prediction = 1").count() == 500
