"""Random forest grown to purity, without a depth limit.

MLlib's trees stop at depth 30.  Here a tree grows in two ways:

* *Wide* nodes (more than ``local_rows`` rows) grow level by level over the whole table: a pass finds each node's range of
  every feature, a pass counts classes in ``BINS`` equal bins of that range, and the split of least Gini impurity is taken.
  A bin is narrower in each level, so every node that has two different rows is split in the end.  At most ``MAX_WIDE``
  nodes are counted at a time; only ranges and splits, a row for each wide node, come to the driver.
* A node that is no larger goes to one task with its rows, which grows it exactly (every threshold between two
  values) until its leaves are pure or hold equal rows.

Rows of a tree are found by walking its wide splits, so no table of rows and nodes is kept.  Subtrees are rows of a
stored table; prediction sends each row to the subtrees that it reaches and averages their class shares.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

LOCAL_ROWS = 50_000
BINS = 64
MAX_WIDE = 512
#: Cumulated Poisson(1) probabilities: how often a row is drawn into a tree's sample.
_POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(12)])


def _draws(ids: np.ndarray, tree: int, seed: int, bootstrap: bool) -> np.ndarray:
    """Times that each row is in the sample of a tree."""
    if not bootstrap:
        return np.ones(len(ids), np.int64)
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(zlib.crc32(f"{seed}|{tree}".encode()))
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
    u = (x ^ (x >> np.uint64(31))) / 2.0 ** 64
    return np.searchsorted(_POISSON, u, side="right")


def _order(n: int, seed: int, tree: int, path: str) -> np.ndarray:
    """Features in the order in which a node considers them."""
    return np.random.default_rng(zlib.crc32(f"{seed}|{tree}|{path}".encode())).permutation(n)


def _gini_best(counts: np.ndarray) -> tuple[float, int]:
    """(impurity, cut) of the best cut of rows of class counts in order; inf where no cut leaves rows on both sides."""
    left = np.cumsum(counts, axis=0)[:-1]
    total = counts.sum(axis=0)
    right = total - left
    nl, nr = left.sum(axis=1), right.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        cost = nl - (left * left).sum(axis=1) / nl + nr - (right * right).sum(axis=1) / nr
    cost[(nl == 0) | (nr == 0)] = np.inf
    if len(cost) == 0:
        return np.inf, -1
    k = int(cost.argmin())
    return float(cost[k]), k


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, m: int, seed: int = 0, tree: int = 0, path: str = "") -> tuple:
    """An exact tree of the rows: (feature or -1, threshold, left, right, class shares) by node.  Each node tries
    features in random order until ``m`` of them could split it."""
    feat, thr, left, right, share = [], [], [], [], []
    todo = [(np.arange(len(y)), -1, 0, path)]
    while todo:
        rows, parent, side, name = todo.pop()
        me = len(feat)
        if parent >= 0:
            (left, right)[side][parent] = me
        n = np.bincount(y[rows], w[rows], classes)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), share.append(n / n.sum())
        if (n > 0).sum() < 2:
            continue
        best, tried = (np.inf, -1, 0.0), 0
        for f in _order(x.shape[1], seed, tree, name):
            v = x[rows, f]
            o = np.argsort(v, kind="stable")
            s = v[o]
            cut = np.flatnonzero(s[1:] != s[:-1])
            if len(cut) == 0:
                continue
            one = np.zeros((len(rows), classes))
            one[np.arange(len(rows)), y[rows][o]] = w[rows][o]
            c = np.add.reduceat(one, np.concatenate([[0], cut + 1]), axis=0)
            cost, k = _gini_best(c)
            if (cost, f) < best[:2]:
                a, b = s[cut[k]], s[cut[k] + 1]
                mid = a + (b - a) / 2
                best = (cost, f, a if mid >= b else mid)
            tried += 1
            if tried == m:
                break
        if best[1] < 0:
            continue  # equal rows of different classes
        feat[me], thr[me] = best[1], best[2]
        low = x[rows, best[1]] <= best[2]
        todo += [(rows[~low], me, 1, name + "1"), (rows[low], me, 0, name + "0")]
    return np.array(feat), np.array(thr), np.array(left), np.array(right), np.array(share)


def walk(model: tuple, x: np.ndarray) -> np.ndarray:
    """Class shares of each row."""
    feat, thr, left, right, share = model
    at = np.zeros(len(x), np.int64)
    live = np.flatnonzero(feat[at] >= 0)
    while len(live):
        node = at[live]
        low = x[live, feat[node]] <= thr[node]
        at[live] = np.where(low, left[node], right[node])
        live = live[feat[at[live]] >= 0]
    return share[at]


def _reached(splits: dict, x: np.ndarray) -> np.ndarray:
    """Path of the node that each row reaches by a tree's wide splits (path -> (feature, threshold))."""
    out = np.full(len(x), "", object)
    todo = [("", np.arange(len(x)))]
    while todo:
        path, rows = todo.pop()
        if path not in splits or len(rows) == 0:
            out[rows] = path
            continue
        f, t = splits[path]
        low = x[rows, f] <= t
        todo += [(path + "0", rows[low]), (path + "1", rows[~low])]
    return out


def _x(batch, n: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n)


@dataclass
class DeepForest:
    features: list
    classes: list
    splits: list  # wide splits of each tree
    subtrees: DataFrame  # (tree, node, model)
    trees: int

    def predict(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """``df`` with the class of largest mean share (ties: the smaller); features must not be null."""
        nf, splits, classes, trees = len(self.features), self.splits, self.classes, self.trees
        # numbered and stored once: rows are joined back by number
        rows = cut_lineage(df.withColumn("__id", F.monotonically_increasing_id()))
        vec = rows.select(F.col("__id").alias("id"), F.array(*[F.col(c).cast("double") for c in self.features]).alias("x"))

        def route(batches):
            for b in batches:
                x = _x(b, nf)
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array([t] * len(x), pa.int32()),
                                                      pa.array(_reached(splits[t], x), pa.string())], ["id", "x", "tree", "node"])

        def vote(rows: pa.Table, model: pa.Table) -> pa.Table:
            if rows.num_rows == 0 or model.num_rows == 0:
                return pa.table({"id": pa.array([], pa.int64()), "share": pa.array([], pa.list_(pa.float64()))})
            x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, nf)
            share = walk(pickle.loads(model["model"][0].as_py()), x)
            return pa.table({"id": rows["id"], "share": pa.array(list(share), pa.list_(pa.float64()))})

        routed = vec.mapInArrow(route, "id bigint, x array<double>, tree int, node string")
        votes = routed.groupBy("tree", "node").cogroup(self.subtrees.groupBy("tree", "node")).applyInArrow(
            vote, "id bigint, share array<double>")
        sums = votes.groupBy("id").agg(*[F.sum(F.round(F.col("share")[k], 12)).alias(f"s{k}") for k in range(len(classes))])
        top = F.greatest(*[F.col(f"s{k}") for k in range(len(classes))]) if len(classes) > 1 else F.col("s0")
        pick = F.lit(None).cast("double")
        for k in reversed(range(len(classes))):
            pick = F.when(F.col(f"s{k}") >= top - 1e-9, F.lit(float(classes[k]))).otherwise(pick)
        out = rows.join(sums.select(F.col("id").alias("__id"), pick.alias(prediction)), "__id", "left")
        return out.drop("__id")


def fit(train: DataFrame, features: list[str], label: str = "label", n_trees: int = 20, seed: int = 42, bootstrap: bool = True,
        max_features: int | None = None, local_rows: int = LOCAL_ROWS) -> DeepForest:
    """``train``: numeric ``label`` and features, none null.  ``max_features``: features a node tries (default: the
    square root of their number)."""
    nf = len(features)
    m = max_features or max(1, int(np.sqrt(nf)))
    rows = cut_lineage(train.select(F.monotonically_increasing_id().alias("id"), F.col(label).cast("double").alias("y"),
                                    F.array(*[F.col(c).cast("double") for c in features]).alias("x")))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    classes = sorted(counts)
    if not classes:
        raise ValueError("no training rows")
    nc, total = len(classes), sum(counts.values())
    splits: list[dict] = [{} for _ in range(n_trees)]
    ended: dict = {}  # wide nodes that cannot be split: class shares

    def sampled(b, t):
        """(features, class, draws, reached node) of a batch's rows in a tree's sample."""
        x, ids = _x(b, nf), b.column("id").to_numpy(zero_copy_only=False)
        w = _draws(ids, t, seed, bootstrap)
        on = np.flatnonzero(w)
        y = np.searchsorted(classes, b.column("y").to_numpy(zero_copy_only=False))
        return x[on], y[on], w[on], _reached(splits[t], x[on]), ids[on]

    def ranges(wide):
        def run(batches):
            lo, hi = np.full((len(wide), nf), np.inf), np.full((len(wide), nf), -np.inf)
            for b in batches:
                for t in {t for t, _ in wide}:
                    x, _, _, node, _ = sampled(b, t)
                    for i, (u, p) in enumerate(wide):
                        if u == t:
                            part = x[node == p]
                            if len(part):
                                lo[i], hi[i] = np.minimum(lo[i], part.min(axis=0)), np.maximum(hi[i], part.max(axis=0))
            i, f = np.nonzero(np.isfinite(lo))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(f, pa.int32()), pa.array(lo[i, f]), pa.array(hi[i, f])],
                                             ["i", "f", "lo", "hi"])
        return run

    def histogram(wide, lo, hi, tried):
        def run(batches):
            h = np.zeros((len(wide), nf, BINS, nc), np.int64)
            for b in batches:
                for t in {t for t, _ in wide}:
                    x, y, w, node, _ = sampled(b, t)
                    for i, (u, p) in enumerate(wide):
                        if u == t:
                            at = np.flatnonzero(node == p)
                            for f in tried[i]:
                                np.add.at(h, (i, f, _bin(x[at, f], lo[i, f], hi[i, f]), y[at]), w[at])
            i, f, k, c = np.nonzero(h)
            yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.int32()) for v in (i, f, k, c)], pa.array(h[i, f, k, c])],
                                             ["i", "f", "k", "c", "n"])
        return run

    def best(t: pa.Table) -> pa.Table:
        """The split of one node."""
        i, f, k, c, n = (t[x].to_numpy() for x in ("i", "f", "k", "c", "n"))
        found = (np.inf, -1, -1)
        for g in np.unique(f):
            h = np.zeros((BINS, nc))
            at = f == g
            h[k[at], c[at]] = n[at]
            cost, cut = _gini_best(h)
            if cost < found[0]:
                found, low = (cost, int(g), cut), h[:cut + 1].sum(axis=0)
                high = h[cut + 1:].sum(axis=0)
        return pa.table({"i": pa.array([i[0]], pa.int32()), "f": pa.array([found[1]], pa.int32()), "cut": pa.array([found[2]], pa.int32()),
                         "low": pa.array([low.tolist()], pa.list_(pa.float64())), "high": pa.array([high.tolist()], pa.list_(pa.float64()))})

    wide = [(t, "") for t in range(n_trees)] if total > local_rows and nc > 1 else []
    while wide:
        now, wide = wide[:MAX_WIDE], wide[MAX_WIDE:]
        lo, hi = np.zeros((len(now), nf)), np.zeros((len(now), nf))
        for r in rows.mapInArrow(ranges(now), "i int, f int, lo double, hi double").groupBy("i", "f").agg(
                F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
            lo[r["i"], r["f"]], hi[r["i"], r["f"]] = r["lo"], r["hi"]
        tried = [[f for f in _order(nf, seed, t, p) if lo[i, f] < hi[i, f]][:m] for i, (t, p) in enumerate(now)]
        stuck = [i for i in range(len(now)) if not tried[i]]
        for i in stuck:
            ended[now[i]] = None  # equal rows: one leaf
        found = rows.mapInArrow(histogram(now, lo, hi, tried), "i int, f int, k int, c int, n bigint").groupBy(
            "i", "f", "k", "c").agg(F.sum("n").alias("n")).groupBy("i").applyInArrow(
            best, "i int, f int, cut int, low array<double>, high array<double>").collect()
        for r in found:
            t, p = now[r["i"]]
            a, b = lo[r["i"], r["f"]], hi[r["i"], r["f"]]
            splits[t][p] = (r["f"], _edge(a, b, r["cut"]))
            for side, n in (("0", r["low"]), ("1", r["high"])):
                if sum(n) > local_rows and sum(v > 0 for v in n) > 1:
                    wide.append((t, p + side))

    def send(batches):
        """Rows of every node that is left, in the sample of its tree."""
        for b in batches:
            for t in range(n_trees):
                x, y, w, node, ids = sampled(b, t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t] * len(y), pa.int32()), pa.array(node, pa.string()), pa.array(ids), pa.array(list(x), pa.list_(pa.float64())),
                     pa.array(y, pa.int32()), pa.array(w, pa.int64())], ["tree", "node", "id", "x", "y", "w"])

    rest = rows.mapInArrow(send, "tree int, node string, id bigint, x array<double>, y int, w bigint")
    # a node that is pure, or of equal rows, may have any size: it needs its class counts only
    sizes = rest.groupBy("tree", "node").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("y") == k, F.col("w")).otherwise(0)).alias(f"c{k}") for k in range(nc)])
    large = F.col("n") > local_rows
    stop = {f"{t}|{p}" for t, p in ended}
    single = F.concat_ws("|", F.col("tree").cast("string"), "node").isin(sorted(stop)) if stop else F.lit(False)
    whole = sizes.where(large | single)

    def leaf(batches):
        for b in batches:
            c = np.stack([b.column(f"c{k}").to_numpy(zero_copy_only=False) for k in range(nc)], axis=1).astype(float)
            models = [pickle.dumps((np.array([-1]), np.zeros(1), np.array([-1]), np.array([-1]), (v / v.sum())[None, :])) for v in c]
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("node"), pa.array(models, pa.binary())], ["tree", "node", "model"])

    def subtree(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, nf)
        tree, node = t["tree"][0].as_py(), t["node"][0].as_py()
        model = grow(x, t["y"].to_numpy(), t["w"].to_numpy().astype(float), nc, m, seed, tree, node)
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": [node], "model": pa.array([pickle.dumps(model)], pa.binary())})

    schema = "tree int, node string, model binary"
    if total > local_rows:
        whole = cut_lineage(whole)
        rest = rest.join(whole.select("tree", "node"), ["tree", "node"], "left_anti")
        parts = rest.groupBy("tree", "node").applyInArrow(subtree, schema).unionByName(whole.mapInArrow(leaf, schema))
    else:
        parts = rest.groupBy("tree", "node").applyInArrow(subtree, schema)
    return DeepForest(list(features), classes, splits, cut_lineage(parts), n_trees)


def _edge(lo: float, hi: float, k: int) -> float:
    """Upper end of bin ``k``."""
    return lo + (hi - lo) * ((k + 1) / BINS)


def _bin(v: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Bin of each value: the first whose upper end is not below it."""
    edges = np.array([_edge(lo, hi, k) for k in range(BINS - 1)])
    return np.searchsorted(edges, v, side="left")
