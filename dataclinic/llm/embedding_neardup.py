"""Embedding near-dup: exact metric range join with pivots.

Vectors of one label link when their cosine (double precision) reaches the
threshold, which on unit vectors is a Euclidean range r = sqrt(2 - 2 cos).

1. Identical vectors of a label are one class with a size.
2. Every label gets pivots: classes picked by a hash threshold, about one for
   ``PER_CELL`` classes.  A class lives in the cell of its nearest pivot, and is
   copied to another cell only if the boundary is within reach: for y in cell j
   and d(x, y) <= r the triangle inequality gives d(x, pj) <= d(x, pi) + 2 r; the
   distance of x to the plane halfway between two pivots gives a closer bound.
   A pair is joined in the cell of its member whose cell has the larger number.
3. These first pivots, of all labels together about ``MAX_PIVOTS / 2``, are the only ones that go to every task.
   A cell of more than ``SPLIT`` blocks (a label of more starts as one cell) is split by some ``FANOUT / 2`` pivots of
   its own, level by level, so cells stay small however many vectors there are.  Its rows are dealt over chunks, each
   of which gets the cell's pivots.  A first pass only counts what a split would copy: a cell is split where that
   leaves at most half of its comparisons.  A bit per level marks a copy that is away from home; a pair counts where
   no level has both members away, which is in exactly one cell.
4. Cells join independently, cut into blocks of at most ``BLOCK`` classes (four times as many in a cell that no pivots
   split, which quarters the copies of its rows); a hot cell is many block pairs in many tasks.  A block pair sends
   back how many vectors each class links with, and the edges of a spanning forest, never all pairs; counts are exact.
5. Components come from the forest edges.

Where no pivots separate a cell (vectors without cluster structure in many dimensions, or a ball of the radius), its
blocks are joined pair by pair: no link is lost, but the work grows with the square of that cell.

Edge cases: null, zero, empty or non-finite vectors and null labels link with
nothing; vectors may be floats, doubles or other numbers; vectors of different lengths never link; a null id links with nothing;
repeated rows are vectors like any other (rows with one id link through it);
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected_components

THRESHOLD = 0.93
PER_CELL = 1024
BLOCK = 2048
MAX_PIVOTS = 4096  # twice the number of first pivots to expect: the size bound of the table that goes to every task
SPLIT = 16  # a cell of more blocks is split again
FANOUT = 256  # twice the number of pivots to expect in a split
CHUNK = 4096  # rows that one task deals to the pivots of a cell
LEVELS = 60  # bits of the mask; every split leaves at most 0.71 of a cell's rows in one cell


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    arr = col.combine_chunks()
    arr = arr if isinstance(arr, pa.Array) else pa.concat_arrays(arr.chunks)
    x = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arr), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _forest(hit: np.ndarray, rows: np.ndarray, right: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join two parts so far, over all hits; ``part`` (a label per item) is updated."""
    edges = []
    for k in np.flatnonzero(hit.any(axis=1)):
        i, js = rows[k], right[hit[k]]
        labels, first = np.unique(part[js], return_index=True)
        other = labels != part[i]
        if other.any():
            edges += [(i, j) for j in js[first[other]]]
            part[np.isin(part, labels[other])] = part[i]
    return edges


LINKS = "class bigint, links bigint, a bigint, b bigint"


def _join(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        """One block pair: rows of side 0 against all rows of side 1, or one block against itself.  Rows out: (class, linked vectors) and forest edges (a, b) of ids."""
        x = _matrix(t["embedding"])
        cls, ids, size, away = (t[c].to_numpy() for c in ("class", "class_id", "size", "away"))
        side, own = t["side"].to_numpy(), t["own"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        diagonal = bool(own[0])
        if diagonal:
            right = left
        count, part, edges = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
        step = max(1, 2_000_000 // max(1, len(right)))
        for s in range(0, len(left), step):
            rows = left[s:s + step]
            hit = x[rows] @ x[right].T >= threshold
            if diagonal:
                hit &= np.arange(s, s + len(rows))[:, None] < np.arange(len(right))[None, :]
            # two copies that meet in a third cell do not count: at every level one member is at home
            hit &= (away[rows][:, None] & away[right][None, :]) == 0
            count[rows] += hit @ size[right]
            count[right] += size[rows] @ hit
            edges += _forest(hit, rows, right, part)
        some, k = np.flatnonzero(count), len(edges)
        none = lambda n: pa.nulls(n, pa.int64())
        ends = [pa.array(ids[[e[j] for e in edges]] if k else ids[:0], pa.int64()) for j in (0, 1)]
        return pa.table({"class": pa.concat_arrays([pa.array(cls[some], pa.int64()), none(k)]),
                         "links": pa.concat_arrays([pa.array(count[some], pa.int64()), none(k)]),
                         "a": pa.concat_arrays([none(len(some)), ends[0]]),
                         "b": pa.concat_arrays([none(len(some)), ends[1]])})
    return run


def _place(x: np.ndarray, p: np.ndarray | None, radius: float):
    """Unit vectors among pivots -> (row, cell, away): the home cell, and every higher-numbered cell within reach."""
    if p is None or len(p) < 2:
        return np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    between = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))
    step, out = max(1, 1_000_000 // len(p)), []
    for s in range(0, len(x), step):
        d = np.sqrt(np.maximum(2 - 2 * (x[s:s + step] @ p.T), 0))
        h = d.argmin(axis=1)
        near = d[np.arange(len(d)), h][:, None]
        reach = (d <= near + 2 * radius + 1e-9) & ((d * d - near * near) <= 2 * radius * between[h] + 1e-9)
        reach &= np.arange(len(p))[None, :] > h[:, None]  # a copy goes to higher cells only
        reach[np.arange(len(d)), h] = True
        i, j = np.nonzero(reach)
        out.append((i + s, j, j != h[i]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)


def _to_cells(pivots: dict, radius: float):
    """Rows with (cell, away) of the first level; a cell is named by its label and pivot."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                t = pa.Table.from_batches([batch.slice(at, 1024)])
                key = np.array(t["part"].to_pylist(), object)
                for part in sorted(set(key.tolist())):
                    mine = t.filter(pa.array(key == part))
                    i, j, away = _place(_matrix(mine["embedding"]), pivots.get(part), radius)
                    for s in range(0, len(i), 10_000):
                        rows = mine.take(pa.array(i[s:s + 10_000])).drop_columns("part")
                        rows = rows.append_column("cell", pa.array([f"{part}/{c}" for c in j[s:s + 10_000]], pa.string()))
                        rows = rows.append_column("away", pa.array(away[s:s + 10_000].astype(np.int64)))
                        yield from rows.combine_chunks().to_batches()
    return run


def _chunk_place(rows: pa.Table, pivots: pa.Table, radius: float):
    p = _matrix(pivots.sort_by("class")["embedding"]) if pivots.num_rows else None
    return _place(_matrix(rows["embedding"]), p, radius)


def _chunk_counts(radius: float):
    """One chunk of a cell and the cell's pivots -> (cell, sub, m): rows that each smaller cell would get."""
    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        sub, m = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if rows.num_rows:
            sub, m = np.unique(_chunk_place(rows, pivots, radius)[1], return_counts=True)
        name = rows["cell"][0].as_py() if rows.num_rows else ""
        return pa.table({"cell": pa.array([name] * len(sub), pa.string()), "sub": pa.array(sub, pa.int64()),
                         "m": pa.array(m, pa.int64())})
    return run


def _chunk_cells(radius: float, level: int, columns: list[str]):
    """The same chunk's rows in the smaller cells."""
    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        if rows.num_rows == 0:
            return rows.select(columns)
        i, j, away = _chunk_place(rows, pivots, radius)
        out = rows.take(pa.array(i))
        name = rows["cell"][0].as_py()
        mask = out["away"].to_numpy() | (away.astype(np.int64) << level)
        out = out.set_column(out.schema.get_field_index("cell"), "cell", pa.array([f"{name}/{c}" for c in j], pa.string()))
        return out.set_column(out.schema.get_field_index("away"), "away", pa.array(mask, pa.int64())).select(columns)
    return run


def refined(cells: DataFrame, radius: float, per_cell: int = PER_CELL, limit: int = SPLIT * BLOCK, fanout: int = FANOUT,
            chunk: int = CHUNK, seed: int = 5) -> tuple[DataFrame, int]:
    """(cells, levels of splits): every cell of more than ``limit`` rows split by pivots of its own, as long as a split
    at least halves its comparisons.  ``cells``: a stored table with class, embedding, cell and away."""
    done, todo, level, columns = [], cells, 0, cells.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields)
    while level < LEVELS:
        big = stored(todo.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit))
        if big.isEmpty():
            break
        level += 1
        chunks = F.ceil(F.col("n") / chunk).cast("int")
        share = F.least(F.lit(1 / per_cell), F.lit(fanout / 2) / F.col("n"))
        ticket = F.pmod(F.xxhash64(F.lit(seed + 16 * level), "class"), F.lit(1 << 32))
        within = todo.join(big, "cell")
        rows = within.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed + 16 * level + 1), "class"), chunks))
        pivots = stored(within.where(ticket < share * 2.0 ** 32).select("cell", "n", "class", "embedding"))
        dealt = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).select(
            "cell", F.col("chunk").cast("bigint").alias("chunk"), "class", "embedding").groupBy("cell", "chunk")
        rows = rows.select(*columns, F.col("chunk").cast("bigint").alias("chunk"))
        counts = rows.groupBy("cell", "chunk").cogroup(dealt).applyInArrow(_chunk_counts(radius), "cell string, sub bigint, m bigint")
        each = counts.groupBy("cell", "sub").agg(F.sum("m").cast("double").alias("m"))
        after = each.groupBy("cell").agg(F.sum(F.col("m") * F.col("m")).alias("pairs"))
        gain = stored(after.join(big, "cell").where(2 * F.col("pairs") <= F.col("n").cast("double") * F.col("n")).select("cell"))
        if gain.isEmpty():
            break
        done.append(todo.join(gain, "cell", "left_anti").select(*columns))
        todo = stored(rows.join(gain, "cell", "left_semi").groupBy("cell", "chunk").cogroup(dealt).applyInArrow(
            _chunk_cells(radius, level, columns), ddl))
    for part in done:
        todo = todo.unionByName(part)
    return todo, len(done)


def embedding_neardup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                      threshold: float = THRESHOLD, per_cell: int = PER_CELL, block: int = BLOCK,
                      seed: int = 5, max_pivots: int = MAX_PIVOTS, split: int = SPLIT, fanout: int = FANOUT,
                      chunk: int = CHUNK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"  # other numbers become doubles
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("embedding"),
                       F.col(label_col).alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    usable = (F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
              & F.coalesce(finite, F.lit(False)) & (norm > 0) & (norm < F.lit(float("inf"))))
    v = v.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # copies collapse: a class is one distinct vector of a label
    key = [F.concat_ws(":", F.size("embedding"), F.col("label").cast("string")).alias("part"), "embedding"]
    good = v.where("usable")
    # numbered once: the stored number identifies a class also where ids repeat
    classes = stored(good.groupBy(*key).agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("size"))
                     .withColumn("class", F.monotonically_increasing_id()))
    # first pivots: about one for per_cell classes, fewer when all labels together would pass the bound; a label of
    # more than split blocks starts as one cell, whose splits are counted before they are made
    labels = stored(classes.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= split * block))
    total = labels.agg(F.sum("n")).first()[0] or 0
    share = min(1 / per_cell, max_pivots / 2 / max(1, total))
    chosen = classes.where(F.pmod(F.xxhash64(F.lit(seed), "class_id"), F.lit(1 << 32)) < int(share * 2 ** 32))
    chosen = chosen.join(labels, "part", "left_semi")
    pivots: dict = {}
    for r in chosen.select("part", "class_id", "embedding").orderBy("part", "class_id").collect():
        x = np.array(r["embedding"], np.float64)
        pivots.setdefault(r["part"], []).append(x / np.sqrt((x * x).sum()))
    pivots = {k: np.array(p) for k, p in pivots.items()}
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    cells = classes.select("part", "class", "class_id", "size", "embedding").mapInArrow(
        _to_cells(pivots, radius), f"class bigint, class_id bigint, size bigint, embedding array<{kind}>, cell string, away bigint")
    cells, _ = refined(stored(cells), radius, per_cell, split * block, fanout, chunk, seed)
    n = F.col("n")
    blocks = F.ceil(n / F.when(n > split * block, 4 * block).otherwise(block)).cast("int")
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", blocks.alias("blocks"))
    placed = cells.join(sizes, "cell")
    placed = placed.withColumn("mine", F.pmod(F.xxhash64(F.lit(seed + 1), "class"), F.col("blocks")).cast("int"))
    # each row goes to the pairs (mine, other) for all blocks of its cell
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("cell", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"),
                         (F.col("mine") > F.col("other")).cast("int").alias("side"),
                         (F.col("mine") == F.col("other")).alias("own"), "class", "class_id", "size", "away", "embedding")
    links = stored(pairs.groupBy("cell", "p", "q").applyInArrow(_join(threshold), LINKS))
    counts = links.where("class is not null").groupBy("class").agg(F.sum("links").alias("links"))
    comp = connected_components(links.where("b is not null").select("a", "b"))
    known = (classes.join(counts, "class", "left").join(comp.withColumnRenamed("id", "class_id"), "class_id", "left")
             .select("part", "embedding", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
                     F.coalesce("component", "class_id").alias("component_id")))
    member = good.select("vec_id", key[0], "embedding")
    linked = member.join(stored(known), ["part", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = v.where("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"),
                                        F.col("vec_id").alias("component_id"))
    out = linked.unionByName(rest)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
