"""N-gram Jaccard join by a prefix tree.

A document's set: its distinct ``GRAM``-word shingles (A-Z lower-cased; with fewer
words the whole sequence is the one shingle).  Two documents link when
100 * intersection >= PERCENT * union.

1. Equal sets collapse: one class per set (128-bit sum of its shingle hashes),
   represented by its smallest id.
2. A packed blockwise count (``blocks.py``) tells every class which of its
   shingles occur in another class.  A partner must share at least PERCENT of
   the set, so classes with too few shared shingles are settled; shingles that
   occur once never overlap and are dropped (the set keeps its true size).
   The rest is counted once more, exactly, among the classes left.
3. The sets left are globally ordered, rarest shingle first.  Two linked sets
   share a shingle in their prefixes.  The members of a prefix shingle are first
   joined with one centre of theirs; groups that are one component then are done.
   Groups that are not are merged where they share members and joined block by
   block, whole, however large.
4. Every join stores one side's ordered sets in a prefix tree and traverses it
   with each set of the other side: sets that begin alike share the partial
   overlap, and a subtree is left when the shorter remainder cannot reach the
   required overlap or its sizes cannot match.  Only links that join two parts
   of a forest leave a task; no pairs are emitted.

Edge cases: no words or null text: an empty set, linked with nothing; a null id
is a document of its own (numbered above all ids) whose component is the smallest
id in it, null if no row of the component has an id; rows that share an id are one document for components (``one_of_each`` judges them one by one); a text of
any length gives all its shingles; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import stored
from .components import connected_components
from .repeated import filter_bits
from .words import LOWER, joined, mix, rolling, word_hashes, word_spans

U = np.uint64
GRAM, PERCENT = 4, 85
BLOCK = 384
TEXT_BLOCK_BYTES = 2 << 20  # a block's shingle sets are held at once


def shingle_sets(texts, gram: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    buf, off = joined(texts)
    buf = LOWER[buf]
    start, end, row = word_spans(buf, off)
    h = word_hashes(buf, start, end, 9)
    idx, g = rolling(h, row, gram)
    n = len(off) - 1
    cut = np.searchsorted(row[idx], np.arange(n + 1))
    words = np.searchsorted(row, np.arange(n + 1))
    out = []
    for i in range(n):
        k = words[i + 1] - words[i]
        if 0 < k < gram:
            _, one = rolling(h[words[i]:words[i + 1]], np.zeros(k, np.int64), int(k))
            out.append(mix(one ^ U(k)))
        else:
            out.append(np.unique(g[cut[i]:cut[i + 1]]))
    return out


def set_key(s: np.ndarray) -> bytes:
    """128 bits that depend on the set alone."""
    a, b = mix(s ^ U(0x5851F42D4C957F2D)), mix(s ^ U(0x14057B7EF767814F))
    return int(a.sum(dtype=U)).to_bytes(8, "little") + int(b.sum(dtype=U)).to_bytes(8, "little")


def _signatures(docs: DataFrame, id_col: str, text_col: str, gram: int) -> DataFrame:
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(part.column(1), gram)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())],
                    ["doc_id", "n_shingles", "key"])

    return src.mapInArrow(run, "doc_id bigint, n_shingles bigint, key binary")


class _Sets:
    """The sets of the class representatives in a block, concatenated."""

    def __init__(self, texts: pa.Table, said: pa.Table, gram: int):
        self.block = texts["block"][0].as_py()
        t = B.read_block(texts)
        reps = {b for k, b in zip(said["kind"].to_pylist(), said["bits"].to_pylist()) if k == 0}
        ids = {int(b[16:]) for b in reps}
        t = t.filter(pa.array([i in ids for i in t["doc_id"].to_pylist()], pa.bool_()))
        self.ids, self.sets, self.keys = [], [], []
        for i, s in zip(t["doc_id"].to_pylist(), shingle_sets(t["text"], gram) if len(t) else []):
            key = set_key(s)
            if len(s) and key + str(i).encode() in reps:
                reps.discard(key + str(i).encode())  # repeated rows count once
                self.ids.append(i), self.sets.append(s), self.keys.append(key)
        self.h = np.concatenate(self.sets) if self.sets else np.zeros(0, U)
        self.owner = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])


def _ask(gram, bits, buckets):
    def run(texts, said):
        if texts.num_rows == 0:
            return B.ask_rows(0, np.zeros(0, U), bits, buckets)
        x = _Sets(texts, said, gram)
        return B.ask_rows(x.block, B.distinct(x.h, bits)[0], bits, buckets)
    return run


KEPT = "key binary, rep bigint, n bigint, token bigint"


def _keep(gram, percent, bits, buckets):
    """(key, rep, n, token) of the shared shingles of every class that can have a partner."""
    def run(texts, said):
        rows = ([], [], [], [])
        if texts.num_rows:
            x = _Sets(texts, said, gram)
            v, inv = B.distinct(x.h, bits)
            lo, hi = B.first_last(inv, len(v), x.owner)
            shared = (B.read_answer(said, 1, v, bits, buckets) | (lo != hi))[inv]
            at = 0
            for i, s, key in zip(x.ids, x.sets, x.keys):
                tok = s[shared[at:at + len(s)]]
                at += len(s)
                if 100 * len(tok) >= percent * len(s):
                    rows[0].extend([key] * len(tok)), rows[1].extend([i] * len(tok)), rows[2].extend([len(s)] * len(tok))
                    rows[3].append(tok.view(np.int64))
        tok = np.concatenate(rows[3]) if rows[3] else np.zeros(0, np.int64)
        return pa.table({"key": pa.array(rows[0], pa.binary()), "rep": pa.array(rows[1], pa.int64()),
                         "n": pa.array(rows[2], pa.int64()), "token": pa.array(tok, pa.int64())})
    return run


# ---- prefix tree -------------------------------------------------------------------

class Trie:
    """Prefix tree of ordered sets.  A node: (run of ranks, ends here, children, least and
    largest true size below, longest remainder after the run)."""

    def __init__(self, sets: list[list[int]], sizes: list[int]):
        order = sorted(range(len(sets)), key=sets.__getitem__)
        seq, size = [sets[i] for i in order], [sizes[i] for i in order]
        self.nodes, self.roots = [], []
        todo = [(0, len(seq), 0, self.roots, [])]
        while todo:
            lo, hi, depth, children, ends = todo.pop()
            while lo < hi and len(seq[lo]) == depth:
                ends.append(order[lo])
                lo += 1
            while lo < hi:
                first, b = seq[lo][depth], lo + 1
                while b < hi and seq[b][depth] == first:
                    b += 1
                x, y = seq[lo], seq[b - 1]  # sorted: what the first and last share, all share
                d, top = depth + 1, min(len(x), len(y))
                while d < top and x[d] == y[d]:
                    d += 1
                node = (x[depth:d], [], [], min(size[lo:b]), max(size[lo:b]), max(map(len, seq[lo:b])) - d)
                children.append(len(self.nodes))
                self.nodes.append(node)
                todo.append((lo, b, d, node[2], node[1]))
                lo = b

    def partners(self, xs: list[int], nx: int, percent: int):
        """(set, overlap) for all stored sets that reach the overlap that their size asks for."""
        small, large, n = -(-percent * nx // 100), 100 * nx // percent, len(xs)
        todo = [(c, 0, 0) for c in self.roots]
        while todo:
            c, i, got = todo.pop()
            run, ends, children, least, most, tail = self.nodes[c]
            if least > large or most < small:
                continue
            need = -(-percent * (nx + max(least, small)) // (100 + percent))
            left = len(run) + tail
            for r in run:
                while i < n and xs[i] < r:
                    i += 1
                left -= 1
                if i < n and xs[i] == r:
                    i += 1
                    got += 1
                if got + min(n - i, left) < need:
                    break
            else:
                for e in ends:
                    yield e, got
                for k in children:
                    todo.append((k, i, got))


def _ranked(t: pa.Table) -> list[list[int]]:
    """The ordered sets of a group as ranks in one order of all their shingles."""
    tok, df = t["tokens"].combine_chunks(), t["dfs"].combine_chunks()
    flat, d = tok.flatten().to_numpy(), df.flatten().to_numpy()
    if len(flat) == 0:
        return [[] for _ in range(len(t))]
    order = np.lexsort((flat, d))
    s, e = flat[order], d[order]
    step = np.ones(len(s), np.int64)
    step[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    rank = np.empty(len(s), np.int64)
    rank[order] = np.cumsum(step)
    off = tok.offsets.to_numpy() - tok.offsets[0].as_py()
    return [sorted(rank[a:b].tolist()) for a, b in zip(off[:-1], off[1:])]


def _linked(percent: int):
    """Links of a group: sets of side 0 traverse the tree of side 1, or of their own
    block; sets known to be one component (``comp``) are not linked again."""
    def run(t: pa.Table) -> pa.Table:
        sets, size, rep = _ranked(t), t["n"].to_pylist(), t["rep"].to_pylist()
        comp, side = t["comp"].to_pylist(), t["side"].to_pylist()
        left = [i for i, s in enumerate(side) if s == 0]
        own = bool(t["own"][0].as_py())
        right = left if own else [i for i, s in enumerate(side) if s == 1]
        up: dict = {}

        def find(c):
            while up.get(c, c) != c:
                up[c] = up.get(up[c], up[c])
                c = up[c]
            return c

        tree, a, b = Trie([sets[i] for i in right], [size[i] for i in right]), [], []
        for i in left:
            for k, got in tree.partners(sets[i], size[i], percent):
                j = right[k]
                if 100 * got >= percent * (size[i] + size[j] - got):
                    x, y = find(comp[i]), find(comp[j])
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        a.append(rep[i]), b.append(rep[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


LINKS = "a bigint, b bigint"
_SET = ["key", "rep", "n", "tokens", "dfs"]


def _star_links(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Tests the pairs (centre, key): groups by centre, in blocks of members."""
    stars = stored(stars)
    many = stored(stars.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    members = (stars.join(many, "centre").join(sets, "key")
               .withColumn("q", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
               .select("centre", "q", F.lit(1).alias("side"), *_SET))
    centres = (many.join(sets.withColumnRenamed("key", "centre"), "centre")
               .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .select("centre", "q", F.lit(0).alias("side"), F.col("centre").alias("key"), *_SET[1:]))
    both = members.unionByName(centres).withColumns({"comp": F.col("rep"), "own": F.lit(False)})
    return both.groupBy("centre", "q").applyInArrow(_linked(percent), LINKS)


def _block_links(members: DataFrame, percent: int) -> DataFrame:
    """``members``: sets with comp and group.  Every pair of blocks of a group is joined once."""
    many = stored(members.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    m = members.join(many, "group").withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("group", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"),
                 (F.col("mine") > F.col("other")).cast("int").alias("side"),
                 (F.col("mine") == F.col("other")).alias("own"), "comp", *_SET)
    return m.groupBy("group", "p", "q").applyInArrow(_linked(percent), LINKS)


def numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, int | None]:
    """``docs`` where rows without an id have numbers above all ids, and the largest id; (docs,
    None) where every row has one."""
    given = F.col(id_col).cast("bigint")
    top, rows, named = docs.agg(F.max(given), F.count(F.lit(1)), F.count(given)).first()
    if rows == named:
        return docs, None
    top = -1 if top is None else top
    number = F.lit(top).cast("bigint") + 1 + F.monotonically_increasing_id()
    lone = stored(docs.where(given.isNull()).withColumn(id_col, number))  # numbered once
    return docs.where(given.isNotNull()).withColumn(id_col, given).unionByName(lone), top


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` of which one of each group of near duplicates stays: the one of smallest id, a row
    without an id only where no other has one.  Every row is judged by itself, also rows that share an id."""
    given = F.col(id_col).cast("bigint")
    shared = stored(docs.select(given.alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n")).where("i is null or n > 1"))
    number = "__row"
    while number in docs.columns:
        number = "_" + number
    if shared.isEmpty():
        groups = ngram_jaccard(docs, id_col, text_col, **options)
        gone = stored(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(number)))
        return docs.join(gone, given == gone[number], "left_anti")
    top = docs.agg(F.coalesce(F.max(given), F.lit(-1))).first()[0]
    # rows that an id does not tell apart get numbers above all ids, once
    mark = F.broadcast(shared) if shared.count() < 10_000 else shared
    lone = docs.join(mark, given.eqNullSafe(shared["i"]), "left_semi")
    lone = stored(lone.withColumn(number, F.lit(top).cast("bigint") + 1 + F.monotonically_increasing_id()))
    rows = docs.join(mark, given.eqNullSafe(shared["i"]), "left_anti").withColumn(number, given).unionByName(lone)
    groups = stored(ngram_jaccard(rows.select(number, text_col), number, text_col, **options).select(
        F.col("doc_id").alias("row"), F.col("component_id").alias("group")))
    linked = groups.join(groups.where("row <> group").select("group").distinct(), "group")
    ids = lone.select(F.col(number).alias("row"), given.alias("i"), F.lit(True).alias("renumbered"))
    linked = linked.join(ids, "row", "left").withColumn("i", F.when(F.col("renumbered"), F.col("i")).otherwise(F.col("row")))
    linked = stored(linked.select("row", "group", F.struct(F.col("i").isNull().alias("none"), "i", "row").alias("order")))
    first = linked.groupBy("group").agg(F.min("order").alias("first"))
    gone = stored(linked.join(first, "group").where("order <> first").select(F.col("row").alias(number)))
    return rows.join(gone, number, "left_anti").select(*docs.columns)


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM,
                  percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    docs, top = numbered(docs.select(id_col, text_col), id_col)
    sig = stored(_signatures(docs, id_col, text_col, gram))
    classes = stored(sig.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep")))
    layout = B.Layout(docs, id_col, text_col, min(B.BLOCK_BYTES, TEXT_BLOCK_BYTES))
    bits, buckets = filter_bits(layout.total_bytes), layout.buckets
    texts = B.text_blocks(docs, layout, id_col, text_col)
    reps = classes.select(
        layout.block(F.col("rep")).alias("block"), F.lit(0).alias("kind"), F.lit(0).alias("bucket"),
        F.concat("key", F.encode(F.col("rep").cast("string"), "utf-8")).alias("bits"))

    def pass_over(said, run, out):
        return texts.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(run, out)

    shared = B.answers(pass_over(reps, _ask(gram, bits, buckets), B.ASK), 1, earlier=False)
    kept = stored(pass_over(reps.unionByName(shared), _keep(gram, percent, bits, buckets), KEPT))
    # the same bound once more with exact counts among the classes left, which also order the shingles
    df = stored(kept.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    sets = (kept.join(df, "token").groupBy("key", "rep", "n")
            .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("s"))
            .where(F.size("s") * 100 >= F.col("n") * percent)
            .select("key", "rep", "n", F.col("s.token").alias("tokens"), F.col("s.df").alias("dfs")))
    sets = stored(sets)
    need = F.floor((F.col("n") * percent + 99) / 100).cast("int")
    prefix = F.slice("tokens", F.lit(1), F.greatest(F.size("tokens") - need + 1, F.lit(0)))
    postings = stored(sets.select("key", "rep", "n", F.explode(prefix).alias("token")))
    centre = stored(postings.groupBy("token").agg(
        F.min(F.struct("rep", "key", "n")).alias("c"), F.count(F.lit(1)).alias("members")).where("members > 1")
        .select("token", F.col("c.key").alias("centre"), F.col("c.rep").alias("centre_rep"), F.col("c.n").alias("centre_n"),
                "members"))
    close = F.least("n", "centre_n") * 100 >= F.greatest("n", "centre_n") * percent
    stars = postings.join(centre, "token").where((F.col("key") != F.col("centre")) & close).select("centre", "key").distinct()
    links = stored(_star_links(stars, sets, percent))
    comp = stored(connected_components(links))
    # prefix groups that are still several components
    named = sets.select("key", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key", F.coalesce("component", "rep").alias("comp"))
    named = stored(named)
    open_tokens = (postings.join(centre.where("members > 2").select("token"), "token").join(named, "key")
                   .groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
                   .select("token"))
    open_tokens = stored(open_tokens)
    ties = postings.join(open_tokens, "token").join(centre.select("token", "centre_rep"), "token").select(
        F.col("centre_rep").alias("a"), F.col("rep").alias("b")).distinct()
    ties = stored(ties)
    groups = connected_components(ties).select(F.col("id").alias("rep"), F.col("component").alias("group"))
    members = sets.join(groups, "rep").join(named, "key").select("group", "comp", *_SET)
    late = stored(_block_links(stored(members), percent))
    final = connected_components(links.unionByName(late))
    known = stored(classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key", F.coalesce("component", "rep").alias("component_id")))
    full = sig.where("n_shingles > 0").join(known, "key").select("doc_id", "n_shingles", "component_id")
    empty = sig.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = full.unionByName(empty)
    if top is None:
        return out
    return out.withColumns({c: F.when(F.col(c) <= top, F.col(c)) for c in ("doc_id", "component_id")})
