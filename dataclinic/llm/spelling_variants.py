"""Spelling variant grouping with a trie over letter-count vectors.

Words are counted over the whole corpus.  A word's *frequency vector* holds how many of its letters fall in each of
``GROUPS`` letter groups, followed by the count of each single letter.  Words that differ by one inserted, deleted or
replaced code point have vectors that differ by a surplus of at most one and a deficit of at most one, so near words lie
a short walk apart in a trie whose levels are the successive counts: a depth-first search carries one unit of surplus and
one of deficit, and the words of the leaves that it reaches are compared letter by letter.

The trie is cut for Spark: a node with more than ``NODE_WORDS`` words is split by the next count (one aggregation per
level, over the words of such nodes only), so a task holds a subtree of bounded size.  A word lives in its node and
visits the later nodes within its budget; a pair so meets once.  A node is split past the groups by single letters; words
of one full vector are anagrams, which are never near, and a node of more of them than fit is cut by hash.

Every pair found gives each of its words a count and a candidate for its form; these are summed, never listed.  Forms
are followed to the root by pointer doubling: n at least doubles on each step, so chains are short.

Edge cases: a null or empty text has no word; a null id reads as the empty string in the hashed key; repeated rows count
again; a text of any length is read whole, a word of any length is kept; ties take the smaller form; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: What a word is (A-Z are lower-cased before), and which occurrences lose a code point.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
NOISE = 97
MIN_LENGTH, MIN_COUNT, FACTOR = 5, 3, 2

GROUPS = 12
LETTERS = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
DEPTH = GROUPS + len(LETTERS)
NODE_WORDS = 8192
_GROUP = {c: ord(c) % GROUPS for c in LETTERS}
_FLUSH = 200_000


# -- words ---------------------------------------------------------------------------------------

def document_words(key: bytes, text: bytes) -> Counter:
    """Counts of the words of one document (``key``: its id in decimal and a colon)."""
    out: Counter = Counter()
    seed = zlib.crc32(key)
    for run, n in Counter(m.group() for m in RUN.finditer(text.lower())).items():  # bytes.lower: A-Z only
        h = zlib.crc32(run, seed)
        if h % NOISE == 0:
            s = run.decode()
            at = h % len(s)
            run = (s[:at] + s[at + 1:]).encode()
        if len(run) - run.count(b"\xc3") >= MIN_LENGTH:
            out[run] += n
    return out


def _count(batches):
    total: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()),
                                           pa.array(list(total.values()), pa.int64())], ["word", "n"])
    for b in batches:
        ids, texts = b.column("doc_id").to_pylist(), b.column("text")
        for at, i in enumerate(ids):
            raw = texts[at].as_py()
            if raw:
                total.update(document_words(f"{'' if i is None else i}:".encode(), raw))
            if len(total) > _FLUSH:
                yield rows()
                total.clear()
    if total:
        yield rows()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of every word that occurs often enough."""
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return (src.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= MIN_COUNT))


# -- frequency vectors and the cut trie ----------------------------------------------------------

def vector(word: str, depth: int = GROUPS) -> tuple[int, ...]:
    """The first ``depth`` counts: letter groups, then single letters."""
    v = [0] * GROUPS
    for c in word:
        v[_GROUP[c]] += 1
    if depth > GROUPS:
        n = Counter(word)
        v += [n[c] for c in LETTERS[:depth - GROUPS]]
    return tuple(v[:depth])


def _budget(level: int, more: int, less: int) -> tuple[int, int]:
    """Groups and single letters are two vectors: each has its own surplus and deficit."""
    return (1, 1) if level == GROUPS else (more, less)


def reach(trie: dict, vec, start: int = 0):
    """Leaves of a nested dict of counts that ``vec`` reaches: depth-first, one surplus, one deficit."""
    todo = [(trie, start, 1, 1)]
    while todo:
        node, level, more, less = todo.pop()
        if not isinstance(node, dict):
            yield node
            continue
        more, less = _budget(level, more, less)
        v = vec[level]
        child = node.get(v)
        if child is not None:
            todo.append((child, level + 1, more, less))
        if more:
            child = node.get(v - 1)
            if child is not None:
                todo.append((child, level + 1, 0, less))
        if less:
            child = node.get(v + 1)
            if child is not None:
                todo.append((child, level + 1, more, 0))


def insert(trie: dict, vec, leaf):
    for v in vec[:-1]:
        trie = trie.setdefault(v, {})
    return trie.setdefault(vec[-1], leaf)


def _prefix(depth: int):
    def run(batches):
        for b in batches:
            words = b.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([list(vector(w, depth)) for w in words], pa.list_(pa.int32()))], ["p"])
    return run


def cut_trie(words: DataFrame, node_words: int = NODE_WORDS) -> list[tuple[tuple[int, ...], int]]:
    """Prefixes of the trie that no word leaves uncovered, each with the number of parts that its words are cut into (1
    but for anagrams beyond ``node_words``), in prefix order.  At most a few rows per ``node_words`` words."""
    done, todo, depth = [], None, 0
    while True:
        depth += 1
        part = words.select("word")
        if todo is not None:
            parents = {p for p in todo}

            def inside(batches, parents=parents, depth=depth - 1):
                for b in batches:
                    w = b.column("word").to_pylist()
                    yield b.filter(pa.array([vector(x, depth) in parents for x in w], pa.bool_()))
            part = part.mapInArrow(inside, "word string")
        rows = part.mapInArrow(_prefix(depth), "p array<int>").groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()
        todo = []
        for r in rows:
            p = tuple(r["p"])
            if r["n"] <= node_words or depth == DEPTH:
                done.append((p, math.ceil(r["n"] / node_words)))
            else:
                todo.append(p)
        if not todo:
            return sorted(done)


# -- near words ----------------------------------------------------------------------------------

def near(a: str, b: str) -> bool:
    """Differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    return a[at + 1:] == b[at + 1:] if len(a) == len(b) else a[at:] == b[at + 1:]


def near_pairs(left: list[str], right: list[str]):
    """Near pairs of two leaves.  Near words share their first or their last h code points, h half the length of the
    shorter, so larger leaves meet by those halves."""
    if len(left) * len(right) <= 64:
        yield from ((a, b) for a in left for b in right if near(a, b))
        return
    by_size: dict = {}
    for b in right:
        by_size.setdefault(len(b), []).append(b)
    halves: dict = {}

    def index(size, h):  # right words of a size by first and last h code points
        if (size, h) not in halves:
            d: dict = {}
            for b in by_size[size]:
                d.setdefault((0, b[:h]), []).append(b)
                d.setdefault((1, b[-h:] if h else ""), []).append(b)
            halves[size, h] = d
        return halves[size, h]

    for a in left:
        for size in (len(a) - 1, len(a), len(a) + 1):
            if size in by_size:
                h = min(len(a), size) // 2
                d = index(size, h)
                for b in {*d.get((0, a[:h]), ()), *d.get((1, a[-h:] if h else ""), ())}:
                    if near(a, b):
                        yield a, b


FOUND = "word string, n_near bigint, best bigint, form string"


def _match(depths: list[int]):
    def run(t: pa.Table) -> pa.Table:
        """One node: pairs of its words, and of its words with visitors."""
        depth = max(GROUPS, depths[t["node"][0].as_py()])
        words, ns, home = t["word"].to_pylist(), t["n"].to_pylist(), t["home"].to_pylist()
        count = dict(zip(words, ns))
        vectors: dict = {}
        for w, h in zip(words, home):
            vectors.setdefault(vector(w, depth), ([], []))[0 if h else 1].append(w)
        trie: dict = {}
        for v, (own, _) in vectors.items():
            if own:
                insert(trie, v, (v, own))
        found: dict = {}

        def note(a, b):
            n, best = found.get(a, (0, None))
            mine = (-count[b], b)
            found[a] = (n + 1, mine if best is None or mine < best else best)

        for v, (own, visitors) in vectors.items():
            for u, other in reach(trie, v):
                if visitors:
                    for a, b in near_pairs(visitors, other):
                        note(a, b), note(b, a)
                if own and u >= v:  # a leaf meets itself once and each later leaf once
                    for a, b in near_pairs(own, other):
                        if u > v or a < b:
                            note(a, b), note(b, a)
        rows = [(w, n, -best[0], best[1]) for w, (n, best) in found.items()]
        cols = list(zip(*rows)) if rows else [[]] * 4
        return pa.table({"word": pa.array(cols[0], pa.string()), "n_near": pa.array(cols[1], pa.int64()),
                         "best": pa.array(cols[2], pa.int64()), "form": pa.array(cols[3], pa.string())})
    return run


def _route(nodes: list[tuple[tuple[int, ...], int]]):
    """Rows (node, part, home, word, n): a word in its own node, and as a visitor in later nodes."""
    def run(batches):
        trie: dict = {}
        for k, (p, _) in enumerate(nodes):
            insert(trie, p, k)
        deepest = max(GROUPS, max(len(p) for p, _ in nodes))
        for b in batches:
            out = []
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
                v = vector(w, deepest)
                reached = list(reach(trie, v))
                own = next(k for k in reached if nodes[k][0] == v[:len(nodes[k][0])])
                out.append((own, zlib.crc32(w.encode()) % nodes[own][1], True, w, n))
                out += [(k, part, False, w, n) for k in reached if k > own for part in range(nodes[k][1])]
            cols = list(zip(*out)) if out else [[]] * 5
            for at in range(0, len(out), 20_000):
                c = [x[at:at + 20_000] for x in cols]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.bool_()),
                     pa.array(c[3], pa.string()), pa.array(c[4], pa.int64())], ["node", "part", "home", "word", "n"])
    return run


def near_words(words: DataFrame, node_words: int = NODE_WORDS) -> DataFrame:
    """(word, n) -> (word, n_near, best, form): number of near words, and the near word of largest n (ties: smallest)
    with its n, for every word that has any."""
    nodes = cut_trie(words, node_words)
    if not nodes:
        return words.sparkSession.createDataFrame([], FOUND)
    # a word has few nodes to visit, so a task's batch of words stays small
    rows = words.select("word", "n").mapInArrow(_route(nodes), "node int, part int, home boolean, word string, n bigint")
    found = rows.groupBy("node", "part").applyInArrow(_match([len(p) for p, _ in nodes]), FOUND)
    top = F.min(F.struct((-F.col("best")).alias("m"), F.col("form").alias("form"))).alias("top")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top).select(
        "word", "n_near", (-F.col("top.m")).alias("best"), F.col("top.form").alias("form"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = FACTOR,
                      node_words: int = NODE_WORDS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = stored(vocabulary(docs, id_col, text_col))
    found = near_words(words, node_words)
    named = F.col("best") >= factor * F.col("n")
    table = stored(words.join(found, "word", "left").select(
        "word", F.when(named, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(named, F.col("best")).alias("form_n")))
    # pointer doubling; n grows by the factor on each step, so a chain has at most log(largest n) steps
    most = table.agg(F.max("n")).first()[0] or 1
    steps = math.ceil(math.log(max(2, most), max(factor, 1 + 1e-9)))
    jump = table.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(max(2, steps))))):
        up = jump.select(F.col("word").alias("root"), F.col("root").alias("top"))
        jump = stored(jump.join(up, "root", "left").select("word", F.coalesce("top", "root").alias("root")))
    return table.join(jump, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
