"""Spelling variants against plain Python."""

import itertools
import random
import re
import zlib
from collections import Counter

from dataclinic.llm import spelling_variants as S


def edits(a, b):
    """Plain edit distance (insert, delete, replace), enough to tell exactly one."""
    if abs(len(a) - len(b)) > 1:
        return 9
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute_words(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute(docs):
    n = brute_words(docs)
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if edits(a, b) == 1:
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def corpus(n=160, seed=4):
    r = random.Random(seed)
    letters = "etaoinshréÉ×"
    stems = ["".join(r.choice(letters) for _ in range(r.randint(4, 9))) for _ in range(40)]
    vocab = list(stems)
    for s in stems:
        for _ in range(4):
            k = r.randrange(len(s))
            vocab.append(r.choice([s[:k] + s[k + 1:], s[:k] + r.choice(letters) + s[k:], s[:k] + r.choice(letters) + s[k + 1:]]))
    vocab += ["Hello", "HELLO", "hellø", "naïveté", "İstanbul", "it's", "Ã©tés", "straße"]
    docs = [(i, " ".join(r.choice(vocab[:1 + r.randrange(len(vocab))]) for _ in range(r.choice([0, 5, 60])))) for i in range(n)]
    docs += [(3, docs[5][1]), (3, docs[5][1]), (None, docs[6][1]), (None, docs[6][1]), (900, None), (901, ""),
             (902, "verylong" * 4000 + " " + ("abcdefgh " * 3000))]
    docs += [(910 + i, "chainone " * 3 + "chainones " * 7 + "chainsones " * 20) for i in range(2)]
    return docs


def got(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


def test_matches_brute_force(spark, as_docs):
    docs = corpus()
    want = brute(docs)
    df = as_docs(docs)
    for size in (8192, 20, 3):  # smaller nodes: deep cuts, visitors, letter levels
        assert got(S.spelling_variants(df, node_words=size)) == want
    assert sum(x[1] is not None for x in want) > 15 and any(x[2] not in (x[0], x[1]) for x in want)
    assert S.spelling_variants(df.limit(0)).count() == 0
    assert S.spelling_variants(as_docs([(1, "too short for it"), (2, None)])).count() == 0


def test_anagrams_beyond_a_node(spark):
    words = ["".join(p) for p in itertools.permutations("abcde")] + ["abcd" + c for c in "fgh"] + ["abcdee", "bacdeé"]
    df = spark.createDataFrame([(w, 3 + k) for k, w in enumerate(words)], "word string, n bigint")
    nodes = S.cut_trie(df, 16)
    assert max(k for _, k in nodes) > 1  # anagrams cut by hash
    found = {x["word"]: (x["n_near"], x["form"]) for x in S.near_words(df, 16).collect()}
    n = {w: 3 + k for k, w in enumerate(words)}
    for w in words:
        near = [x for x in words if edits(x, w) == 1]
        assert found.get(w, (0, None)) == (len(near), min(near, key=lambda x: (-n[x], x), default=None))


def test_halves_find_every_pair():
    r = random.Random(8)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 6))) for _ in range(90)})
    want = {(a, b) for a in words for b in words if edits(a, b) == 1}
    assert set(S.near_pairs(words, words)) == want == {(a, b) for a in words for b in words if S.near(a, b)}


def test_node_groups_stay_bounded(spark):
    r = random.Random(2)
    words = sorted({"".join(r.choice("etaoinshrdlu") for _ in range(8)) for _ in range(4000)})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n bigint")
    nodes = S.cut_trie(df, 256)
    rows = df.mapInArrow(S._route(nodes), "node int, part int, home boolean, word string, n bigint")
    sizes = [(x["h"], x["v"]) for x in rows.groupBy("node").agg({"home": "count"}).selectExpr("`count(home)` h", "0 v").collect()]
    home = [x["count"] for x in rows.where("home").groupBy("node").count().collect()]
    assert max(home) <= 256 and sum(home) == len(words) and sizes
