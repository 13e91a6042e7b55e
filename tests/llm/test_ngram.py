"""N-gram Jaccard join against brute force."""

import random
import re
import string

from dataclinic.llm import blocks as B
from dataclinic.llm import ngram_jaccard as N

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(t, g=4):
    w = re.findall("[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return {tuple(w)} if 0 < len(w) < g else {tuple(w[i:i + g]) for i in range(len(w) - g + 1)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                up[find(i)] = find(j)
    comp = {}
    for i, (d, _) in enumerate(rows):
        comp.setdefault(find(i), []).append(d)
    return sorted((d, len(s), min(comp[find(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, n):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(40)] + ["É", "A", "a"]
    text = lambda k: [r.choice(vocab) for _ in range(k)]
    common, rows = [text(30) for _ in range(3)], []
    bases = [text(r.choice([5, 20, 60, 120])) for _ in range(12)]
    for i in range(n):
        w = list(r.choice(bases))
        if r.random() < 0.3:  # mostly shared passages, put together differently
            w = sum(r.sample(common, r.choice([1, 2, 3])), []) + text(r.choice([0, 2, 6]))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i * 3, r.choice([" ", "\n"]).join(w)))
    return rows + [(9000, None), (9001, ""), (9002, "One two"), (9003, "one TWO"), (9004, "one two three four"),
                   (9005, " \t"), (9006, rows[0][1]), (9007, rows[0][1].upper())]


def test_matches_brute_force(as_docs, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_BYTES", 6000)
    monkeypatch.setattr(N, "BLOCK", 8)
    for seed, n in ((1, 150), (2, 60)):
        rows = corpus(seed, n)
        got = sorted(tuple(x) for x in N.ngram_jaccard(as_docs(rows)).collect())
        assert got == brute(rows)


def test_edges(as_docs):
    assert N.ngram_jaccard(as_docs([])).count() == 0
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "q r s t"), (2, "A b  c d\te")]
    got = sorted((tuple(x) for x in N.ngram_jaccard(as_docs(rows)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 1, None), (2, 2, 1)], key=str)


def test_trie_finds_all_partners():
    r = random.Random(7)
    for _ in range(60):
        sets = [sorted(r.sample(range(14), r.randrange(0, 12))) for _ in range(25)]
        sizes = [len(s) + r.randrange(2) for s in sets]
        tree = N.Trie(sets, sizes)
        for xs, nx in zip(sets, sizes):
            if not nx:
                continue
            ok = lambda k, g: 100 * g >= 85 * (nx + sizes[k] - g)
            want = {k for k, s in enumerate(sets) if s and ok(k, len(set(s) & set(xs)))}
            assert {k for k, g in tree.partners(xs, nx, 85) if ok(k, g)} == want


def test_rows_without_an_id_link(as_docs):
    w = ["w%d" % i for i in range(100)]
    a, b, c = w, w[:94] + list("uvwxyz"), w[:90] + list("klmn") + list("uvwxyz")
    rows = [(1, a), (None, b), (2, c), (None, ["q"] * 9), (None, w[::-1]), (None, w[:0:-1]), (None, [])]
    rows = [(i, " ".join(t)) for i, t in rows]
    ids = [1, 10, 2, 11, 12, 13, 14]
    back = lambda i: i if i < 10 else None
    want = [(back(i), n, back(c)) for i, n, c in brute([(i, t) for i, (_, t) in zip(ids, rows)])]
    assert (2, 97, 1) in want  # by the row without an id only
    got = [tuple(x) for x in N.ngram_jaccard(as_docs(rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_very_long_texts_link(as_docs):
    w = [f"w{i * 7919 % 100_003}" for i in range(60_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:30_000] + ["x"] + w[30_000:])), (3, " ".join(w[:20_000])), (4, "a b c")]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in N.ngram_jaccard(as_docs(rows)).collect()}
    assert got == {1: (59_997, 1), 2: (59_998, 1), 3: (19_997, 3), 4: (1, 4)}
    kept = N.one_of_each(as_docs(rows))
    assert {x["doc_id"] for x in kept.collect()} == {1, 3, 4}
