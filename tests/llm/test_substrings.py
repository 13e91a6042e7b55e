"""Substring operators against brute force."""

import hashlib
import random
import re

import numpy as np

from dataclinic.llm import blocks as B
from dataclinic.llm import suffix_buckets as S
from dataclinic.llm.substring_dedup import substring_dedup
from dataclinic.llm.suffix_dedup import COVER, PERIOD, suffix_dedup


def brute(rows, split, join, width):
    """rows (doc_id or None, text) -> sorted (id, n, removed, spans, digest)."""
    key = lambda i: (i is None, i or 0)
    first = {}
    items = [split(t) for _, t in rows]
    for (i, _), it in zip(rows, items):
        for k in range(len(it) - width + 1):
            w = tuple(it[k:k + width])
            if w not in first or key(i) < first[w]:
                first[w] = key(i)
    out = []
    for (i, _), it in zip(rows, items):
        mask = [False] * len(it)
        for k in range(len(it) - width + 1):
            if first[tuple(it[k:k + width])] < key(i):
                mask[k:k + width] = [True] * width
        kept = join([x for x, m in zip(it, mask) if not m])
        spans = sum(m and not p for m, p in zip(mask, [False] + mask[:-1]))
        out.append((i, len(it), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def words(t):
    return [w.encode() for w in re.findall("[^\x20\x09-\x0D]+", t or "")]


def corpus(seed=3, n=60):
    r = random.Random(seed)
    vocab = ["a", "bb", "été", "d\x1ce", "longwordlongword", "x y", "日本語", "the", "of"]
    text = lambda k: "".join(r.choice(vocab) + r.choice([" ", "\n", "  ", "\t"]) for _ in range(k))
    passage, rows = text(30), []
    for i in range(n):
        t = text(r.choice([0, 3, 12, 13, 40, 200]))
        if i % 4 == 0:
            t = t + passage + text(5)
        rows.append((i * 7 - 50, t))
    rows += [(1000, rows[3][1]), (1001, rows[9][1]), (5, rows[9][1]), (1000, rows[3][1]), (None, rows[9][1]),
             (None, text(60)), (2000, None), (2001, ""), (2002, "word " * 3000), (2003, "word " * 2000), (-60, passage)]
    return rows


def collected(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_words_match_brute_force(as_docs, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_BYTES", 4000)
    rows = corpus()
    assert collected(substring_dedup(as_docs(rows))) == brute(rows, words, b" ".join, 13)


def test_bytes_match_brute_force(as_docs):
    rows = corpus(5, 30)
    got = collected(suffix_dedup(as_docs(rows)))
    assert got == brute(rows, lambda t: [bytes([b]) for b in (t or "").encode()], b"".join, 50)


def test_empty_table(as_docs):
    assert collected(substring_dedup(as_docs([]))) == []
    assert collected(suffix_dedup(as_docs([]))) == []


def test_cover_holds_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_packing_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        h = r.integers(0, 2 ** 64, n, dtype=np.uint64)
        for bits in (8, 40, 64):
            v, inv = B.distinct(h, bits)
            assert (B.unpack(B.pack(v << np.uint64(64 - bits), bits)) == v).all()
            assert (v[inv] == h >> np.uint64(64 - bits)).all()


def brute_owners(strings, owners, length):
    first = {}
    for s, o in zip(strings, owners):
        for k in range(len(s) - length + 1):
            first[s[k:k + length]] = min(o, first.get(s[k:k + length], o))
    return [first[s[k:k + length]] for s in strings for k in range(len(s) - length + 1)]


def owners_of(strings, owners, length):
    buf = np.frombuffer(b"".join(strings), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
    return S.first_owners(buf, off, np.array(owners, np.int64), length).tolist()


def test_suffix_bucket_settles_ties_beyond_the_sort_key():
    # equal first and last 8 bytes everywhere; the middles differ in one byte, at every place
    r = random.Random(1)
    for length in (28, 50, 90):
        middle = bytes(r.randrange(256) for _ in range(length - 16))
        rows = [b"A" * 8 + middle + b"Z" * 8]
        for k in range(len(middle)):
            rows.append(b"A" * 8 + middle[:k] + bytes([middle[k] ^ 1]) + middle[k + 1:] + b"Z" * 8)
        rows = [x for row in rows for x in (row, b"q" * r.randrange(9) + row + b"t" * r.randrange(9))]
        r.shuffle(rows)
        owners = [r.randrange(50) for _ in rows]
        assert owners_of(rows, owners, length) == brute_owners(rows, owners, length)


def test_suffix_bucket_of_repetitive_texts():
    r = random.Random(2)
    rows = [b"a" * 81, b"a" * 50, b"ab" * 40, b"b" + b"ab" * 30, b"abcdefg" * 11, b"cdefgab" * 9]
    rows += [bytes(r.choice(b"ab") for _ in range(3)) * r.choice([17, 25]) for _ in range(40)]
    owners = [r.randrange(9) for _ in rows]
    assert owners_of(rows, owners, 50) == brute_owners(rows, owners, 50)
    assert owners_of([], [], 50) == []


def test_ties_cover_holds_every_difference_and_ranks_are_the_order():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))
    r = random.Random(3)
    text = bytes(r.choice(b"ab") for _ in range(400))
    at = np.arange(400 - 24)
    rank = S.sort_ranks(at, S._words(np.frombuffer(text, np.uint8)), [0, 8, 16])
    parts = [text[i:i + 24] for i in at]
    assert rank.tolist() == [sum(q < p for q in parts) for p in parts]


def test_equal_suffixes_meet_in_one_bucket_and_strings_hold_all():
    r = random.Random(4)
    passage = bytes(r.choice(b"abcd ") for _ in range(300))
    buf = np.frombuffer(b"x" * 60 + passage + b"y" * 77 + passage + b"aaa" * 99, np.uint8)
    starts = np.array([i for i in range(len(buf) - 49) if i % 97])
    first, count, low = S.cut(buf, starts, 50)
    assert count.max() <= S.RUN and S.spread(starts[first], count).tolist() == starts.tolist()
    bucket = np.repeat(S.bucket_of(low, 7), count)
    held = S.strings(buf, starts[first], count + 49).to_pylist()
    assert held == [buf[a:a + n + 49].tobytes() for a, n in zip(starts[first], count)]
    seen = {}
    for p, b in zip(starts.tolist(), bucket.tolist()):
        assert seen.setdefault(buf[p:p + 50].tobytes(), b) == b


def test_bytes_over_many_blocks_match_brute_force(as_docs, monkeypatch):
    # passages across documents of one block and of many, long repeats, and no hash but the copies' SHA-256
    monkeypatch.setattr(B, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(B, "BUCKET_BYTES", 5000)
    r = random.Random(6)
    rows = corpus(7, 50) + [(3000, "ab" * 700), (3001, "ba" * 300), (3001, "x" * 400), (3002, "x" * 49), (3003, "x" * 50),
                            (None, "ab" * 100)]
    r.shuffle(rows)
    assert collected(suffix_dedup(as_docs(rows))) == brute(rows, lambda t: [bytes([b]) for b in (t or "").encode()],
                                                          b"".join, 50)
