"""Byte-level BPE against the public library, and the exact round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from dataclinic.llm.byte_bpe import RANKS, Codec, byte_bpe, load_ranks, merge


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path(RANKS)), special_tokens={})


def texts():
    r = random.Random(4)
    chars = "aabcdeeehiklmnorsttu  \t\n\x0b\x0c\r\x1c\x1d\x85\xa0 ​012'’éßñ日本語🙂.,!?&#-_/"
    out = ["", " ", "\n\n  x", "it's we'LL don't", "a" * 3000, "ab" * 2000, "日本" * 500, "<|endoftext|>", "x" + " " * 50 + "y"]
    return out + ["".join(r.choice(chars) for _ in range(r.choice([1, 5, 40, 400]))) for _ in range(300)]


def test_ids_equal_the_library(library):
    c = Codec(P.path(RANKS), P.PATTERN)
    for t in texts():
        want = library.encode_ordinary(t)
        assert c.encode(t) == ",".join(map(str, want)), repr(t)
        assert c.decode(c.encode(t)) == t.encode()


def test_overlaps_and_late_low_ranks():
    ranks = {bytes([i]): 1000 + i for i in range(256)} | {b"aa": 5, b"aaa": 2, b"ab": 3, b"abab": 1}
    enc = tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    for t in ("aaaa", "aaaaa", "aaab", "abab", "aababab", "baaaab"):
        assert merge(t.encode(), ranks) == enc.encode_ordinary(t), t


def test_rows(as_docs, library):
    rows = [(i, t) for i, t in enumerate(texts()[:60])] + [(None, "a b"), (7, None), (7, None)]
    got = byte_bpe(as_docs(rows), P.path(RANKS), P.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        s = ",".join(map(str, ids))
        want.append((i, len(ids), hashlib.sha256(s.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(),
                     np.array(ids, "<u2").tobytes()))
    got = [(*r[:4], bytes(r[4])) for r in got]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert byte_bpe(as_docs([]), P.path(RANKS), P.PATTERN).count() == 0
