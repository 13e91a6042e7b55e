"""Separator scan against plain splitting of the same files."""

import random
import re

import numpy as np

from dataclinic.llm.token_counts import BLOCK_TOKENS, document_token_counts, token_counts, token_files, write_token_files


def test_any_files_and_block_sizes(spark, tmp_path):
    r, want, base, tokens = random.Random(1), [], 0, 0
    for k, n in enumerate([0, 1, 7, 400, 1000, 12]):
        ids = [9 if r.random() < 0.1 else r.randrange(9) for _ in range(n)]
        if k == 3:
            ids = [1] * 390 + [9] * 10
        if k == 5:
            ids = [3] * 12
        (tmp_path / f"f{k}.bin").write_bytes(np.array(ids, "<u4").tobytes())
        start = 0
        for i, t in enumerate(ids + [None]):
            if t == 9 or (t is None and start < len(ids)):
                want.append((base, start, tokens + start, i - start, t == 9))
                base, start = base + 1, i + 1
        tokens += n
    for block in (1, 3, 64, 5000):
        got = token_counts(token_files(spark, str(tmp_path)), 4, 9, block).drop("file").collect()
        assert sorted(map(tuple, got)) == want, block


def test_documents_round_trip(as_docs):
    r = random.Random(2)
    rows = [(i * 3 - 20, "".join(r.choice(["é ", "word\n", " ", "日本 "]) for _ in range(r.choice([0, 1, 50])))) for i in range(80)]
    rows += [(500, None), (501, ""), (None, "a b c"), (7, "x y"), (7, "x y")]
    n = lambda t: len(re.findall("[^\x20\x09-\x0D]+", t or ""))
    got = document_token_counts(as_docs(rows)).collect()
    assert sorted(((x["doc_id"], x["n_tokens"]) for x in got), key=str) == sorted(((i, n(t)) for i, t in rows), key=str)
    assert sorted(x["ordinal"] for x in got) == list(range(len(rows)))
    by = sorted(got, key=lambda x: x["ordinal"])
    assert [x["token_start"] for x in by] == [sum(y["n_tokens"] + 1 for y in by[:k]) for k in range(len(by))]
    assert document_token_counts(as_docs([])).count() == 0


def test_documents_cross_blocks_of_the_registered_size(spark, as_docs, tmp_path):
    want = {1: 300_000, 2: 5, 3: 200_001, 4: 0, 5: 131_072}
    docs = as_docs([(i, "a " * n) for i, n in want.items()])
    write_token_files(docs, str(tmp_path / "files"))
    got = token_counts(token_files(spark, str(tmp_path / "files"))).collect()
    assert sorted(x["n_tokens"] for x in got) == sorted(want.values())
    assert sum(x["file_start"] // BLOCK_TOKENS != (x["file_start"] + x["n_tokens"]) // BLOCK_TOKENS for x in got) >= 2
    assert {x["doc_id"]: x["n_tokens"] for x in document_token_counts(docs).collect()} == want
