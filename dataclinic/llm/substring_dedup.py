"""Substring dedup: Rabin-Karp hashes of every fixed-length word window.

A word is ``[^\\x20\\x09-\\x0D]+``, unchanged.  Every window of ``WIDTH``
consecutive words of one document gets a Rabin-Karp hash; the hashes are counted
across all documents in Spark (``repeated.py``) and windows whose word sequence
also starts in a document of smaller id are merged into maximal intervals, whose
words are removed.  Windows are judged on the input.

Edge cases: a null or empty text and one of fewer words than a window lose
nothing; a repeat inside one document counts only against smaller ids; rows that
share an id are one document here (neither removes the other) and each gives its
row; a null id comes after all others; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeated import Windows, remove_repeated
from .words import rolling, word_hashes, word_spans

WIDTH = 13
SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                    ("kept_sha256", pa.string()), ("kept", pa.binary())])


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    d = np.zeros(n + 1, np.int32)
    d[starts] += 1
    d[starts + width] -= 1
    return np.cumsum(d[:-1]) > 0


class WordWindows(Windows):
    check_bytes = 8

    def __init__(self, width: int, with_text: bool):
        self.width, self.with_text = width, with_text

    def items(self, buf, off):
        start, end, row = word_spans(buf, off)
        return {"buf": buf, "off": off, "start": start, "end": end, "row": row}

    def row_of(self, it, pos):
        return it["row"][pos]

    def sample(self, it, live):
        if "first" not in it:
            h = word_hashes(it["buf"], it["start"], it["end"], 1)
            it["first"] = rolling(h, it["row"], self.width)
        idx, h = it["first"]
        keep = live[it["row"][idx]]
        return idx[keep], h[keep]

    def candidates(self, it, live, flagged):
        return flagged

    def windows(self, it, starts, which):
        idx, h = it["first"]
        if which:
            h2 = word_hashes(it["buf"], it["start"], it["end"], 2)
            idx, h = rolling(h2, it["row"], self.width, base=0x9E3779B97F4A7C55)
        return h[np.searchsorted(idx, starts)]

    def all_starts(self, it, rows):
        idx, _ = rolling(np.zeros(len(it["row"]), np.uint64), it["row"], self.width)
        return idx[rows[it["row"][idx]]]

    def rows(self, it, table, starts):
        mask = covered(len(it["start"]), starts, self.width)
        n = len(it["off"]) - 1
        cut = np.searchsorted(it["row"], np.arange(n + 1))
        gone = np.concatenate([[0], np.cumsum(mask)])
        begin = mask.copy()
        begin[1:] &= ~mask[:-1] | (it["row"][1:] != it["row"][:-1])
        spans = np.concatenate([[0], np.cumsum(begin)])
        raw = it["buf"].tobytes()
        digests, kept = [], []
        for i in range(n):
            a, b = cut[i], cut[i + 1]
            words = raw[it["off"][i]:it["off"][i + 1]].split()
            if gone[b] > gone[a]:
                words = compress(words, ~mask[a:b])
            text = b" ".join(words)
            digests.append(hashlib.sha256(text).hexdigest())
            kept.append(text if self.with_text else None)
        return pa.table({"doc_id": table["doc_id"], "n_words": np.diff(cut), "n_removed": gone[cut[1:]] - gone[cut[:-1]],
                         "n_spans": spans[cut[1:]] - spans[cut[:-1]], "kept_sha256": digests,
                         "kept": pa.array(kept, pa.binary())}).cast(_ARROW)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, n_spans, kept_sha256, and with
    ``with_text`` the kept words joined by one space (UTF-8 binary)."""
    return remove_repeated(docs, WordWindows(width, with_text), SCHEMA, _ARROW.empty_table(), id_col, text_col)
