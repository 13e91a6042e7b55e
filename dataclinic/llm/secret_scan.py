"""Secret scan with corpus-wide ownership frequency.

Base rules find spans in every whole text (leftmost, not overlapping, per kind):

* ``assign``: a credential word, a separator and a value of 8 or more characters;
* ``access``: ``AKIA`` and capitals or digits, 16 or more characters in all;
* ``hex``: 32 or more lower-case hex digits.

To these come ``token`` candidates: runs of token characters that no base span meets, long and mixed enough to be
a generated credential.  Every value, base or candidate, is reduced to a 128-bit hash, and Spark counts over the
whole corpus in how many distinct repositories and by how many distinct owners it stands:

* ``example``: more than ``MAX_OWNERS`` owners or ``MAX_REPOS`` repositories hold it (a documentation key, a
  template, a digest that everybody copies);
* ``live``: few owners and repositories hold it, and it looks generated (mixed characters, no placeholder word);
* ``weak``: owner-specific, but it does not look generated.

The method adds ``token`` spans judged live; base spans stay whatever their class, and their classes are counted.

A text is read once; the stored candidates hold hashes and offsets, never values.  Counts are pre-aggregated by
(value, owner, repository).  A value that stands in more than 1 / ``HOT`` of all rows is joined back by broadcast
(at most ``HOT`` such values exist), the others by hash, so no join key is hot.

Edge cases: a null or empty text has no span; a null owner is one owner, a null repository one repository;
repeated rows of one id give a row each and count as one repository; very long texts are scanned whole, and a
document's spans are one string; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The base rules (on UTF-8 bytes; letters are ASCII).
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
MIN_ASSIGN, MIN_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "token")

TOKEN = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
PLACEHOLDER = re.compile(rb"(?i)example|sample|dummy|changeme|placeholder|your|test|xxxx|1234567|abcdef")
MIN_ENTROPY = 3.0
MAX_OWNERS, MAX_REPOS = 1, 3
HOT = 4096


def generated(value: bytes) -> bool:
    """Looks like a generated credential: mixed classes, no placeholder, enough entropy."""
    classes = sum(bool(re.search(p, value)) for p in (rb"[a-z]", rb"[A-Z]", rb"[0-9]"))
    if classes < 2 or PLACEHOLDER.search(value):
        return False
    n = np.bincount(np.frombuffer(value, np.uint8))
    n = n[n > 0] / len(value)
    return float(-(n * np.log2(n)).sum()) >= MIN_ENTROPY


def scan(raw: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, end, kind, value) of the base spans and candidates of one text, in bytes, by start and kind."""
    found = [(m.start(), m.end(), 0, m.group(2)) for m in ASSIGN.finditer(raw) if len(m.group(2)) >= MIN_ASSIGN]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), 1, m.group()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), 2, m.group()) for m in HEX.finditer(raw)]
    found.sort(key=lambda s: s[:3])
    base, reach = [s[0] for s in found], []
    top = 0
    for s in found:
        top = max(top, s[1])
        reach.append(top)
    for m in TOKEN.finditer(raw):
        k = bisect_left(base, m.end())  # base spans that begin before the candidate ends
        if (k == 0 or reach[k - 1] <= m.start()) and generated(m.group()):
            found.append((m.start(), m.end(), 3, m.group()))
    return sorted(found, key=lambda s: s[:3])


def code_points(raw: bytes, at: list[int]) -> list[int]:
    """Byte offsets -> code point offsets."""
    if raw.isascii() or not at:
        return at
    tail = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80)
    return [p - int(tail[p - 1]) if p else 0 for p in at]


_SPAN = pa.struct([("s", pa.int64()), ("e", pa.int64()), ("kind", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()),
                   ("generated", pa.bool_())])
FOUND = ("doc_id bigint, owner string, repo string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
         "spans array<struct<s: bigint, e: bigint, kind: int, hi: bigint, lo: bigint, generated: boolean>>")


def _label(s, e, kind) -> str:
    return f"{KINDS[kind]}:{s}:{e}"


def _scan(batches):
    for b in batches:
        counts, digests, spans = [], [], []
        texts = b.column("text")
        for at in range(b.num_rows):
            raw = texts[at].as_py() or b""
            found = scan(raw)
            ends = code_points(raw, [p for s in found for p in s[:2]])
            rows = [(*ends[2 * i:2 * i + 2], s[2]) for i, s in enumerate(found)]
            base = [r for r in rows if r[2] < 3]
            counts.append([sum(r[2] == k for r in base) for k in range(3)])
            digests.append(hashlib.sha256(",".join(_label(*r) for r in base).encode()).hexdigest())
            out = []
            for r, s in zip(rows, found):
                hi, lo = np.frombuffer(xxhash.xxh3_128_digest(s[3]), np.int64)
                out.append({"s": r[0], "e": r[1], "kind": r[2], "hi": int(hi), "lo": int(lo),
                            "generated": s[2] == 3 or generated(s[3])})
            spans.append(out)
        n = np.array(counts, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("owner"), b.column("repo"), *[pa.array(n[:, k]) for k in range(3)],
             pa.array(digests, pa.string()), pa.array(spans, pa.list_(_SPAN))],
            ["doc_id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def ownership(spans: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """Rows (hi, lo, owner, repo, generated) of values -> (hi, lo, n_rows, n_repos, n_owners, class)."""
    one = spans.groupBy("hi", "lo", "owner", "repo").agg(F.count(F.lit(1)).alias("n"), F.bool_or("generated").alias("g"))
    two = one.groupBy("hi", "lo", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"), F.bool_or("g").alias("g"))
    three = two.groupBy("hi", "lo").agg(F.sum("n").alias("n_rows"), F.sum("repos").alias("n_repos"),
                                        F.count(F.lit(1)).alias("n_owners"), F.bool_or("g").alias("g"))
    example = (F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos)
    return three.select("hi", "lo", "n_rows", "n_repos", "n_owners",
                        F.when(example, "example").when(F.col("g"), "live").otherwise("weak").alias("class"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | Column = "source",
                repo_col: str | Column = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_token (added spans),
    n_live, n_example, n_weak (spans by class, candidates that were not added excluded)."""
    col = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), col(owner_col).alias("owner"), col(repo_col).alias("repo"),
                      F.col(text_col).cast("binary").alias("text"))
    # numbered once: the stored number identifies a row also where ids repeat
    found = stored(src.mapInArrow(_scan, FOUND).withColumn("row", F.monotonically_increasing_id()))
    some = found.where(F.size("spans") > 0)
    values = some.select("row", "owner", "repo", F.explode("spans").alias("x")).select("row", "owner", "repo", "x.*")
    classes = stored(ownership(values, max_owners, max_repos))
    total = classes.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("all"))
    marked = classes.crossJoin(F.broadcast(total)).withColumn("hot", F.col("n_rows") * HOT > F.col("all"))
    fact = F.struct("n_repos", "n_owners", "class")
    hot = marked.where("hot").select("hi", "lo", fact.alias("a"))  # fewer than HOT rows: each has more than 1 / HOT of all
    cold = marked.where("not hot").select("hi", "lo", fact.alias("b"))
    near = values.join(F.broadcast(hot), ["hi", "lo"], "left")
    judged = near.where("a is not null").withColumn("f", F.col("a")).drop("a").unionByName(
        near.where("a is null").drop("a").join(cold, ["hi", "lo"]).withColumnRenamed("b", "f"))
    judged = judged.select("row", "s", "e", "kind", F.col("f.class").alias("class")).where("kind < 3 or class = 'live'")
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    text = F.concat_ws(":", name, F.col("s").cast("string"), F.col("e").cast("string"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    per = judged.groupBy("row").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("s", "kind", text.alias("t")))),
                                     lambda x: x["t"])).alias("spans"),
        n(F.col("kind") == 3).alias("n_token"), *[n(F.col("class") == c).alias(f"n_{c}") for c in ("live", "example", "weak")])
    out = found.drop("spans", "owner", "repo").join(per, "row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_token", "n_live", "n_example", "n_weak")]
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"),
                      *zero)
