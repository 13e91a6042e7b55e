"""The pipeline's stages on small inputs; the whole run against a plain Python chain, row by row."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken
import xxhash
from test_language import plain_learn, plain_mixture
from test_native import norm, targets
from test_ngram import shingles

import corpus_pipeline as P
from dataclinic.llm.byte_bpe import RANKS, load_ranks
from dataclinic.llm.curriculum_mix import BUCKETS, SCHEDULES

ORDER = ["language_id", "exact_dedup", "near_dedup", "mix", "tokenize"]


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_stages(spark, sf):
    assert [n for n, _ in P.STAGES] == ORDER
    en = "the cat sat on the mat and the dog ran to the house by the sea with all of its friends at noon"
    data = [(i, f"{en} {i} {'and so on ' * (i % 3)}", "en", "s", 1) for i in range(12)]
    data += [(20, en, "en", "s", 1), (21, en + " ", "en", "s", 1), (22, None, "en", "s", 1), (23, "!! 12", "en", "s", 1),
             (None, en, "en", "s", 1), (20, en, "en", "s", 1), (24, en + " x", None, None, None)]
    df = rows(spark, data)
    a = P.language_id(spark, df, sf)
    assert a.columns == df.columns and {r["doc_id"] for r in a.collect()} == {r[0] for r in data} - {22, 23}
    b = P.exact_dedup(spark, a, sf)
    assert b.columns == df.columns
    ids = [r["doc_id"] for r in b.collect()]
    assert 21 in ids and 20 not in ids and None not in ids and len(ids) == 14
    c = P.near_dedup(spark, b, sf)
    assert c.columns == df.columns and 24 not in {r["doc_id"] for r in c.collect()}
    d = P.mix(spark, c, sf)
    assert d.columns == df.columns and d.count() > 0
    e = P.tokenize(spark, d, sf).collect()
    assert all(len(r["tokens"]) == 2 * r["n_tokens"] for r in e)
    for _, stage in P.STAGES:
        assert stage(spark, df.limit(0), sf).count() == 0


def plain_near(docs):
    """One of each group stays: smallest id, a row without an id last."""
    sets, up = [shingles(d["text"], 5) for d in docs], list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i, d in enumerate(docs):
        groups[find(i)].append((d["doc_id"] is None, d["doc_id"] or 0, i))
    return [docs[min(g)[2]] for g in groups.values()]


def spark_hash(*values):
    """xxhash64 of integers and texts as Spark chains it; null leaves the hash."""
    h = 42
    for v, width in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v.to_bytes(width, "little", signed=True)
            h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def plain_mix(docs):
    """(position, doc_id, document) of every use."""
    size = lambda t: len(re.findall("[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for d in docs:
        sizes[d["source"]] += size(d["text"])
    want, out = targets(dict(sizes)), []
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    for rank, s in enumerate(names):
        lane = []
        for d in docs:
            if d["source"] == s:
                h = spark_hash((7, 4), (d["doc_id"], 8), (spark_hash((d["text"], 0)), 8))
                lane.append(((h >> 40) % (1 << 24) % BUCKETS, h, d["doc_id"] is not None, d["doc_id"] or 0, size(d["text"]), d))
        quota, total, start = math.floor(want[s] + 0.5), sizes[s], 0
        knots = SCHEDULES[rank % len(SCHEDULES)]
        for *_, n, d in sorted(lane, key=lambda x: x[:5]):
            whole = quota // total if total else 0
            part = min(max(quota - whole * total - start, 0), n)
            for use in range(math.floor((whole * n + part) / n + 0.5) if n else 0):
                u, t, area = min((use * total + start) / quota, 1.0), 0.0, 0.0
                full = sum((a + b) / 2 for a, b in zip(knots, knots[1:])) / (len(knots) - 1)
                step = 1 / (len(knots) - 1)
                for k, (a, b) in enumerate(zip(knots, knots[1:])):
                    if u * full >= area:
                        need, slope = u * full - area, (b - a) / step
                        x = need / a if abs(slope) < 1e-12 else (math.sqrt(max(a * a + 2 * slope * need, 0)) - a) / slope
                        t = k * step + min(max(x, 0), step)
                    area += (a + b) / 2 * step
                out.append((t, d["doc_id"], d))
            start += n
    return out


def plain_chain(docs):
    langs, probs = plain_learn([(d["text"], d["lang"]) for d in docs
                                if d["doc_id"] is None or zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2])
    kept = []
    for d in docs:
        soft, chosen = plain_mixture(d["text"] or "", langs, probs)
        if chosen and any(map(str.isalpha, d["text"])) and soft[max(chosen, key=chosen.get)] >= P.MIN_LANGUAGE_SHARE:
            kept.append(d)
    groups = defaultdict(list)
    for i, d in enumerate(kept):
        groups[norm(d["text"])].append((-len(d["text"]), d["doc_id"] is None, d["doc_id"] or 0, i))
    kept = plain_near([kept[min(g)[3]] for g in groups.values()])
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path(RANKS)),
                            special_tokens={})
    rows = []
    for _, i, d in plain_mix(kept):
        ids = enc.encode_ordinary(d["text"])
        rows.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(d["text"].encode()).hexdigest()))
    return rows, [d["doc_id"] for *_, d in sorted(plain_mix(kept), key=lambda x: (x[0], x[1] is not None, x[1] or 0))]


def test_run_equals_a_plain_chain(spark, sf, tmp_path):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500").limit(70).collect()]
    base = docs[3]["text"]
    extra = [(9001, base + "  "), (9002, base + " one more word"), (5, "repeated id with a text of its own " + base[:200]),
             (5, docs[8]["text"] + " tail words"), (None, docs[9]["text"]), (None, docs[10]["text"] + " and more"),
             (None, "a row without an id and with words that nobody else has " + base[100:300]), (9003, None), (9004, ""), (9005, "123 !")]
    docs += [dict(doc_id=i, text=t, lang="en" if i else None, source="src1" if i else None, n_chars=1) for i, t in extra]
    rows(spark, [tuple(d[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for d in docs]).write.parquet(
        f"{tmp_path}/documents.parquet")
    out = P.run(spark, str(tmp_path)).collect()
    want, order = plain_chain(docs)
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out]
    assert len(got) > 40 and sorted(got, key=str) == sorted(want, key=str)
    assert [g[0] for g in got] == order or sorted(map(str, order)) == sorted(str(g[0]) for g in got)


def test_rows_that_share_an_id_are_judged_one_by_one(spark, sf):
    a, b = " ".join(f"w{i}" for i in range(99)), " ".join(f"v{i}" for i in range(99))
    df = rows(spark, [(3, a, "en", "s", 1), (7, a + " x", "en", "s", 1), (7, b, "en", "s", 1), (9, b + " y", "en", "s", 1),
                      (None, b + " z", "en", "s", 1), (3, "other words " * 3, "en", "s", 1)])
    got = sorted(((r["doc_id"], r["text"]) for r in P.near_dedup(spark, df, sf).collect()), key=str)
    assert got == sorted([(3, a), (7, b), (3, "other words " * 3)], key=str)
    assert P.near_dedup(spark, df, sf).columns == df.columns


def test_near_copies_without_an_id_leave(spark, sf):
    a, b = " ".join(f"w{i}" for i in range(99)), " ".join(f"v{i}" for i in range(99))
    df = rows(spark, [(3, a, "en", "s", 1), (None, a + " x", "en", "s", 1), (None, b, "en", "s", 1), (None, b + " x", "en", "s", 1)])
    c = P.near_dedup(spark, df, sf)
    assert c.columns == df.columns
    got = [(r["doc_id"], r["text"][0]) for r in c.collect()]
    assert sorted(got, key=str) == sorted([(3, "w"), (None, "v")], key=str)
