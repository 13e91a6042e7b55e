"""Exact dedup, curriculum mix and URL filter against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from dataclinic.llm import curriculum_mix as C
from dataclinic.llm.exact_dedup import exact_dedup, keep_one
from dataclinic.llm.url_filter import RULES, url_filter


def norm(t):
    return re.sub("[\x20\x09-\x0D]", "", t or "")


def dedup_rows():
    r = random.Random(1)
    base = ["", " ", "a b", "ab", "a\tb ", "xé", "x é\n", "q" * 5000, "q" * 4999 + "r", None, "日 本", "\x1cab", "\xa0ab"]
    rows = [(i * 3 - 9, r.choice(base)) for i in range(120)]
    return rows + [(None, "ab"), (None, "only null id"), (None, "only null id "), (5000, "zz"), (5000, "zz"), (-2 ** 63, "a b")]


def test_exact_dedup(as_docs):
    rows = dedup_rows()
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    want = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g)[3]
        want.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    got = [tuple(x) for x in exact_dedup(as_docs(rows), digest_all=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    short = [tuple(x)[:4] for x in exact_dedup(as_docs(rows)).collect()]
    assert sorted(short, key=str) == sorted([w[:4] for w in want], key=str)
    kept = [(r["doc_id"], r["text"]) for r in keep_one(as_docs(rows)).collect()]
    assert sorted((k[0] for k in kept), key=str) == sorted((min(g)[3] for g in groups.values()), key=str)
    assert keep_one(as_docs(rows)).columns == as_docs(rows).columns
    assert exact_dedup(as_docs([])).count() == 0 and keep_one(as_docs([])).count() == 0


def targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
        open_ -= over
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    r = random.Random(seed)
    names = ["a", "b", "c", "d", "É", None, "", "e"]
    share = [50, 1, 1, 5, 5, 2, 8, 1]
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 30])) + r.choice(["", "\n", "\x1c"]), r.choices(names, share)[0], 1, 0.5)
            for i in range(500)]
    rows += [(900, None, "a", 1, 0.5), (None, "x y", "b", 1, 0.5), (901, "x y", "b", 1, 0.5), (901, "x y", "b", 1, 0.5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, target double")
    got = C.curriculum_mix(df).collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += size(t)
    want = targets(dict(sizes))
    assert sorted(((g["doc_id"], g["source"], g["size"]) for g in got), key=str) == sorted(
        ((i, s, size(t)) for i, t, s, *_ in rows), key=str)
    taken = Counter()
    for g in got:
        assert g["source_size"] == sizes[g["source"]] and math.isclose(g["target"], want[g["source"]], rel_tol=1e-9)
        assert 0 <= g["taken"] <= 3 * g["size"] and all(0 <= p <= 1 for p in g["positions"])
        assert len(g["positions"]) == (-(-g["taken"] // g["size"]) if g["size"] else 0)
        assert list(g["positions"]) == sorted(g["positions"])
        taken[g["source"]] += g["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = C.curriculum_mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = C.mixed_rows(df).collect()
    assert {len(x) for x in out} == {5}
    assert abs(sum(size(x["text"]) for x in out) - sum(sizes.values())) <= 30 * len(sizes)
    assert C.curriculum_mix(df.limit(0)).count() == 0 and C.mixed_rows(df.limit(0)).count() == 0


def test_mixed_rows_keeps_rows_that_share_an_id(spark):
    schema = "doc_id bigint, text string, source string, h int, row string"
    rows = [(1, "a b c", "s1", 1, "p"), (1, "a b c", "s2", 1, "p"), (1, "a b c", "s1", 2, "p"), (2, "d", "s3", 1, "p"),
            (None, "e f", "s2", 1, "p"), (None, "e f", "s2", 1, "p")]
    df = spark.createDataFrame(rows, schema)
    plan = C.curriculum_mix(df).collect()
    uses = Counter()
    for p in plan:
        uses[p["source"]] += math.floor(p["taken"] / p["size"] + 0.5)
    out = [tuple(r) for r in C.mixed_rows(df).collect()]
    assert Counter(r[2] for r in out) == +uses and set(out) <= set(rows)
    assert C.mixed_rows(df).columns == df.columns
    again = [tuple(r) for r in C.mixed_rows(df.repartition(3)).collect()]
    assert sorted(out, key=str) == sorted(again, key=str)


def test_long_text_and_url(spark):
    rows = [(1, "w " * 300_000, "a"), (2, "x" * 500_000, "a"), (3, "y", "b")]
    got = {r["doc_id"]: r["size"] for r in C.curriculum_mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got == {1: 300_000, 2: 1, 3: 1}
    urls = [(1, "http://net/" + "a/" * 100_000 + "?" + "b=1&" * 50_000), (2, "http://com/de/1"), (3, "http://x.org/1")]
    got = {r["page_id"]: r for r in url_filter(spark.createDataFrame(urls, "page_id bigint, url string")).collect()}
    assert len(got[1]["path"]) == 200_001 and [got[i]["verdict"] for i in (2, 3)] == ["block", "allow"]


def test_schedule_inversion(spark):
    from pyspark.sql import functions as F
    df = spark.range(101).select((F.col("id") / 100).alias("u"))
    for knots in C.SCHEDULES + ((0.0, 2.0), (1.0, 0.0, 1.0)):
        for r in df.select("u", C.invert_schedule(F.col("u"), (knots,), F.lit(0)).alias("t")).collect():
            step, area, done = 1 / (len(knots) - 1), 0.0, 0.0
            for k, (a, b) in enumerate(zip(knots, knots[1:])):
                x = min(max(r["t"] - k * step, 0), step)
                done += a * x + (b - a) / step * x * x / 2
                area += (a + b) / 2 * step
            assert math.isclose(done / area, r["u"], abs_tol=1e-9)


def test_url_features(spark):
    from dataclinic.llm import url_filter as U
    urls = ["http://A.example.org/x-1/y_2/33?b=1&c=2#f", "http://net", "x://h/é/Ü?", "no scheme?x=1", ""]
    df = U.lexical(spark.createDataFrame([(u,) for u in urls], "url string").withColumns(
        {"host": U.host_of(U.F.col("url")), "path": U.path_of(U.F.col("url"))}))
    for r in df.collect():
        u = r["url"].lower()
        n = max(len(u), 1)
        query = u.split("?", 1)[1].split("#", 1)[0] if "?" in u else ""
        classes = Counter(c if c in U.ALPHABET else "other" for c in u)
        entropy = -sum(k / n * math.log2(k / n) for k in classes.values())
        want = dict(url_len=len(u), host_len=len(r["host"]), path_len=len(r["path"]), query_len=len(query),
                    depth=r["path"].count("/"), host_labels=r["host"].count(".") + 1,
                    digit_ratio=sum(c.isdigit() for c in u) / n, dash_ratio=sum(c in "-_" for c in u) / n, entropy=entropy,
                    n_params=query.count("&") + 1 if query else 0, has_fragment="#" in u)
        for k, v in want.items():
            assert math.isclose(r[k], float(v), abs_tol=1e-9), (r["url"], k)
        assert r["suffix"] == ".".join(r["host"].split(".")[-2:])


def test_url_model_on_urls_kept_out_of_the_fit(spark):
    """Verdicts of the trees on hosts that no rule names, whose URLs look like those of the rules."""
    r = random.Random(6)
    spam = lambda: "/" + "".join(r.choice("0123456789") for _ in range(r.randint(9, 16))) + "?" + "&".join(
        f"p{k}={r.randint(100, 999)}" for k in range(r.randint(3, 6)))
    good = lambda: "/" + "/".join(r.choice(["about", "news", "library", "science", "garden"]) for _ in range(r.randint(1, 3)))
    rules = (("bad.com", "/", "block"), ("good.com", "/", "allow"))
    rows, truth = [], {}
    for i in range(1200):
        block = r.random() < 0.4
        host = (["bad.com", "a.bad.com"] if block else ["good.com", "b.good.com"])[i % 2]
        if i % 4 == 0:
            host, truth[i] = f"site{i % 17}.net", "block" if block else "allow"
        rows.append((i, f"http://{host}{spam() if block else good()}"))
    out = url_filter(spark.createDataFrame(rows, "page_id bigint, url string"), rules=rules).collect()
    got = {x["page_id"]: x for x in out}
    assert sum(got[i]["verdict"] == v for i, v in truth.items()) / len(truth) >= 0.95
    assert all(0 <= got[i]["block_score"] <= 1 and got[i]["rule"] is None for i in truth)


def test_url_filter(spark, sf):
    schema = "page_id bigint, url string, host string, path string, label int"
    urls = [None, "", "no scheme", "http://EXAMPLE.org/es/1?x", "http://example.org/en/12", "http://a.example.org/es/",
            "https://x.com/fr/1", "https://x.com#/fr/1", "https://x.com?/de/", "http://x.com/de/1/2", "http://net/a",
            "http://org", "http://org/", "x://notexample.org/es/", "http://example.org/es", "http://com/de/", "ftp://é.net/ä?b=1&c=2"]
    rows = [(i, u, "h", "p", 1) for i, u in enumerate(urls)] + [(None, "http://a.com/fr/", "h", "p", 1)] * 2
    got = {r["page_id"]: r for r in url_filter(spark.createDataFrame(rows, schema)).collect()}

    def split(u):
        if u is None or "://" not in u:
            return "", ""
        m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
        return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]

    for i, u in enumerate(urls):
        h, p = split(u)
        fit = [(len(a + b), a + b, v) for a, b, v in RULES if (h == a or h.endswith("." + a)) and p.startswith(b)]
        rule = max(fit) if fit else (0, None, None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (h, p, rule[1]), u
        assert got[i]["verdict"] == (rule[2] or got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")
    assert url_filter(spark.createDataFrame(rows, schema).limit(0)).count() == 0
    none = url_filter(spark.createDataFrame([(1, "http://x.net/", "", "", 1)], schema)).collect()
    assert none[0]["verdict"] == "allow"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert url_filter(pages).count() == pages.count()
