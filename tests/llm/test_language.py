"""Language mixture: held-out accuracy, mixtures, edge cases."""

import math
import zlib
from collections import Counter

import pyarrow as pa

from dataclinic.llm.language_mixture import BUCKETS, PENALTY, ROUNDS, infer, language_mixture, learn, trigrams


def plain_learn(rows):
    """rows (text, lang) -> language names and one probability table each, in plain Python."""
    counts = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(trigrams(pa.array([text]))[1].tolist())
    seen = max(1, len(set().union(*counts.values())) if counts else 0)
    return sorted(counts), {k: [(c[b] + 0.5) / (sum(c.values()) + seen) for b in range(BUCKETS)] for k, c in counts.items()}


def plain_mixture(text, langs, probs):
    """(proportions of all languages, {language: proportion of the chosen set}): EM, then sets of growing size."""
    n = Counter(trigrams(pa.array([text]))[1].tolist())
    total = sum(n.values())
    if not total:
        return None, {}

    def em(pi):
        for _ in range(ROUNDS):
            new = dict.fromkeys(pi, 0.0)
            for g, k in n.items():
                w = {x: p * probs[x][g] for x, p in pi.items()}
                for x in w:
                    new[x] += k * w[x] / sum(w.values())
            pi = {x: v / total for x, v in new.items()}
        return pi, sum(k * math.log(sum(p * probs[x][g] for x, p in pi.items())) for g, k in n.items())

    soft, _ = em({x: 1 / len(langs) for x in langs})
    alone = {x: sum(k * math.log(probs[x][g]) for g, k in n.items()) for x in langs}
    best = max(langs, key=lambda x: alone[x])
    chosen, like = {best: 1.0}, alone[best]
    order = sorted(langs, key=lambda x: -soft[x])
    for size in range(2, len(langs) + 1):
        if soft[order[size - 1]] <= 0.01:
            break
        pi, ll = em({x: 1 / size for x in order[:size]})
        if ll - like <= PENALTY * math.log(max(total, 2)):
            break
        chosen, like = pi, ll
    return soft, chosen


def test_equals_plain_em(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 900").limit(60).collect()
    texts = [(d["doc_id"], d["text"], d["lang"]) for d in docs]
    pairs = [d["text"][:300] for d in docs if d["lang"] is not None]
    texts += [(10_000 + i, a + " " + b, None) for i, (a, b) in enumerate(zip(pairs, pairs[::-1]))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    train = [(t, g) for i, t, g in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    langs, probs = plain_learn(train)
    sets = 0
    for r in language_mixture(df).collect():
        soft, chosen = plain_mixture(dict((i, t) for i, t, _ in texts)[r["doc_id"]], langs, probs)
        if not chosen:
            assert r["lang_pred"] == "und"
            continue
        got = dict(zip(r["languages"], r["shares"]))
        assert set(got) == {x for x, p in chosen.items() if p > 0}, r["doc_id"]
        assert all(abs(got[x] - chosen[x]) < 1e-6 for x in got) and abs(r["score"] - soft[r["lang_pred"]]) < 1e-6
        sets += len(got) > 1
    assert sets > 5


def test_recall_of_every_language(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    hit, all_ = Counter(), Counter()
    for r in language_mixture(docs).where("held_out").collect():
        all_[truth[r["doc_id"]]] += 1
        hit[truth[r["doc_id"]]] += r["lang_pred"] == truth[r["doc_id"]]
    assert len([x for x in all_ if x is not None]) >= 3
    assert all(hit[x] >= 0.9 * all_[x] for x in all_ if x is not None), (hit, all_)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in language_mixture(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert set(got) == set(truth)
    held = [i for i in got if got[i]["held_out"]]
    assert held and all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held)
    right = [truth[i] == got[i]["lang_pred"] for i in held if truth[i] is not None]
    assert sum(right) / len(right) >= 0.95


def test_mixture_and_labels_are_not_read_for_predictions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 600")
    rows = docs.collect()
    en = next(r["text"] for r in rows if r["lang"] == "en")[:600]
    de = next(r["text"] for r in rows if r["lang"] == "de")[:600]
    langs, probs = learn(docs, "lang", "text")
    row, g = trigrams(pa.array([en, de, en + " " + de]))
    soft, hard = infer(row, g, 3, probs)
    assert [langs[i] for i in hard.argmax(axis=1)[:2]] == ["en", "de"]
    assert {langs[j] for j in hard[2].nonzero()[0]} == {"en", "de"}
    assert abs(hard.sum(axis=1) - 1).max() < 1e-9


def test_edges(spark):
    schema = "doc_id bigint, text string, lang string, score double, held_out string"
    rows = [(i, "the cat and the dog sat on the mat " * 3, "en", 0.1, "q") for i in range(8)]
    rows += [(i, "der hund und die katze liegen auf dem boden " * 3, "de", 0.1, "q") for i in range(8, 16)]
    rows += [(20, None, "en", 0.1, "q"), (21, "", "en", 0.0, "q"), (22, "12 34 !!", "de", 0.0, "q"), (23, "a", None, 0.0, "q"),
             (None, "der hund", None, 0.0, "q"), (24, "—…", "en", 0.0, "q"), (20, None, "en", 0.1, "q")]
    df = spark.createDataFrame(rows, schema)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_mixture(df).collect()]
    by = dict((g[0], g) for g in got)
    assert len(got) == len(rows)
    assert [by[i][1] for i in (0, 8, 20, 21, 22, 24)] == ["en", "de", "und", "und", "und", "und"]
    assert by[23][1] in ("en", "de") and by[None][1] == "de" and all(0 <= g[2] <= 1 for g in got)
    assert language_mixture(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "der hund liegt auf dem boden " * 20_000, None, 0.0, "q"), *rows], schema)
    assert {r["lang_pred"] for r in language_mixture(long).where("doc_id = 1").collect()} >= {"de"}
    assert {r["lang_pred"] for r in language_mixture(df.withColumn("lang", df["lang"].substr(9, 1))
                                                     .replace("", None, "lang")).collect()} == {"und"}
