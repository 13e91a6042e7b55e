"""Language ID as multilingual mixture inference.

Training counts byte trigrams (ASCII lower-cased, other ASCII that is no letter
read as a space; the middle byte is a letter) for each language over all
training rows; a task sends one row per language and trigram bucket that it met,
Spark sums them, and the model has languages x ``BUCKETS`` numbers whatever the
corpus size.

For each document an expectation-maximisation estimates the proportions of the
languages from the likelihoods of its trigrams.  The language set is chosen by
penalised likelihood: the best single language, then sets of growing size in
order of proportion, as long as a further language gains more than
``PENALTY * log(trigrams)`` of log-likelihood.

Edge cases: a null text or one without a letter is ``und`` with score 0, and so
is every text when there is nothing to learn from; a null id is not held out; a
null language is not learned from; repeated rows are rows like others; an empty
table gives an empty result; extra columns are not read.  The whole text counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import joined

BUCKETS = 1 << 16
PENALTY = 4.0
ROUNDS = 12
_SYMBOL = np.full(256, 32, np.uint32)
_SYMBOL[97:123] = np.arange(97, 123)
_SYMBOL[65:91] = np.arange(97, 123)
_SYMBOL[128:] = np.arange(128, 256)


def trigrams(texts) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every trigram of an Arrow text array."""
    buf, off = joined(texts)
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    s = np.full(len(buf) + n + 2, 32, np.uint32)
    s[np.arange(len(buf)) + row + 1] = _SYMBOL[buf]
    mid = np.flatnonzero(s != 32)
    h = (s[mid - 1] * np.uint32(0x9E3779B1)) ^ (s[mid] * np.uint32(0x85EBCA77)) ^ (s[mid + 1] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    ends = off[1:] + np.arange(n) + 1  # where each row ends in s
    return np.searchsorted(ends, mid, side="right"), (h >> np.uint32(16)).astype(np.int64)


def learn(train: DataFrame, lang_col: str, text_col: str) -> tuple[list[str], np.ndarray]:
    """Language names and their trigram probabilities (languages x BUCKETS)."""
    src = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"))

    def count(batches):
        sums: dict = {}
        for batch in batches:
            t = pa.Table.from_batches([batch])
            names = t["lang"].to_pandas().to_numpy(dtype=object)
            for lang in set(names):
                texts = t["text"].filter(pa.array(names == lang))
                for at in range(0, len(texts), 256):
                    _, g = trigrams(texts.slice(at, 256))
                    sums[lang] = sums.get(lang, 0) + np.bincount(g, minlength=BUCKETS)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(c[at], pa.int64())], ["lang", "bucket", "n"])

    rows = (src.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket")
            .agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    for i, lang in enumerate(langs):
        part = rows[rows["lang"] == lang]
        counts[i, part["bucket"].to_numpy()] = part["n"].to_numpy()
    seen = max(1, int((counts.sum(axis=0) > 0).sum()))
    return langs, (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * 2 * seen)


def _em(ratio, n, total, starts, row, pi, rounds):
    """Proportions after ``rounds`` of expectation-maximisation, and the log-likelihood."""
    for _ in range(rounds):
        w = ratio * pi[row]
        w *= (n / w.sum(axis=1))[:, None]
        pi = np.add.reduceat(w, starts, axis=0) / total[:, None]
    return pi, np.add.reduceat(n * np.log((ratio * pi[row]).sum(axis=1)), starts)


def infer(row: np.ndarray, bucket: np.ndarray, rows: int, probs: np.ndarray, penalty: float = PENALTY,
          rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(soft proportions, proportions within the chosen set) for each of ``rows``
    documents; rows without trigrams are zero."""
    k = len(probs)
    soft, hard = np.zeros((rows, k)), np.zeros((rows, k))
    if len(row) == 0:
        return soft, hard
    key, n = np.unique(row * BUCKETS + bucket, return_counts=True)
    r, g = key // BUCKETS, key % BUCKETS
    starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    docs, seq = r[starts], np.cumsum(np.concatenate([[0], (r[1:] != r[:-1]).astype(np.int64)]))
    p = probs.T[g]
    ratio = p / p.max(axis=1, keepdims=True)
    total = np.add.reduceat(n, starts).astype(float)
    pi, _ = _em(ratio, n, total, starts, seq, np.full((len(docs), k), 1 / k), rounds)
    alone = np.add.reduceat(n[:, None] * np.log(ratio), starts, axis=0)
    best = alone.argmax(axis=1)
    chosen = np.zeros_like(pi)
    chosen[np.arange(len(docs)), best] = 1.0
    like = alone[np.arange(len(docs)), best]
    order = np.argsort(-pi, axis=1, kind="stable")
    live = np.arange(len(docs))
    for size in range(2, k + 1):
        live = live[pi[live, order[live, size - 1]] > 0.01]
        if len(live) == 0:
            break
        pick = np.zeros((len(docs), k), bool)
        pick[live[:, None], order[live, :size]] = True
        at = np.flatnonzero(np.isin(seq, live))
        sub = np.searchsorted(live, seq[at])
        st = np.flatnonzero(np.concatenate([[True], sub[1:] != sub[:-1]]))
        q, ll = _em(ratio[at], n[at], total[live], st, sub, pick[live] / size, rounds)
        gain = ll - like[live] > penalty * np.log(np.maximum(total[live], 2))
        live = live[gain]
        chosen[live], like[live] = q[gain], ll[gain]
    soft[docs], hard[docs] = pi, chosen
    return soft, hard


SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>"


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the decimal id leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def language_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     penalty: float = PENALTY, with_row: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (proportion of lang_pred),
    languages and shares of the chosen set, largest first; ``with_row`` adds the whole
    input row as a struct, so a filter needs no join back."""
    train = docs.where(~held_out(F.col(id_col)))
    langs, table = learn(train, lang_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(table)  # half a MB for each language
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                      F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at_text = docs.columns.index(text_col)
    schema = SCHEMA
    if with_row:
        schema = T.StructType([*T.StructType.fromDDL(SCHEMA).fields, src.schema["row"]])
    else:
        src = src.select("doc_id", "held_out", F.struct(F.col(f"row.`{text_col}`").alias("text")).alias("row"))
        at_text = 0
    step = max(16, 1024 // max(1, len(langs)))

    def predict(batches):
        probs = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = part.column(2).field(at_text)
                row, g = trigrams(texts)
                if langs:
                    soft, hard = infer(row, g, part.num_rows, probs, penalty)
                pred, score, names, shares = [], [], [], []
                has = np.zeros(part.num_rows, bool)
                has[row] = True
                for i in range(part.num_rows):
                    if not langs or not has[i] or not any(map(str.isalpha, texts[i].as_py())):
                        pred.append("und"), score.append(0.0), names.append([]), shares.append([])
                        continue
                    top = [j for j in np.argsort(-hard[i], kind="stable") if hard[i, j] > 0]
                    pred.append(langs[top[0]])
                    score.append(float(min(1.0, max(0.0, soft[i, top[0]]))))
                    names.append([langs[j] for j in top])
                    shares.append([float(hard[i, j]) for j in top])
                cols = [part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                        pa.array(names, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
                names = ["doc_id", "held_out", "lang_pred", "score", "languages", "shares"]
                yield pa.RecordBatch.from_arrays(cols + [part.column(2)] * with_row, names + ["row"] * with_row)

    return src.mapInArrow(predict, schema)
