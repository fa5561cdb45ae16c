"""Toxicity by a factorization machine over all hashed terms."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import fold_of, materialize, table, text_batches

#: Labelled rows that the machine learns from at most, the first by a hash of their ids.
TRAIN_ROWS = 20_000
#: Buckets that all terms are hashed into.
BUCKETS = 1 << 18
#: Terms of the narrow machine at most, the training documents in which each must occur, and the standard errors by
#: which its share must differ between the classes.
TERMS, LEAST_DOCS, LEAST_Z = 1024, 3, 4.0
#: The part of the training documents by which the two machines are weighed, and the ridge of their weights.
WEIGHED, RIDGE = 4, 1e-3
#: Epochs of the narrow machine and of the wide one, which learns no more of rare terms in further ones.
EPOCHS, WIDE_EPOCHS = 20, 8
FACTORS, BATCH, RATE, DECAY = 8, 256, 0.15, 1e-4
THRESHOLD = 0.3
CACHE = 300_000


def term_buckets(text: str | None, cache: dict[str, int]) -> set[int]:
    """Buckets of the distinct words, lower-cased; no words for null or empty."""
    out = set()
    for word in set(re.findall(r"\w+", (text or "").lower())):
        h = cache.get(word)
        if h is None:
            if len(cache) > CACHE:
                cache.clear()
            h = cache[word] = crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        out.add(h)
    return out


def _training_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache: dict[str, int] = {}
    for pdf in batches:
        yield pd.DataFrame({"label": pdf["label"], "held": pdf["held"], "terms": [np.array(sorted(term_buckets(t, cache)), np.int32).tobytes() for t in pdf["text"]]})


class _Batch:
    """Terms of some rows, by row and by term, so that sums over either are sums of neighbours."""

    def __init__(self, indptr: np.ndarray, index: np.ndarray, label: np.ndarray, rows: np.ndarray):
        sizes = indptr[rows + 1] - indptr[rows]
        self.label, self.full = label[rows], np.flatnonzero(sizes)
        self.of = np.repeat(np.arange(len(rows)), sizes)
        self.at = index[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(indptr[rows], sizes)]
        self.starts = (np.cumsum(sizes) - sizes)[self.full]
        order = np.argsort(self.at, kind="stable")
        self.by_term = self.of[order]
        self.used, self.first = np.unique(self.at[order], return_index=True)

    def by_row(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.label), *values.shape[1:]), values.dtype)
        if len(self.full):
            out[self.full] = np.add.reduceat(values, self.starts, axis=0)
        return out


def fit(indptr: np.ndarray, index: np.ndarray, label: np.ndarray, width: int, epochs: int = EPOCHS) -> dict:
    """Logistic factorization machine over binary terms by AdaGrad; batches of rows that a fixed seed draws, in a new order each epoch."""
    rng = np.random.default_rng(7)
    n = len(label)
    rate = float(np.clip(label.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    b, w, v = np.log(rate / (1 - rate)), np.zeros(width, np.float32), rng.normal(0, 0.01, (width, FACTORS)).astype(np.float32)
    gb, gw, gv = 1e-8, np.full(width, 1e-8, np.float32), np.full((width, FACTORS), 1e-8, np.float32)
    drawn = rng.permutation(n)
    batches = [_Batch(indptr, index, label, drawn[k : k + BATCH]) for k in range(0, n, BATCH)]
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            x = batches[k]
            factors = v[x.at]
            sums = x.by_row(factors)
            p = 1 / (1 + np.exp(-np.clip(b + x.by_row(w[x.at]) + 0.5 * ((sums**2).sum(1) - x.by_row((factors**2).sum(1))), -30, 30)))
            err = ((p - x.label) / len(p)).astype(np.float32)
            gb += float(err.sum()) ** 2
            b -= RATE * float(err.sum()) / np.sqrt(gb)
            if not len(x.used):
                continue
            each = err[x.by_term]
            mine, errs = v[x.used], np.add.reduceat(each, x.first)
            g = errs + DECAY * w[x.used]
            gf = np.add.reduceat(each[:, None] * sums[x.by_term], x.first, axis=0) - errs[:, None] * mine + DECAY * mine
            gw[x.used] += g**2
            gv[x.used] += gf**2
            w[x.used] -= RATE * g / np.sqrt(gw[x.used])
            v[x.used] = mine - 0.3 * RATE * gf / np.sqrt(gv[x.used])
    return {"b": b, "w": w, "v": v}


def _sums(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(of, values[:, f], n) for f in range(values.shape[1])], axis=1)


def _logits(index: np.ndarray, of: np.ndarray, n: int, model: dict) -> np.ndarray:
    w, v = model["w"], model["v"]
    pairs = (_sums(v[index], of, n) ** 2).sum(1) - np.bincount(of, (v[index] ** 2).sum(1), n) if len(of) else np.zeros(n)
    return np.clip(model["b"] + np.bincount(of, w[index], n) + 0.5 * pairs, -30, 30)


def _rows(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    indptr = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return indptr, np.concatenate([np.zeros(0, np.int32), *lists])


def _machines(lists: list[np.ndarray], label: np.ndarray, width: int) -> list[dict]:
    """A narrow machine of the terms that differ most between the classes by themselves, and a wide one of all terms."""
    indptr, index = _rows(lists)
    n, n1 = len(label), label.sum()
    of = np.repeat(np.arange(n), np.diff(indptr))
    df, df1 = np.bincount(index, minlength=width), np.bincount(index, label[of], width)
    mean = df / n
    z = np.abs((df1 / n1 - (df - df1) / (n - n1)) / np.sqrt(mean * (1 - mean) * (1 / n1 + 1 / (n - n1)) + 1e-12)).round(9)
    z[df < LEAST_DOCS] = 0
    best = np.argsort(-z, kind="stable")[:TERMS]
    held = np.zeros(width, bool)
    held[best[z[best] >= LEAST_Z]] = True
    narrow = fit(*_rows([x[held[x]] for x in lists]), label, width)
    narrow["v"][~held] = 0
    return [narrow, fit(indptr, index, label, width, WIDE_EPOCHS)]


def _weigh(logits: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Bias and weights, none below 0, of the machines' logits: a logistic regression with a small ridge, by Newton."""

    def loss(x: np.ndarray, c: np.ndarray) -> float:
        at = x @ c
        return float((np.logaddexp(0, at) - label * at).sum() + 0.5 * RIDGE * (c**2).sum())

    found = [(np.inf, np.array([0, 1.0, 0]))]
    for used in ([0, 1], [0], [1]):
        x = np.column_stack([np.ones(len(label)), logits[:, used]])
        c = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ c, -500, 500)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(c)), x.T @ (p - label) + RIDGE * c)
            size = 1.0
            while size > 1e-6 and loss(x, c - size * step) > loss(x, c):
                size /= 2
            c = c - size * step
        if (c[1:] >= 0).all():
            out = np.zeros(3)
            out[[0, *(1 + k for k in used)]] = c
            found.append((loss(x, c), out))
    return min(found, key=lambda f: f[0])[1]


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Learn from labelled documents outside fold 2 of 4: index by bucket, bias, weights and factors.

    The labelled sample has at most TRAIN_ROWS ids, so it may be broadcast, and only its texts are split into terms;
    one task learns from their buckets, so that the driver holds the model alone. All terms of the sample are learned from, so that pairs of terms count that differ
    in no class by themselves. As many rare terms fit noise, a narrow machine is fitted too, and the two are weighed by
    documents held out of both, then fitted again on all: their sum is one machine, of the factors of both. A null label
    or id is no label; an id with several labels is toxic if one of them says so.
    """
    spark = docs.sparkSession
    text_batches(spark)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold_of(F.col("doc_id"), 4) != 2))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    known = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS), "toxic-sample")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    # Held out by id, as fold 2 is.
    texts = texts.select("text", "label", (F.floor(fold_of(F.col("doc_id"), 4 * WEIGHED) / 4) == 0).alias("held"))
    rows = materialize(texts.mapInPandas(_training_terms, "label int, held boolean, terms binary"), "toxic-terms")
    found = materialize(rows.repartition(1).mapInPandas(_learned, "model binary"), "toxic-model").collect()
    return pickle.loads(found[0]["model"]) if found else learn([])


def _learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The model of all rows of a partition."""
    rows = [(int(label), bytes(terms), bool(held)) for pdf in batches for label, held, terms in zip(pdf["label"], pdf["held"], pdf["terms"], strict=True)]
    yield pd.DataFrame({"model": [pickle.dumps(learn(rows))]})


def learn(rows: list[tuple[int, bytes, bool]]) -> dict:
    """The model of (label, buckets, held out of the weighing) of documents, whatever their order."""
    rows = sorted(rows)
    label = np.array([r[0] for r in rows], float)
    used = np.unique(np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(r[1], np.int32) for r in rows)]))
    index = np.full(BUCKETS, -1, np.int32)
    n, n1 = len(label), label.sum()
    if not 0 < n1 < n:
        share = float(np.clip(n1 / n if n else 0.5, 0.01, 0.99))
        return {"index": index, "b": float(np.log(share / (1 - share))), "w": np.zeros(0), "v": np.zeros((0, FACTORS))}
    index[used] = np.arange(len(used))
    lists = [index[np.frombuffer(r[1], np.int32)] for r in rows]
    held = np.array([r[2] for r in rows])
    weights = np.array([0, 0.5, 0.5])
    if all(0 < label[k].sum() < k.sum() for k in (held, ~held)):
        machines = _machines([x for x, k in zip(lists, held, strict=True) if not k], label[~held], len(used))
        indptr, at = _rows([x for x, k in zip(lists, held, strict=True) if k])
        of = np.repeat(np.arange(held.sum()), np.diff(indptr))
        weights = _weigh(np.column_stack([_logits(at, of, held.sum(), m) for m in machines]), label[held])
    machines = _machines(lists, label, len(used))
    b = weights[0] + sum(c * m["b"] for c, m in zip(weights[1:], machines, strict=True))
    w = sum(c * m["w"] for c, m in zip(weights[1:], machines, strict=True))
    v = np.hstack([np.sqrt(c) * m["v"] for c, m in zip(weights[1:], machines, strict=True)])
    return {"index": index, "b": float(b), "w": w.astype(np.float32), "v": v.astype(np.float32)}


def scores(texts: list[str | None], model: dict, cache: dict[str, int]) -> np.ndarray:
    """Probability of label 1 for each text; the cache holds the buckets of words."""
    lists = []
    for text in texts:
        at = model["index"][np.array(sorted(term_buckets(text, cache)), np.int64)]
        lists.append(at[at >= 0])
    _, at = _rows(lists)
    return 1 / (1 + np.exp(-_logits(at, np.repeat(np.arange(len(lists)), [len(x) for x in lists]), len(lists), model)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of docs, with score and predicted (columns of these names are replaced), without a shuffle.

    Null and empty texts get the score of no terms. The model is bounded by BUCKETS.
    """
    spark = docs.sparkSession
    text_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, int] = {}
        for texts in batches:
            yield pd.Series(scores(list(texts), sent.value, cache))

    return docs.withColumn("score", toxic(F.coalesce("text", F.lit("")))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
