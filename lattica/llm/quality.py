"""Document quality by regularised quadratic discriminant analysis."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import fold_of, materialize, table, text_batches

#: Share of a class covariance that is replaced: by the pooled one, and then by its diagonal.
POOL, DIAGONAL = 0.2, 0.2
THRESHOLD = 0.3
STATISTICS = ["log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "stop", "other", "new_words", "new_lines", "line_words", "longest"]
_KINDS = np.zeros(256, np.int64)
_KINDS[[*range(65, 91)]] = 1
_KINDS[[*range(48, 58)]] = 2
_KINDS[[ord(c) for c in "!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"]] = 3
_KINDS[[ord(c) for c in ".,"]] = 4
_KINDS[128:] = 5


def statistics(text: str | None, kinds: np.ndarray = _KINDS) -> list[float]:
    """The transformed statistics of one whole text; shares are taken as logarithms."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    by_kind = np.bincount(kinds, by_byte, 6)
    words, lines = raw.split(), raw.split(b"\n")
    k = len(words)
    share = np.log(by_kind[1:] / max(n, 1) + 1e-3)
    return [
        np.log1p(n),
        np.log1p(k),
        np.log((n - by_byte[32]) / max(k, 1) + 1),
        *share,
        np.log(len(set(words)) / max(k, 1) + 1e-2),
        np.log(len(set(lines)) / len(lines) + 1e-2),
        np.log(k / len(lines) + 1),
        np.log1p(max(map(len, words), default=0)),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x: one row for each document, in one pass over the texts; null counts as empty."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return docs.select("doc_id", measured(F.coalesce("text", F.lit(""))).alias("x"))


def fit(stats: DataFrame, labels: DataFrame) -> dict:
    """Class means and Cholesky factors of the shrunken covariances, from moments summed over all labelled rows.

    Rows of fold 0 of 5, null ids and null labels are left out; an id with several labels counts for each class it has.
    With no rows of a class there is nothing to tell apart: scores are then the share of label 1 (0.5 without rows).
    """
    d = len(STATISTICS)
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), 5) != 0)).select("doc_id", "quality").distinct()
    x = lambda i: F.get("x", F.lit(i))
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    rows = stats.join(known, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), *[F.sum(x(i)).alias(f"m{i}") for i in range(d)], *[F.sum(x(i) * x(j)).alias(f"c{i}_{j}") for i, j in pairs]).collect()
    by = {r["quality"]: r for r in rows}
    total = sum(r["n"] for r in rows)
    if len(by) < 2:
        return {"constant": by[1]["n"] / total if 1 in by else (0.0 if by else 0.5)}
    means, covs = {}, {}
    for c, r in by.items():
        mean = np.array([r[f"m{i}"] for i in range(d)]) / r["n"]
        cov = np.zeros((d, d))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] / r["n"] - mean[i] * mean[j]
        means[c], covs[c] = mean, cov
    pooled = sum(by[c]["n"] * covs[c] for c in by) / total
    model: dict = {"mean": means, "factor": {}, "log": {}}
    for c in by:
        cov = (1 - POOL) * covs[c] + POOL * pooled
        cov = (1 - DIAGONAL) * cov + DIAGONAL * np.diag(np.diag(cov)) + 1e-4 * np.eye(d)
        factor = np.linalg.cholesky(cov)
        model["factor"][c] = np.linalg.inv(factor)
        model["log"][c] = np.log(by[c]["n"] / total) - np.log(np.diag(factor)).sum()
    return model


def log_odds(x: np.ndarray, model: dict) -> np.ndarray:
    """Difference of the classes' log densities, from Mahalanobis distances by the cached factors."""
    density = {c: model["log"][c] - 0.5 * (((x - model["mean"][c]) @ model["factor"][c].T) ** 2).sum(1) for c in (0, 1)}
    return density[1] - density[0]


def score(stats: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, predicted for each row of document_statistics."""

    @F.pandas_udf("double")
    def chance(x: pd.Series) -> pd.Series:
        if "constant" in model or not len(x):
            return pd.Series([model.get("constant", 0.0)] * len(x), dtype=float)
        return pd.Series(1 / (1 + np.exp(-np.clip(log_odds(np.array(x.tolist()).reshape(len(x), -1), model), -500, 500))))

    return stats.select("doc_id", chance("x").alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(document_statistics(table(spark, sf_dir, "documents")), "quality-statistics")
    rows = score(stats, fit(stats, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op4_quality": op4_quality}
ORACLES: dict[str, str] = {}
