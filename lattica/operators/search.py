"""Lexical and dense search with rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.sources.store import scratch

K1, B, RRF_K = 1.2, 0.75, 60
#: Query vectors that are compared with a block of rows at a time.
QUERY_ROWS = 20_000
#: Query vectors of one matrix product; rows come in Arrow batches of 10,000 at most.
TILE = 1024


def tokens(text):
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25(rows: DataFrame, keywords: list[str], limit: int, *, text: str = "search_text") -> DataFrame:
    """id, matched_keyword, score: the best rows of each keyword (k1 1.2, b 0.75), ties by id. Empty keywords are skipped.

    Only postings of the asked terms leave the scan.
    """
    asked = [(k, t) for k in dict.fromkeys(keywords) for t in dict.fromkeys(_query_tokens(k))]
    spark = rows.sparkSession
    if not asked:
        return spark.createDataFrame([], "id string, matched_keyword string, score double")
    terms = F.broadcast(spark.createDataFrame(asked, "matched_keyword string, term string"))
    split = rows.select("id", tokens(F.col(text)).alias("tokens"))
    own = F.filter("tokens", lambda t: t.isin([t for _, t in asked]))
    return _best(split, split.select("id", F.size("tokens").alias("dl"), F.explode(own).alias("term")), terms, limit)


def bm25_of(rows: DataFrame, keywords: DataFrame, limit: int, *, text: str = "search_text") -> DataFrame:
    """bm25 of the keywords of a table of any size (matched_keyword), joined by their terms."""
    asked = keywords.select("matched_keyword").distinct().select("matched_keyword", F.explode(F.array_distinct(tokens(F.col("matched_keyword")))).alias("term"))
    split = rows.select("id", tokens(F.col(text)).alias("tokens"))
    found = split.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    return _best(split, found, asked, limit)


def _best(split: DataFrame, found: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    n, average = split.agg(F.count("*"), F.avg(F.size("tokens"))).first()
    postings = found.groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(average or 1.0)))
    hits = postings.join(df, "term").join(asked, "term").groupBy("id", "matched_keyword").agg(F.round(F.sum(score), 6).alias("score"))
    best = Window.partitionBy("matched_keyword").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit).drop("rank")


def _query_tokens(keyword: str) -> list[str]:
    import re

    return [t for t in re.split(r"[^\w]+|_", keyword.lower()) if t]


def dense(queries: DataFrame, rows: DataFrame, limit: int, *, same: str | None = None) -> DataFrame:
    """query, id, similarity: the rows of greatest cosine for each query vector, exact; ties by id.

    queries has query and vector, rows id and vector; same names a column of both that must be equal. Every block of
    rows meets all queries, a tile of both at a time, and keeps its best, so no pair is emitted beyond limit a block. The
    query set is counted first and taken in parts of QUERY_ROWS, each of which is sent to the tasks once. Vectors of
    another length than the query's, empty and zero vectors have similarity 0; null vectors give no hit.
    """
    extra = [same] if same else []
    held = queries.filter("vector is not null").select("query", "vector", *extra)
    parts = max(1, -(-held.count() // QUERY_ROWS))
    out = None
    for part in range(parts):
        asked = held.filter(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).orderBy("query").toPandas()
        found = _block(rows.select("id", "vector", *extra), asked, limit, same, rows.schema["id"].dataType.simpleString(), queries.schema["query"].dataType.simpleString())
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit).select("query", "id", "similarity")


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _best_of(near: np.ndarray, limit: int) -> np.ndarray:
    """Columns of the greatest entries of each row, in falling order, the first of equal ones; in the time of a partition.

    Columns equal to the last one taken are all looked at, so ties are cut by their order.
    """
    if near.shape[1] <= limit:
        return np.argsort(-near, axis=1, kind="stable")
    least = np.partition(near, near.shape[1] - limit, axis=1)[:, near.shape[1] - limit]
    out = np.empty((len(near), limit), np.int64)
    for q, (row, cut) in enumerate(zip(near, least, strict=True)):
        some = np.flatnonzero(row >= cut)
        out[q] = some[np.argsort(-row[some], kind="stable")[:limit]]
    return out


def _block(rows: DataFrame, asked: pd.DataFrame, limit: int, same: str | None, id_type: str, query_type: str) -> DataFrame:
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sizes = np.array([len(v) for v in asked["vector"]], int)
    for size in {*sizes.tolist()} - {0}:
        at = np.flatnonzero(sizes == size)
        by_size[size] = at, _unit(np.stack([np.asarray(asked["vector"].iloc[k], float) for k in at]))
    names = asked["query"].to_numpy(), asked[same].to_numpy() if same else None
    sent = rows.sparkSession.sparkContext.broadcast((by_size, names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_size, (queries, kinds) = sent.value
        for pdf in batches:
            pdf = pdf[pdf["vector"].notna()].sort_values("id")
            out = []
            for size, (at, vectors) in by_size.items():
                mine = pdf[[len(v) == size for v in pdf["vector"]]]
                if not len(mine):
                    continue
                ids, others = mine["id"].to_numpy(), _unit(np.stack(mine["vector"].to_list()).astype(float))
                for k in range(0, len(at), TILE):
                    some = at[k : k + TILE]
                    near = np.round(vectors[k : k + TILE] @ others.T, 6)
                    if same:
                        near[kinds[some][:, None] != mine[same].to_numpy()[None, :]] = -2
                    for q, row in enumerate(_best_of(near, limit)):
                        out += [(queries[some[q]], ids[j], near[q, j]) for j in row if near[q, j] > -2]
            yield pd.DataFrame(out, columns=["query", "id", "similarity"])

    return rows.mapInPandas(run, f"query {query_type}, id {id_type}, similarity double")


def fuse(lexical: DataFrame, dense_hits: DataFrame, kinds: DataFrame | None = None, types: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """id, matched_keyword, score, lexical, dense: reciprocal ranks of both lists summed over keywords, relative to the best.

    lexical has id, matched_keyword, score; dense_hits the same with similarities. A node's keyword is the one that
    gives it most, then the one with the greater raw scores, then the first of order (by name without one); lexical and
    dense are its raw scores there. Types are asked after the fusion (kinds: id, type), and the best of what is left has
    score 1.
    """
    rank = Window.partitionBy("matched_keyword").orderBy(F.col("score").desc(), "id")
    ranked = lambda df, name: df.select("id", "matched_keyword", "score", F.lit(name).alias("list")).withColumn("r", F.row_number().over(rank))
    both = ranked(lexical, "lexical").unionByName(ranked(dense_hits, "dense"))
    raw = lambda name: F.coalesce(F.max(F.when(F.col("list") == name, F.col("score"))), F.lit(0.0)).alias(name)
    place = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("matched_keyword")) if order else F.lit(0)
    by_keyword = both.groupBy("id", "matched_keyword").agg(F.sum(1 / (F.lit(RRF_K) + F.col("r"))).alias("part"), raw("lexical"), raw("dense"))
    best = F.min(F.struct(-F.round("part", 12), -F.round(F.col("lexical") + F.col("dense"), 6), place.alias("place"), "matched_keyword", "lexical", "dense")).alias("best")
    nodes = by_keyword.groupBy("id").agg(F.sum("part").alias("total"), best)
    if types:
        nodes = nodes.join(kinds.filter(F.col("type").isin(types)).select("id"), "id", "left_semi")
    top = nodes.agg(F.max("total").alias("top"))
    return nodes.join(F.broadcast(top)).select("id", "best.matched_keyword", F.round(F.col("total") / F.col("top"), 6).alias("score"), "best.lexical", "best.dense")


#: Limits of a search: hits of each keyword in each list, and rows of a page.
MOST_LIMIT, MOST_KEYWORDS = 200, 32


def find_entities(entities: DataFrame, keywords: list[str], vectors: DataFrame, asked: list[list[float]], *, types: list[str] | None = None, limit: int = 10, offset: int = 0, text: str = "search_text") -> tuple[int, DataFrame]:
    """The number of all matches, and a page of them (id, matched_keyword, score, lexical, dense): lexical and dense hits fused.

    entities: id, type and text, of one namespace; vectors: id, vector of them; asked: a vector for each keyword, as many
    as there are keywords. Blank keywords find nothing by words. Similarities below 0 count as 0. Ties by id.
    """
    if not 1 <= len(keywords) <= MOST_KEYWORDS or not 1 <= limit <= MOST_LIMIT or offset < 0:
        raise ValueError("keywords, limit or offset out of range")
    if len(asked) != len(keywords):
        raise ValueError(f"{len(asked)} vectors for {len(keywords)} keywords")
    spark, pool = entities.sparkSession, min(50, max(limit * 2, 10))
    told = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in dict(zip(keywords, asked, strict=True)).items()], "query string, vector array<double>")
    near = dense(told, vectors, pool).select("id", F.col("query").alias("matched_keyword"), F.greatest(F.lit(0.0), "similarity").alias("score"))
    fused = fuse(bm25(entities, keywords, pool, text=text), near, entities.select("id", "type"), types, list(dict.fromkeys(keywords)))
    # At most 2 * 50 * 32 rows are left here.
    fused = scratch(fused, "fused")
    return fused.count(), fused.orderBy(F.col("score").desc(), "id").offset(offset).limit(limit)


def distinct_chunks(*hits: DataFrame, limit: int) -> DataFrame:
    """Union of chunk hits, the best score of each (source_path, chunk_index), in falling order."""
    out = hits[0]
    for more in hits[1:]:
        out = out.unionByName(more)
    return out.groupBy("source_path", "chunk_index").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "source_path", "chunk_index").limit(limit)
