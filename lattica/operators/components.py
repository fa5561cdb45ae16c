"""Connected components of a graph of numbers, and joins by similarity that feed them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.store import scratch

#: Vectors of a block; each pair of blocks of a kind is compared in one task.
BLOCK = 2048
#: Edges that pass through the driver at most.
SMALL = 20_000


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that each node of edges (a, b) is connected to.

    Up to SMALL edges are joined on the driver, as a micro-batch has few; more in rounds, with the same result. Every round, nodes above a node are hung under the least of its neighbours, then all neighbours below it are; each
    is one grouped minimum. Rounds are written to the shared folder, and end when nothing moves.
    """
    edges = scratch(edges.select("a", "b").distinct(), "links")
    some = edges.limit(SMALL + 1).toPandas()
    if len(some) <= SMALL:
        return _joined(edges.sparkSession, some)
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("w")
        around = now.select(ways).select("w.u", "w.v")
        lowest = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = around.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lowest = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(lowest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("w"))
        now = scratch(down.select("w.u", "w.v").filter("u <> v").distinct(), "links")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == before:
            break
        before = state
    # The least node of each is under none; edges of a node with itself are all it may have.
    own = edges.select(F.col("a").alias("u")).unionByName(edges.select(F.col("b").alias("u"))).withColumn("v", F.col("u"))
    return now.select("u", "v").unionByName(own).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _joined(spark: SparkSession, edges: pd.DataFrame) -> DataFrame:
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while parent.setdefault(k, k) != k:
            parent[k] = k = parent[parent[k]]
        return k

    for a, b in zip(edges["a"].tolist(), edges["b"].tolist(), strict=True):
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return spark.createDataFrame([(k, root(k)) for k in list(parent)], "node bigint, component bigint")


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of near that join nodes which no pair before them has joined."""
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while parent.setdefault(k, k) != k:
            parent[k] = k = parent[parent[k]]
        return k

    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = root(int(left[i])), root(int(right[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(left[i]), int(right[j])))
    return out


def similar(vectors: DataFrame, least: float, block: int | None = None) -> DataFrame:
    """a, b: pairs of nodes of one kind with a cosine of at least `least`, enough of them to connect all such pairs.

    vectors: kind, node, vector. Nodes of a kind are dealt into blocks; each pair of blocks is one matrix product in a
    task, which gives a forest and so never more rows than it has nodes. Vectors of other lengths and zero vectors are
    like none.
    """
    block = block or BLOCK
    chunks = vectors.groupBy("kind").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    dealt = vectors.join(chunks, "kind").withColumn("side", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    chunk = F.least("side", "other") * F.col("chunks") + F.greatest("side", "other")
    rows = dealt.select("kind", chunk.alias("chunk"), "side", "node", "vector").repartition("kind", "chunk").sortWithinPartitions("kind", "chunk")

    def joined(rows: list[tuple]) -> pd.DataFrame:
        out = []
        for size in {len(r[2]) for r in rows} - {0}:
            mine = [r for r in rows if len(r[2]) == size]
            sides, nodes = np.array([r[0] for r in mine]), np.array([r[1] for r in mine])
            m = np.stack([r[2] for r in mine]).astype(float)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            first = sides == sides.min()
            one, two = (m[first], m[~first]) if not first.all() else (m, m)
            left, right = (nodes[first], nodes[~first]) if not first.all() else (nodes, nodes)
            out += _forest(one @ two.T >= least - 1e-9, left, right)
        return pd.DataFrame(out, columns=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for pdf in batches:
            for kind, chunk, *row in zip(pdf["kind"], pdf["chunk"], pdf["side"], pdf["node"], pdf["vector"], strict=True):
                if (kind, chunk) != key:
                    if len(held) > 1:
                        yield joined(held)
                    key, held = (kind, chunk), []
                held.append(tuple(row))
        if len(held) > 1:
            yield joined(held)

    return rows.mapInPandas(run, "a bigint, b bigint")
