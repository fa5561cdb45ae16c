"""Graph reads: neighbours, subgraphs, shortest paths, proximity, degrees, look-ups and counts.

Reads go through an index: every relation from both of its ends, sorted by the end it starts from, with the namespace and
the degree of the other one. A frontier of a few ids then prunes the scan. Reads stay in one namespace. Result sizes that
the interface bounds (at most 5,000 nodes of a subgraph) may pass through the driver, one hop at a time; everything else
stays in tables. Ties are always broken by id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.sources.store import scratch

MAX_NODES, MAX_HOPS, MAX_SEEDS, MAX_PATH_HOPS, MAX_PATHS = 5000, 5, 20, 6, 20
DEFAULT = "default"
#: Ids that a scan takes as a filter; more are joined.
PUSHED = 1000
#: Nodes of a level that pass through the driver; larger levels are tables.
SMALL = 5000


def namespace(df: DataFrame, namespace_id: str = DEFAULT) -> DataFrame:
    """Rows of a namespace; a missing one is the default."""
    return df.filter(F.coalesce(F.col("namespace_id"), F.lit(DEFAULT)) == namespace_id)


@dataclass
class GraphIndex:
    """nodes (id, ns, degree) and edges (src, dst, id, type, forward, ns and degree of dst), each relation from both ends."""

    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession


def degrees(relations: DataFrame, entities: DataFrame | None = None, namespace_id: str = DEFAULT) -> DataFrame:
    """id, degree: incident relations of both directions; a loop counts twice.

    With entities, only relations whose ends both lie in the namespace count, as for health checks.
    """
    if entities is not None:
        mine = namespace(entities, namespace_id).select("id")
        for end in ("from_id", "to_id"):
            relations = relations.join(mine.withColumnRenamed("id", end), end, "left_semi")
    ends = relations.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def index(entities: DataFrame, relations: DataFrame, *, stored: bool = True) -> GraphIndex:
    """The index of a graph, written to the shared folder unless it is asked for a plan only.

    An end that is no entity is taken as a node of the default namespace.
    """
    ns = F.coalesce(F.col("namespace_id"), F.lit(DEFAULT)) if "namespace_id" in entities.columns else F.lit(DEFAULT)
    known = entities.select("id", ns.alias("ns")).join(degrees(relations), "id", "full")
    nodes = known.select("id", F.coalesce("ns", F.lit(DEFAULT)).alias("ns"), F.coalesce("degree", F.lit(0)).alias("degree"))
    nodes = scratch(nodes, "graph-nodes") if stored else nodes
    ends = [("from_id", "to_id", True), ("to_id", "from_id", False)]
    ways = F.explode(F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(f).alias("forward")) for a, b, f in ends])).alias("way")
    both = relations.select("id", "type", ways).select("way.src", "way.dst", "id", "type", "way.forward")
    edges = both.join(nodes.withColumnRenamed("id", "dst"), "dst").select("src", "dst", "id", "type", "forward", "ns", "degree")
    return GraphIndex(nodes, scratch(edges.repartitionByRange("src").sortWithinPartitions("src"), "graph-edges") if stored else edges)


def _ids(spark: SparkSession, ids: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], f"{name} string")


def _from(graph: GraphIndex, ids: list[str] | DataFrame, types: list[str] | None = None, direction: str = "both") -> DataFrame:
    """Edges that start from ids, of the given types and direction."""
    if direction not in ("both", "outgoing", "incoming"):
        raise ValueError(f"unknown direction {direction!r}")
    edges = graph.edges if direction == "both" else graph.edges.filter(F.col("forward") == (direction == "outgoing"))
    if types:
        edges = edges.filter(F.col("type").isin(types))
    if isinstance(ids, DataFrame):
        return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    if len(ids) <= PUSHED:
        return edges.filter(F.col("src").isin(ids))
    near = edges.filter(F.col("src").between(min(ids), max(ids)))
    return near.join(F.broadcast(_ids(graph.spark, ids, "src")), "src", "left_semi")


def _among(column: str, df: DataFrame, ids: list[str] | DataFrame, *, out: bool = False) -> DataFrame:
    """Rows of df whose column is among ids, or with out, is not."""
    if not isinstance(ids, DataFrame) and len(ids) <= PUSHED:
        here = F.col(column).isin(ids)
        return df.filter(~here if out else here)
    table = ids.withColumnRenamed("id", column) if isinstance(ids, DataFrame) else F.broadcast(_ids(df.sparkSession, ids, column))
    return df.join(table, column, "left_anti" if out else "left_semi")


def _present(graph: GraphIndex, ids: list[str], namespace_id: str) -> list[str]:
    found = {r[0] for r in graph.nodes.filter(F.col("id").isin(ids) & (F.col("ns") == namespace_id)).select("id").collect()}
    return [i for i in dict.fromkeys(ids) if i in found]


@dataclass
class Neighbourhood:
    """nodes (id, hop) and edges (id, type, from_id, to_id) of a bounded search, and whether it was cut."""

    nodes: DataFrame
    edges: DataFrame
    truncated: bool
    hops: dict[str, int]


def expand(graph: GraphIndex, seeds: list[str], *, types: list[str] | None = None, direction: str = "both", hops: int = 2, max_nodes: int = 200, namespace_id: str = DEFAULT) -> Neighbourhood:
    """Breadth first from the seeds of the namespace that exist, in hops; a hop that doesn't fit keeps its nodes of least degree.

    All seeds are kept, even above max_nodes. A cut search stops. Edges are those that an expanded node has to a node
    of the result, so two nodes of the last hop are not joined by them. Each hop is one pruned scan, which gives at most
    as many ids as there is room for.
    """
    if not 1 <= len(seeds) <= MAX_SEEDS or not 1 <= hops <= MAX_HOPS or not 1 <= max_nodes <= MAX_NODES:
        raise ValueError("seeds, hops or max_nodes out of range")
    found = dict.fromkeys(_present(graph, seeds, namespace_id), 0)
    expanded: list[str] = []
    frontier, truncated = sorted(found), False
    for hop in range(1, hops + 1):
        if not frontier or truncated:
            break
        expanded += frontier
        room = max(0, max_nodes - len(found))
        new = _among("dst", _from(graph, frontier, types, direction).filter(F.col("ns") == namespace_id), list(found), out=True)
        best = new.groupBy("dst").agg(F.first("degree").alias("degree")).orderBy("degree", "dst").limit(room + 1).collect()
        truncated = len(best) > room
        frontier = sorted(r["dst"] for r in best[:room])
        found |= dict.fromkeys(frontier, hop)
    nodes = graph.spark.createDataFrame(sorted(found.items()), "id string, hop int")
    kept = _among("dst", _from(graph, expanded, types, direction), list(found))
    start, stop = (F.when(F.col("forward"), F.col(x)).otherwise(F.col(y)) for x, y in (("src", "dst"), ("dst", "src")))
    return Neighbourhood(nodes, kept.select("id", "type", start.alias("from_id"), stop.alias("to_id")).distinct(), truncated, found)


def related(graph: GraphIndex, seeds: list[str], *, top_k: int = 10, max_hops: int = 2, damping: float = 0.5, types: list[str] | None = None, namespace_id: str = DEFAULT) -> DataFrame:
    """id, score, distance of the nodes nearest to the seeds: sums of damping to the distance, relative to the best.

    Distances are those within the subgraph around the seeds. It holds at most 2,000 nodes, so which of them are joined
    fits a matrix of bits; the pairs reach the driver as numbers.
    """
    if not 0 < damping < 1 or not 1 <= top_k <= 100:
        raise ValueError("damping or top_k out of range")
    spark = graph.spark
    near = expand(graph, seeds, types=types, hops=max_hops, max_nodes=min(2000, max(top_k * 10, 100)), namespace_id=namespace_id)
    names = sorted(near.hops)
    place = {n: k for k, n in enumerate(names)}
    numbers = spark.createDataFrame(list(place.items()), "id string, k int")
    pairs = near.edges.select("from_id", "to_id").distinct()
    for end in ("from", "to"):
        pairs = pairs.join(F.broadcast(numbers.withColumnsRenamed({"id": f"{end}_id", "k": end})), f"{end}_id")
    at = pairs.select("from", "to").toPandas().to_numpy()
    joined = np.zeros((len(names), len(names)), bool)
    joined[at[:, 0], at[:, 1]] = joined[at[:, 1], at[:, 0]] = True
    present = [place[s] for s in dict.fromkeys(seeds) if s in place]
    total, least = np.zeros(len(names)), np.full(len(names), np.inf)
    for seed in present:
        seen, front, d = np.zeros(len(names), bool), np.zeros(len(names), bool), 0
        seen[seed] = front[seed] = True
        while front.any():
            total[front] += damping**d
            least[front] = np.minimum(least[front], d)
            front, d = joined[front].any(0) & ~seen, d + 1
            seen |= front
    total[present] = 0
    best = sorted(np.flatnonzero(total), key=lambda k: (-round(total[k], 12), least[k], names[k]))[:top_k]
    top = max((total[k] for k in best), default=1.0)
    return spark.createDataFrame([(names[k], float(total[k] / top), int(least[k])) for k in best], "id string, score double, distance int")


# --- shortest paths -------------------------------------------------------------------------------------------------


def _held(df: DataFrame) -> list[str] | DataFrame:
    """The ids of df as a list if they are few, else as a written table."""
    some = [r[0] for r in df.limit(SMALL + 1).collect()]
    return sorted(some) if len(some) <= SMALL else scratch(df, "levels")


def _size(level: list[str] | DataFrame) -> int:
    return level.count() if isinstance(level, DataFrame) else len(level)


def _meet(a: list[str] | DataFrame, b: list[str] | DataFrame) -> list[str] | DataFrame:
    if isinstance(a, DataFrame) or isinstance(b, DataFrame):
        table, other = (a, b) if isinstance(a, DataFrame) else (b, a)
        return _held(_among("id", table, other))
    return sorted({*a} & {*b})


def _best_partial(graph: GraphIndex, levels: list, most: int, ends: tuple[str, str], keep: tuple[Column, ...], reverse: bool) -> DataFrame:
    """node, hub, own, nodes, edges: the best paths along the levels to each node of the last one, at most `most` for each.

    hub sums what lies strictly between; own is the share of the node itself. Sums over the rest of a path are the same
    for all partial paths to a node, so no better whole path is lost.
    """
    spark = graph.spark
    paths = spark.createDataFrame([(levels[0][0], 0.0, 0.0, [levels[0][0]], [])], "node string, hub double, own double, nodes array<string>, edges array<string>")
    for before, level in zip(levels, levels[1:], strict=False):
        steps = _among("dst", _from(graph, before), level)
        for condition in keep:
            steps = steps.filter(condition)
        grow = lambda old, new: F.concat(F.array(new), old) if reverse else F.concat(old, F.array(new))
        paths = paths.join(steps.withColumnRenamed("src", "node"), "node").select(
            F.col("dst").alias("node"),
            (F.col("hub") + F.col("own")).alias("hub"),
            F.when(F.col("dst").isin(*ends), 0.0).otherwise(F.log1p("degree")).alias("own"),
            grow(F.col("nodes"), F.col("dst")).alias("nodes"),
            grow(F.col("edges"), F.col("id")).alias("edges"),
        )
        rank = Window.partitionBy("node").orderBy(F.round("hub", 9), "edges")
        paths = paths.withColumn("k", F.row_number().over(rank)).filter(F.col("k") <= most).drop("k")
    return paths


def shortest_paths(graph: GraphIndex, start: str, end: str, *, max_hops: int = 4, max_paths: int = 5, types: list[str] | None = None, filter_first: bool = False, namespace_id: str = DEFAULT) -> DataFrame:
    """length, hub_score, nodes, edges of all shortest undirected paths, those through small nodes first.

    hub_score sums ln(1 + degree) of the nodes between. Types and the namespace are asked of the paths found, as a later
    filter; with filter_first, the types of every step. Parallel relations give several paths. The search goes from both
    ends, from the smaller level each time, and keeps only the max_paths best partial paths to each node: which paths
    come first is exact, whatever their number.
    """
    if start == end or not 1 <= max_hops <= MAX_PATH_HOPS or not 1 <= max_paths <= MAX_PATHS:
        raise ValueError("equal ends, or max_hops or max_paths out of range")
    spark = graph.spark
    none = spark.createDataFrame([], "length int, hub_score double, nodes array<string>, edges array<string>")
    if len(_present(graph, [start, end], namespace_id)) < 2:
        return none
    sides, first = ([[start]], [[end]]), types if filter_first else None
    middle: list[str] | DataFrame = []
    while not _size(middle):
        if len(sides[0]) + len(sides[1]) - 2 == max_hops:
            return none
        side = min(sides, key=lambda s: _size(s[-1]))
        new = _from(graph, side[-1], first).select(F.col("dst").alias("id")).distinct()
        for level in side:
            new = _among("id", new, level, out=True)
        side.append(_held(new))
        if not _size(side[-1]):
            return none
        middle = _meet(sides[0][-1], sides[1][-1])
    keep = (F.col("ns") == namespace_id, *([F.col("type").isin(types)] if types else []))
    halves = []
    for side, reverse in zip(sides, (False, True), strict=True):
        levels = [*side[:-1], middle] if len(side) > 1 else side
        halves.append(_best_partial(graph, levels, max_paths, (start, end), keep, reverse))
    a, b = (half.select("node", "own", *[F.col(c).alias(f"{c}_{k}") for c in ("hub", "nodes", "edges")]) for k, half in zip("ab", halves, strict=True))
    hub = F.round(F.col("hub_a") + F.col("hub_b") + F.col("own"), 9)
    nodes = F.concat("nodes_a", F.slice("nodes_b", F.lit(2), F.size("nodes_b") - 1)) if len(sides[1]) > 1 else F.col("nodes_a")
    whole = a.join(b.drop("own"), "node").select(F.concat("edges_a", "edges_b").alias("edges"), hub.alias("hub_score"), nodes.alias("nodes"))
    return whole.select(F.size("edges").alias("length"), "hub_score", "nodes", "edges").orderBy("length", "hub_score", "edges").limit(max_paths)


def pair_paths(graph: GraphIndex, entries: list[str], **options) -> list[DataFrame]:
    """The shortest paths of every pair of entries, in the order of the entries."""
    return [shortest_paths(graph, a, b, **options) for k, a in enumerate(entries) for b in entries[k + 1 :]]


# --- look-ups and counts --------------------------------------------------------------------------------------------


def entity_exists(graph: GraphIndex, entity_id: str, namespace_id: str = DEFAULT) -> bool:
    return bool(_present(graph, [entity_id], namespace_id))


def stored_entity(entities: DataFrame, entity_id: str) -> DataFrame:
    """The stored row of an id, whatever its namespace; empty if there is none."""
    return entities.filter(F.col("id") == entity_id).limit(1)


def entity_counts(graph: GraphIndex, ids: list[str], namespace_id: str = DEFAULT) -> DataFrame:
    """id, direction, type, n: relations of the given nodes of the namespace to others of it."""
    mine = _from(graph, _present(graph, ids, namespace_id)).filter(F.col("ns") == namespace_id)
    direction = F.when(F.col("forward"), "outgoing").otherwise("incoming")
    return mine.groupBy(F.col("src").alias("id"), direction.alias("direction"), "type").agg(F.count("*").alias("n"))


def entity_relations(graph: GraphIndex, entity_id: str, namespace_id: str = DEFAULT) -> DataFrame:
    """id, type, from_id, to_id of a node's relations, if both ends lie in the namespace; a loop is one row."""
    mine = _from(graph, _present(graph, [entity_id], namespace_id)).filter(F.col("ns") == namespace_id)
    ends = (F.when(F.col("forward"), F.col(a)).otherwise(F.col(b)) for a, b in (("src", "dst"), ("dst", "src")))
    return mine.select("id", "type", next(ends).alias("from_id"), next(ends).alias("to_id")).distinct()


def edge_counts(relations: DataFrame) -> DataFrame:
    """id, direction, type, n: relations of every node by direction and type."""
    ways = F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.lit("outgoing").alias("direction")), F.struct(F.col("to_id").alias("id"), F.lit("incoming").alias("direction"))))
    return relations.select("type", ways.alias("w")).groupBy("w.id", "w.direction", "type").agg(F.count("*").alias("n"))


def page(entities: DataFrame, *, types: list[str] | None = None, offset: int = 0, limit: int = 100, namespace_id: str | None = None) -> tuple[int, DataFrame]:
    """All matches' number, and one page of them by id."""
    rows = entities if namespace_id is None else namespace(entities, namespace_id)
    rows = rows.filter(F.col("type").isin(types)) if types else rows
    return rows.count(), rows.orderBy("id").offset(offset).limit(limit)


def hub_score(degrees_between: list[int]) -> float:
    return sum(math.log1p(d) for d in degrees_between)
