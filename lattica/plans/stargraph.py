"""A property graph over the star schema: nodes, relations, adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.traverse import GraphIndex, index

NAMESPACE = "default"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, type, description, namespace_id of regions, nations, customers, suppliers, parts and orders."""
    parts = [
        table(spark, sf_dir, "region").select(_id("R", "r_regionkey"), F.col("r_name"), F.lit("region"), F.lit("")),
        table(spark, sf_dir, "nation").select(_id("N", "n_nationkey"), F.col("n_name"), F.lit("nation"), F.lit("")),
        table(spark, sf_dir, "customer").select(_id("C", "c_custkey"), F.col("c_name"), F.lit("customer"), F.col("c_mktsegment")),
        table(spark, sf_dir, "supplier").select(_id("S", "s_suppkey"), F.col("s_name"), F.lit("supplier"), F.lit("")),
        table(spark, sf_dir, "part").select(_id("P", "p_partkey"), F.col("p_name"), F.lit("part"), F.concat_ws(" ", "p_brand", "p_type")),
        table(spark, sf_dir, "orders").select(_id("O", "o_orderkey"), F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")), F.lit("order"), F.col("o_orderpriority")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out.toDF("id", "name", "type", "description").withColumn("namespace_id", F.lit(NAMESPACE))


def relation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from_id, type, to_id, source_path: one row per mention, before relations are merged."""
    lines = table(spark, sf_dir, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    none = F.lit("star")
    rows = [
        table(spark, sf_dir, "customer").select(_id("C", "c_custkey"), F.lit("in_nation"), _id("N", "c_nationkey"), none),
        table(spark, sf_dir, "supplier").select(_id("S", "s_suppkey"), F.lit("in_nation"), _id("N", "s_nationkey"), none),
        table(spark, sf_dir, "nation").select(_id("N", "n_nationkey"), F.lit("in_region"), _id("R", "n_regionkey"), none),
        table(spark, sf_dir, "orders").select(_id("O", "o_orderkey"), F.lit("placed_by"), _id("C", "o_custkey"), none),
        lines.select(_id("O", "l_orderkey"), F.lit("contains"), _id("P", "l_partkey"), F.col("month")),
        lines.select(_id("P", "l_partkey"), F.lit("supplied_by"), _id("S", "l_suppkey"), F.col("month")),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return out.toDF("from_id", "type", "to_id", "source_path")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (from_id, type, to_id), with its id and namespace."""
    rows = relation_rows(spark, sf_dir).select("from_id", "type", "to_id").distinct()
    return rows.withColumn("id", F.concat_ws("|", "from_id", "type", "to_id")).withColumn("namespace_id", F.lit(NAMESPACE))


_indexes: dict[tuple[str, str, str], GraphIndex] = {}


def graph(spark: SparkSession, sf_dir: str, part: str = "") -> GraphIndex:
    """The index of the star graph, made once for each application and folder, as a store makes it for each version.

    part places: nations and regions lie in a namespace of their own, so that relations cross namespaces.
    """
    key = spark.sparkContext.applicationId, sf_dir, part
    if key not in _indexes:
        nodes = entities(spark, sf_dir)
        if part == "places":
            nodes = nodes.withColumn("namespace_id", F.when(F.col("type").isin("nation", "region"), "places").otherwise("default"))
        _indexes[key] = index(nodes, relations(spark, sf_dir))
    return _indexes[key]


#: The same views in SQL, to stand before a query: e (entities), m (mentions), r (relations), a (adjacency), g (degrees).
GRAPH_SQL = """
e AS (SELECT 'R' || r_regionkey AS id, r_name AS name, 'region' AS type, '' AS description FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'nation', '' FROM nation
  UNION ALL SELECT 'C' || c_custkey, c_name, 'customer', c_mktsegment FROM customer
  UNION ALL SELECT 'S' || s_suppkey, s_name, 'supplier', '' FROM supplier
  UNION ALL SELECT 'P' || p_partkey, p_name, 'part', p_brand || ' ' || p_type FROM part
  UNION ALL SELECT 'O' || o_orderkey, 'Order#' || o_orderkey, 'order', o_orderpriority FROM orders),
m AS (SELECT 'C' || c_custkey AS from_id, 'in_nation' AS type, 'N' || c_nationkey AS to_id, 'star' AS source_path FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'in_nation', 'N' || s_nationkey, 'star' FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'in_region', 'R' || n_regionkey, 'star' FROM nation
  UNION ALL SELECT 'O' || o_orderkey, 'placed_by', 'C' || o_custkey, 'star' FROM orders
  UNION ALL SELECT 'O' || l_orderkey, 'contains', 'P' || l_partkey, strftime(l_shipdate, '%Y-%m') FROM lineitem
  UNION ALL SELECT 'P' || l_partkey, 'supplied_by', 'S' || l_suppkey, strftime(l_shipdate, '%Y-%m') FROM lineitem),
r AS (SELECT DISTINCT from_id, type, to_id, from_id || '|' || type || '|' || to_id AS id FROM m),
a AS (SELECT from_id AS src, to_id AS dst, id, type FROM r UNION ALL SELECT to_id, from_id, id, type FROM r),
g AS (SELECT src AS id, count(*) AS degree FROM a GROUP BY src)
"""
