"""Schema summaries, health checks and counts of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import identifier_aliases, is_self_reference, normalize
from lattica.operators.traverse import degrees, namespace

MAX_ALIASES, MAX_IDENTIFIERS, MAX_SAMPLES = 30, 2, 20


def entity_types(entities: DataFrame, examples: int = 5, *, newest: str = "id") -> DataFrame:
    """type, n, examples: names of the latest entities of each type."""
    order = Window.partitionBy("type").orderBy(F.col(newest).desc(), "id")
    ranked = entities.select("type", "name", F.row_number().over(order).alias("k")).filter(F.col("k") <= examples)
    shown = ranked.groupBy("type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), ";").alias("examples"))
    return entities.groupBy("type").agg(F.count("*").alias("n")).join(shown, "type")


def relation_types(entities: DataFrame, relations: DataFrame, most: int = 5) -> DataFrame:
    """type, from_type, to_type, n, total: the commonest type pairs of each relation type."""
    kinds = entities.select("id", F.col("type").alias("kind"))
    pairs = relations.join(kinds.withColumnsRenamed({"id": "from_id", "kind": "from_type"}), "from_id").join(kinds.withColumnsRenamed({"id": "to_id", "kind": "to_type"}), "to_id")
    counted = pairs.groupBy("type", "from_type", "to_type").agg(F.count("*").alias("n"))
    by_type = Window.partitionBy("type")
    order = by_type.orderBy(F.col("n").desc(), "from_type", "to_type")
    return counted.withColumn("total", F.sum("n").over(by_type)).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("k")


def type_counts(entities: DataFrame) -> DataFrame:
    """type, n: the commonest first, equally common ones by name."""
    return entities.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "type")


def duplicate_names(entities: DataFrame) -> DataFrame:
    """normalized_name, n, first_id of names that several entities have; empty names don't count."""
    named = entities.withColumn("normalized_name", normalize(F.col("name"))).filter("normalized_name <> ''")
    return named.groupBy("normalized_name").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def duplicate_members(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """normalized_name, ids, names, types of the given groups of duplicate_names, by id: for the samples of a report."""
    named = entities.withColumn("normalized_name", normalize(F.col("name"))).join(F.broadcast(groups.select("normalized_name")), "normalized_name")
    members = F.array_sort(F.collect_list(F.struct("id", "name", "type")))
    return named.groupBy("normalized_name").agg(members.alias("m")).select("normalized_name", *[F.col(f"m.{n}").alias(f"{n}s") for n in ("id", "name", "type")])


def overmerged(entities: DataFrame, *, max_aliases: int = MAX_ALIASES, max_identifiers: int = MAX_IDENTIFIERS) -> DataFrame:
    """id, name, reasons of entities that look like several: many aliases, many codes, or aliases that name nobody."""
    surfaces = F.concat(F.array("name"), F.col("aliases"))
    codes = F.size(F.array_distinct(F.transform(F.flatten(F.transform(surfaces, identifier_aliases)), F.lower)))
    vague = F.size(F.filter("aliases", lambda a: is_self_reference(normalize(a, unicode=False))))
    n = F.size("aliases")
    reasons = F.array_compact(
        F.array(
            F.when(n > max_aliases, F.concat(F.lit("alias_count="), n.cast("string"), F.lit(f">{max_aliases}"))),
            F.when(codes > max_identifiers, F.concat(F.lit("distinct_identifiers="), codes.cast("string"))),
            F.when(vague > 0, F.concat(F.lit("non_identifying_aliases="), vague.cast("string"))),
        )
    )
    rows = entities.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    return rows.select("id", "name", F.array_join(reasons, ";").alias("reasons")).filter("reasons <> ''")


def isolated(entities: DataFrame, relations: DataFrame) -> DataFrame:
    ends = relations.select(F.col("from_id").alias("id")).unionByName(relations.select(F.col("to_id").alias("id")))
    return entities.join(ends, "id", "left_anti")


def sampled(rows: DataFrame, order: str = "id", most: int = MAX_SAMPLES) -> tuple[int, DataFrame, bool]:
    """Exact number, the first rows as samples, and whether some are left out."""
    n = rows.count()
    return n, rows.orderBy(order).limit(most), n > most


def graph_health(entities: DataFrame, relations: DataFrame, namespace_id: str = "default", most: int = MAX_SAMPLES) -> dict:
    """What is odd in a namespace: exact counts, at most `most` samples of each kind, and whether some are left out.

    Degrees count relations within the namespace only.
    """
    mine = namespace(entities, namespace_id)
    twins = sampled(duplicate_names(mine), "normalized_name", most)
    over = sampled(overmerged(mine), "id", most)
    alone = sampled(mine.join(degrees(relations, entities, namespace_id), "id", "left_anti"), "id", most)
    return {
        "namespace_id": namespace_id,
        "entity_count": mine.count(),
        "type_counts": [tuple(r) for r in type_counts(mine).collect()],
        "duplicate_names": [r.asDict() for r in duplicate_members(mine, twins[1]).orderBy("normalized_name").collect()],
        "duplicate_name_total": twins[0],
        "overmerged": [(r["id"], r["name"], r["reasons"].split(";")) for r in over[1].collect()],
        "overmerged_total": over[0],
        "isolated": [(r["id"], r["name"], r["type"]) for r in alone[1].collect()],
        "isolated_total": alone[0],
        "truncated": twins[2] or over[2] or alone[2],
    }
