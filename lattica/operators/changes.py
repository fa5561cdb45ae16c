"""Ingestion runs, differences and reviewable changes as plain tables.

Runs carry their namespace: the same file in two namespaces is two sources.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLAN_SECONDS = 3600
RUN_KEY = ["namespace_id", "source_path", "source_hash", "extractor_version"]


def unseen(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Files (RUN_KEY) that no succeeded run has covered with the same bytes and extractor."""
    return files.join(runs.filter("status = 'succeeded'").select(*RUN_KEY).distinct(), RUN_KEY, "left_anti")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last succeeded run of each source: namespace_id, source_path, run_id, completed_at."""
    best = F.max(F.struct("completed_at", "run_id")).alias("best")
    return runs.filter("status = 'succeeded'").groupBy("namespace_id", "source_path").agg(best).select("namespace_id", "source_path", F.col("best.run_id").alias("run_id"), F.col("best.completed_at").alias("completed_at"))


def gone(before: DataFrame, now: DataFrame, key: str = "id") -> DataFrame:
    """What a source emitted in its run before, but doesn't now."""
    return before.join(now.select(key).distinct(), key, "left_anti")


def trim(rows: DataFrame, lost: DataFrame, key: str = "id") -> DataFrame:
    """rows (key, source_paths) without the (key, source_path) of lost: op is delete, trim or keep.

    A row without any source counts as deleted once it is lost. Only rows that lose something are changed.
    """
    paths = lost.groupBy(key).agg(F.collect_set("source_path").alias("lost"))
    out = rows.join(paths, key, "left").withColumn("left", F.when(F.col("lost").isNull(), F.col("source_paths")).otherwise(F.array_except("source_paths", "lost")))
    op = F.when(F.col("lost").isNull(), "keep").when(F.size("left") == 0, "delete").otherwise("trim")
    return out.withColumn("op", op).drop("lost", "source_paths").withColumnRenamed("left", "source_paths")


def trim_refs(rows: DataFrame, lost: DataFrame) -> DataFrame:
    """trim for rows whose sources are source_refs (source_path, ...): op, and the refs that are left."""
    paths = lost.groupBy("id").agg(F.collect_set("source_path").alias("lost"))
    out = rows.join(paths, "id", "left")
    refs = F.filter(F.coalesce("source_refs", F.array().cast(rows.schema["source_refs"].dataType)), lambda r: ~F.array_contains(F.col("lost"), r["source_path"]))
    out = out.withColumn("source_refs", F.when(F.col("lost").isNull(), F.col("source_refs")).otherwise(refs))
    op = F.when(F.col("lost").isNull(), "keep").when(F.size("source_refs") == 0, "delete").otherwise("trim")
    return out.withColumn("op", op).drop("lost")


def append_emitted(links: DataFrame, run_id: str, ids: list[str], key: str) -> DataFrame:
    """The bridge of runs and what they emitted (run_id, key), with more of a run; what it has already is not repeated."""
    more = links.sparkSession.createDataFrame([(run_id, i) for i in ids], f"run_id string, {key} string")
    return links.select("run_id", key).unionByName(more).distinct()


def apply_diff(entities: DataFrame, relations: DataFrame, lost_entities: DataFrame, lost_relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after a difference: relations first, then entities, with the relations of deleted ones."""
    kept = trim(relations, lost_relations).filter("op <> 'delete'").drop("op")
    marked = trim(entities, lost_entities)
    dead = marked.filter("op = 'delete'").select("id")
    for end in ("from_id", "to_id"):
        kept = kept.join(dead.withColumnRenamed("id", end), end, "left_anti")
    return marked.filter("op <> 'delete'").drop("op"), kept.select(*relations.columns)


def split_relations(relations: DataFrame, moved_paths: list[str], decisions: dict[str, str] | None = None) -> DataFrame:
    """What becomes of each relation of an entity that is split: move, keep or ask, by decision, then by sources."""
    given = F.create_map(*[F.lit(x) for pair in (decisions or {}).items() for x in pair]) if decisions else None
    said = F.try_element_at(given, F.col("id")) if decisions else F.lit(None).cast("string")
    moved = F.array(*[F.lit(p) for p in moved_paths]).cast("array<string>")
    paths = F.coalesce("source_paths", F.array().cast("array<string>"))
    by_source = (
        F.when(F.lit(not moved_paths) | (F.size(paths) == 0), "ask")
        .when(F.size(F.array_except(paths, moved)) == 0, "move")
        .when(~F.arrays_overlap(paths, moved), "keep")
        .otherwise("ask")
    )
    return relations.withColumn("decision", F.coalesce(said, by_source))


def move_endpoint(relations: DataFrame, relation_ids: list[str], old: str, new: str) -> DataFrame:
    """Relations with one end rewritten; triples that meet are merged with all their sources."""
    mine = F.col("id").isin(relation_ids)
    swap = lambda c: F.when(mine & (F.col(c) == old), F.lit(new)).otherwise(F.col(c)).alias(c)
    rows = relations.select("id", swap("from_id"), "type", swap("to_id"), "source_paths")
    return rows.groupBy("from_id", "type", "to_id").agg(F.min("id").alias("id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_paths")))).alias("source_paths"))


class Plans:
    """Plans by id, forgotten after a while without use; a plan is applied only after its preview.

    A plan is anything with base, questions (each with an id) and decisions; `lattica.graph` plans batches and splits.
    """

    def __init__(self, seconds: float = PLAN_SECONDS):
        self.seconds, self._held = seconds, {}

    def add(self, plan, key: str | None = None) -> str:
        """Hold a plan, in place of the one of the same key; its preview has to be seen (again)."""
        key = key or uuid.uuid4().hex
        self._held[key] = [plan, False, time.time()]
        return key

    def get(self, key: str):
        held = self._held.get(key)
        if held and 0 < self.seconds < time.time() - held[2]:
            held = self._held.pop(key) and None
        if held is None:
            raise KeyError(f"no plan {key}")
        held[2] = time.time()
        return held[0]

    def saw(self, key: str) -> None:
        self.get(key)
        self._held[key][1] = True

    def previewed(self, key: str) -> bool:
        self.get(key)
        return self._held[key][1]

    def drop(self, key: str) -> None:
        self._held.pop(key, None)
