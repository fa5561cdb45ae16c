"""Splitting an entity that holds two: a plan over one entity and its relations, its preview and its application."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import SELF_REFERENCES
from lattica.operators import changes, identity, traverse
from lattica.operators.identity import normalize_name
from lattica.sources.store import SnapshotStore


@dataclass
class Split:
    """What a split would do: the entity as it stays, the new one, and a decision for each relation (keep, move or ask)."""

    base: int
    namespace_id: str
    origin: dict
    kept: dict
    new: dict
    relations: list[dict]

    @property
    def questions(self) -> list[dict]:
        return [r for r in self.relations if r["decision"] == "ask"]


def _distinct(values) -> list[str]:
    return list(dict.fromkeys(v for v in values if v))


def plan(entities: DataFrame, relations: DataFrame, entity_id: str, new_name: str, *, move_aliases: list[str] = (), move_source_paths: list[str] = (), relation_decisions: dict[str, str] | None = None, new_description: str | None = None, namespace_id: str = traverse.DEFAULT, base: int = 0, embed: Callable[[str], np.ndarray] = identity.trigram_embedding) -> Split:
    """A split of one entity of the namespace by aliases or sources that go to the new one.

    Refused: an unknown entity, nothing to move, a name that is empty, the origin's own or another entity's of its type,
    aliases or sources that the entity lacks, all of its sources, decisions on relations that it lacks. An alias equal to
    the new name moves along and becomes the name. Each of both blocks the names of the other, so that no later merge
    joins them again.
    """
    found = traverse.namespace(traverse.stored_entity(entities, entity_id), namespace_id).collect()
    if not found:
        raise KeyError(f"no entity {entity_id}")
    origin = found[0].asDict(recursive=True)
    if not move_aliases and not move_source_paths:
        raise ValueError("a split needs aliases or sources to move")
    key, own = normalize_name(new_name), normalize_name(origin["name"])
    if not key or key == own:
        raise ValueError("the new name is empty or that of the entity")
    same = traverse.namespace(entities, namespace_id).filter((F.col("type") == origin["type"]) & (F.col("id") != entity_id))
    if not same.filter((F.col("normalized_name") == key) | F.array_contains(F.coalesce("normalized_aliases", F.array().cast("array<string>")), key)).isEmpty():
        raise ValueError(f"an entity named {new_name!r} exists")
    surface = {normalize_name(a): a for a in origin["aliases"] or [] if normalize_name(a)}
    paths = _distinct(r["source_path"] for r in origin["source_refs"] or [])
    if unknown := [a for a in move_aliases if normalize_name(a) not in surface] + [p for p in move_source_paths if p not in paths]:
        raise ValueError(f"the entity lacks {unknown}")
    if paths and {*paths} <= {*move_source_paths}:
        raise ValueError("all sources would move")
    moved = {normalize_name(a) for a in move_aliases} - {""} | ({key} & surface.keys())
    keys = lambda aliases: [k for k in map(normalize_name, aliases) if k and k not in SELF_REFERENCES]
    kept_aliases = [a for a in origin["aliases"] or [] if normalize_name(a) not in moved]
    new_aliases = [a for k, a in surface.items() if k in moved and k != key]
    refs = origin["source_refs"] or []
    kept = origin | {
        "aliases": kept_aliases,
        "normalized_aliases": keys(kept_aliases),
        "source_refs": [r for r in refs if r["source_path"] not in move_source_paths],
        "blocked_aliases": _distinct([*(origin["blocked_aliases"] or []), key, *keys(new_aliases)]),
    }
    new = origin | {
        "id": entities.sparkSession.range(1).select(identity.entity_id(F.lit(namespace_id), F.lit(origin["type"]), F.lit(new_name), F.lit(f"split:{entity_id}:{base}"))).first()[0],
        "name": new_name,
        "normalized_name": key,
        "aliases": new_aliases,
        "normalized_aliases": keys(new_aliases),
        "description": origin["description"] if new_description is None else new_description,
        "source_refs": [r for r in refs if r["source_path"] in move_source_paths],
        "blocked_aliases": _distinct([own, *keys(kept_aliases)]),
        "embedding": [float(x) for x in embed(new_name)],
    }
    ends = traverse.namespace(entities, namespace_id).select("id", "name")
    touching = relations.filter((F.col("from_id") == entity_id) | (F.col("to_id") == entity_id))
    touching = touching.withColumn("direction", F.when(F.col("from_id") == entity_id, "outgoing").otherwise("incoming"))
    touching = touching.withColumn("other_id", F.when(F.col("direction") == "outgoing", F.col("to_id")).otherwise(F.col("from_id")))
    touching = touching.join(ends.select(F.col("id").alias("other_id"), F.col("name").alias("other_name")), "other_id")
    decided = changes.split_relations(touching, list(move_source_paths), relation_decisions)
    rows = decided.select("id", "type", "direction", "other_id", "other_name", F.array_sort(F.coalesce("source_paths", F.array().cast("array<string>"))).alias("source_paths"), "decision").orderBy("id").collect()
    if unknown := {*(relation_decisions or {})} - {r["id"] for r in rows}:
        raise ValueError(f"the entity lacks relations {sorted(unknown)}")
    return Split(base, namespace_id, origin, kept, new, [r.asDict() for r in rows])


def summary(split: Split) -> dict:
    count = lambda d: sum(r["decision"] == d for r in split.relations)
    return {
        "origin_id": split.origin["id"], "origin_name": split.origin["name"], "new_name": split.new["name"],
        "aliases_moved": len(split.new["aliases"]), "aliases_kept": len(split.kept["aliases"]),
        "source_refs_moved": len(split.new["source_refs"]), "source_refs_kept": len(split.kept["source_refs"]),
        "relations_moved": count("move"), "relations_kept": count("keep"), "open_questions": len(split.questions),
    }


def apply(entities: DataFrame, relations: DataFrame, split: Split) -> tuple[DataFrame, DataFrame]:
    """Both tables after the split; refused while a relation is undecided, or if the entity is gone."""
    if split.questions:
        raise RuntimeError(f"undecided relations: {[r['id'] for r in split.questions]}")
    if traverse.namespace(traverse.stored_entity(entities, split.origin["id"]), split.namespace_id).isEmpty():
        raise RuntimeError("the entity is gone; plan again")
    rows = entities.sparkSession.createDataFrame([[row[c] for c in entities.columns] for row in (split.kept, split.new)], entities.schema)
    after = entities.filter(F.col("id") != split.origin["id"]).unionByName(rows)
    moved = [r["id"] for r in split.relations if r["decision"] == "move"]
    return after, changes.move_endpoint(relations, moved, split.origin["id"], split.new["id"])


def commit(store: SnapshotStore, before: dict[str, DataFrame], split: Split) -> int:
    """Publish the tables after the split; only its namespace is written anew."""
    mine = [before[n].filter(F.col("namespace_id") == split.namespace_id) for n in ("entities", "relations")]
    entities, relations = apply(*mine, split)
    return store.publish({"entities": entities, "relations": relations}, split.base, namespaces=[split.namespace_id])
