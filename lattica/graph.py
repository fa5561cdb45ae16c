"""The operations of a graph as one object: reads over the current version, and changes by plan, preview and commit."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import requests
from lattica.functions.text import search_text
from lattica.operators import changes, identity, ingest, projections, search, split, statistics, traverse
from lattica.sources.store import SnapshotStore

#: Limits of requests.
MAX_NEIGHBOUR_NODES, MAX_SUBGRAPH_HOPS, MAX_RELATED_HOPS = 500, 4, 4
DROPPED_SHOWN = 5


class NotFound(KeyError):
    """An entity that a request names does not exist in its namespace."""


class KnowledgeGraph:
    """A graph in a snapshot store, with an extractor and an embedder of the caller's.

    Reads see the version that is current when they begin; the index of a version is made once for each object. Changes
    are planned, previewed, and committed against the version they were planned on.
    """

    def __init__(self, store: SnapshotStore, *, extract: ingest.Extractor = ingest.scripted, embed: Callable[[str], np.ndarray] = identity.trigram_embedding, version: str = f"p{ingest.PIPELINE_VERSION}:scripted", plan_seconds: float = changes.PLAN_SECONDS, model: str = "trigram", dimension: int = 64, **chunk_options):
        self.store, self.extract, self.embed, self.extractor_version = store, extract, embed, version
        self.plans, self.embedding, self.chunk_options = changes.Plans(plan_seconds), {"model": model, "dimension": dimension}, chunk_options
        self._index: tuple[int, traverse.GraphIndex] | None = None

    # --- reads ------------------------------------------------------------------------------------------------------

    def state(self) -> dict[str, DataFrame]:
        return ingest.state(self.store)

    def index(self) -> traverse.GraphIndex:
        version = self.store.version()
        if self._index is None or self._index[0] != version:
            now = ingest.state(self.store, version)
            self._index = version, traverse.index(now["entities"], now["relations"])
        return self._index[1]

    def _checked(self, entity_id: str, namespace_id: str) -> None:
        if not traverse.entity_exists(self.index(), entity_id, requests.namespace_id(namespace_id)):
            raise NotFound(entity_id)

    def _shown(self, ids: DataFrame) -> DataFrame:
        return projections.nodes(self.state()["entities"].join(F.broadcast(ids.select("id").distinct()), "id"))

    def _edges(self, found: DataFrame) -> DataFrame:
        return projections.edges(self.state()["relations"].join(F.broadcast(found.select("id").distinct()), "id"))

    def get_schema(self, namespace_id: str = traverse.DEFAULT) -> dict:
        """entity_types and relation_types as tables, and what vectors are made by; counts lie within the namespace."""
        now, ns = self.state(), requests.namespace_id(namespace_id)
        mine = traverse.namespace(now["entities"], ns)
        return {"entity_types": statistics.entity_types(mine, newest="updated_at"), "relation_types": statistics.relation_types(mine, now["relations"]), "embedding_info": self.embedding}

    def find_entities(self, keywords: list[str] | None = None, *, types: list[str] | None = None, limit: int = 10, offset: int = 0, include_scores: bool = False, namespace_id: str = traverse.DEFAULT) -> dict:
        """matches (nodes, with score and matched_keyword), total and offset: by keywords, else all of the namespace by id."""
        entities = traverse.namespace(self.state()["entities"], requests.namespace_id(namespace_id))
        if keywords is None:
            total, rows = traverse.page(entities, types=types, offset=offset, limit=limit)
            return {"matches": projections.nodes(rows), "total": total, "offset": offset}
        rows = entities.withColumn("search_text", search_text(F.col("name"), F.col("aliases")))
        vectors = entities.select("id", F.col("embedding").alias("vector"))
        total, found = search.find_entities(rows, keywords, vectors, [self.embed(k) for k in keywords], types=types, limit=limit, offset=offset)
        found = found if include_scores else found.drop("lexical", "dense")
        return {"matches": projections.nodes(entities).join(F.broadcast(found), "id").orderBy(F.col("score").desc(), "id"), "total": total, "offset": offset}

    def get_entity(self, entity_id: str, namespace_id: str = traverse.DEFAULT) -> dict:
        """node, and edge_counts (direction, type, n) to others of the namespace."""
        self._checked(entity_id, namespace_id)
        return {"node": projections.nodes(traverse.stored_entity(self.state()["entities"], entity_id)), "edge_counts": traverse.entity_counts(self.index(), [entity_id], namespace_id).drop("id")}

    def get_neighbors(self, entity_id: str, *, relation_types: list[str] | None = None, direction: str = "both", hops: int = 1, max_nodes: int = 100, namespace_id: str = traverse.DEFAULT) -> dict:
        if not 1 <= max_nodes <= MAX_NEIGHBOUR_NODES:
            raise ValueError("max_nodes out of range")
        self._checked(entity_id, namespace_id)
        near = traverse.expand(self.index(), [entity_id], types=requests.relation_types(relation_types), direction=direction, hops=hops, max_nodes=max_nodes, namespace_id=namespace_id)
        return {"nodes": self._shown(near.nodes), "edges": self._edges(near.edges), "truncated": near.truncated}

    def get_subgraph(self, entry_ids: list[str], *, hops: int = 2, max_nodes: int = 200, relation_types: list[str] | None = None, namespace_id: str = traverse.DEFAULT) -> dict:
        """Unknown entries are left out; the entries are given back as they were asked."""
        if not 1 <= hops <= MAX_SUBGRAPH_HOPS:
            raise ValueError("hops out of range")
        near = traverse.expand(self.index(), entry_ids, types=requests.relation_types(relation_types), hops=hops, max_nodes=max_nodes, namespace_id=requests.namespace_id(namespace_id))
        return {"nodes": self._shown(near.nodes), "edges": self._edges(near.edges), "entry_ids": list(entry_ids), "truncated": near.truncated}

    def find_path(self, from_id: str, to_id: str, *, max_hops: int = 4, max_paths: int = 5, relation_types: list[str] | None = None, namespace_id: str = traverse.DEFAULT) -> DataFrame:
        if from_id == to_id:
            raise ValueError("equal ends")
        for end in (from_id, to_id):
            self._checked(end, namespace_id)
        return traverse.shortest_paths(self.index(), from_id, to_id, max_hops=max_hops, max_paths=max_paths, types=requests.relation_types(relation_types), namespace_id=namespace_id)

    def find_related(self, seeds: list[str], *, top_k: int = 10, max_hops: int = 2, damping: float = 0.5, relation_types: list[str] | None = None, namespace_id: str = traverse.DEFAULT) -> DataFrame:
        if not 1 <= max_hops <= MAX_RELATED_HOPS:
            raise ValueError("max_hops out of range")
        return traverse.related(self.index(), seeds, top_k=top_k, max_hops=max_hops, damping=damping, types=requests.relation_types(relation_types), namespace_id=requests.namespace_id(namespace_id))

    def graph_health(self, namespace_id: str = traverse.DEFAULT, max_samples: int = statistics.MAX_SAMPLES) -> dict:
        now = self.state()
        return statistics.graph_health(now["entities"], now["relations"], requests.namespace_id(namespace_id), max_samples)

    def namespaces(self) -> DataFrame:
        """namespace_id, n: the largest first."""
        return self.state()["entities"].groupBy("namespace_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "namespace_id")

    # --- changes ----------------------------------------------------------------------------------------------------

    def _planned(self, sources: DataFrame, decisions: dict[str, str] | None = None) -> ingest.Changes:
        base = self.store.version()
        return ingest.plan(sources, ingest.state(self.store, base), base, extract=self.extract, version=self.extractor_version, embed=self.embed, decisions=decisions, **self.chunk_options)

    def ingest_plan(self, sources: DataFrame) -> dict:
        """Plan a batch of sources (namespace_id, source_path, text, seq)."""
        return self._summary(self.plans.add(self._planned(sources)))

    def ingest_content(self, content: str, source_id: str, namespace_id: str = traverse.DEFAULT) -> dict:
        """Plan one text under a name of the caller's."""
        rows = [(requests.namespace_id(namespace_id), source_id, content, 0)]
        return self.ingest_plan(self.store.spark.createDataFrame(rows, "namespace_id string, source_path string, text string, seq bigint"))

    def ingest_delete(self, source_path: str, namespace_id: str = traverse.DEFAULT) -> dict:
        base = self.store.version()
        return self._summary(self.plans.add(ingest.delete_source(ingest.state(self.store, base), source_path, requests.namespace_id(namespace_id), base)))

    def _summary(self, key: str) -> dict:
        plan = self.plans.get(key)
        n = ingest.totals(plan)
        return {"plan_id": key, "entities_created": n["entities_created"], "entities_merged": n["entities_merged"], "relations_created": plan.relations.count(), "deletion_count": n["entities_lost"] + n["relations_lost"], "open_questions": len(plan.questions), "previewed": self.plans.previewed(key), "warning_count": len(self._warnings(plan))}

    @staticmethod
    def _warnings(plan: ingest.Changes) -> list[dict]:
        """Relations dropped for want of an end: their number, and the first few."""
        n = plan.unresolved.count()
        first = plan.unresolved.orderBy("seq").limit(DROPPED_SHOWN).select("from_name", "to_name").collect() if n else []
        return [{"kind": "relation_dropped", "count": n, "pairs": [f"{r[0]} -> {r[1]}" for r in first]}] if n else []

    def ingest_preview(self, key: str) -> dict:
        """The changes one by one: new entities, merges, relations by the names of their ends ("" if unknown), deletions, questions.

        A plan counts as seen from here on.
        """
        plan = self.plans.get(key)
        before = ingest.state(self.store, plan.base)
        merges = plan.entities.filter("changed").join(before["entities"].select("id", F.col("name").alias("before_name"), F.col("blocked_aliases").alias("target_blocked_aliases")), "id")
        names = plan.entities.select("id", "name")
        relations = plan.relations
        for end in ("from", "to"):
            relations = relations.join(names.select(F.col("id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name")), f"{end}_id", "left")
        self.plans.saw(key)
        return {
            "new_entities": plan.entities.filter("not changed").select("id", "name", "type", "aliases"),
            "merges": merges.select(F.col("id").alias("target_id"), "before_name", F.col("aliases").alias("after_aliases"), "target_blocked_aliases"),
            "new_relations": relations.select("from_id", "to_id", "type", F.coalesce("from_name", F.lit("")).alias("from_name"), F.coalesce("to_name", F.lit("")).alias("to_name")),
            "deletion_count": plan.lost_entities.count() + plan.lost_relations.count(),
            "questions": plan.questions,
            "warnings": self._warnings(plan),
        }

    def ingest_resolve(self, key: str, resolutions: dict[str, str]) -> dict:
        """Answer questions by id with merge or keep; decisions add up, and the plan is worked out again under its key."""
        plan = self.plans.get(key)
        asked = {q["id"]: q for q in plan.questions}
        if unknown := {*resolutions} - asked.keys():
            raise ValueError(f"unknown questions {sorted(unknown)}")
        if wrong := {*resolutions.values()} - {"merge", "keep"}:
            raise ValueError(f"unknown decisions {sorted(wrong)}")
        decisions = dict(plan.decisions)
        for q, said in resolutions.items():
            target = asked[q]["candidate_id"]
            if said == "merge" and target is None:
                raise ValueError(f"{q}: its candidate is new itself and has no id before the commit; keep it, or ingest in two steps")
            decisions[identity.normalize_name(asked[q]["name"]) + "\x00" + asked[q]["type"]] = f"merge:{target}" if said == "merge" else "keep"
        sources = plan.sources.select("namespace_id", "source_path", "text", "seq")
        self.plans.add(self._planned(sources, decisions), key)
        return self._summary(key)

    def ingest_commit(self, key: str) -> dict:
        """Apply a plan that was seen and has no open question; refused if the graph has changed since."""
        plan = self.plans.get(key)
        if not self.plans.previewed(key) or plan.questions:
            raise RuntimeError("the plan has not been previewed, or has open questions")
        ids = plan.entities.filter("changed").select("id")
        if not ids.join(self.state()["entities"].select("id"), "id", "left_anti").isEmpty():
            raise RuntimeError("a merge target is gone; plan again")
        n = ingest.totals(plan)
        version = ingest.commit(self.store, plan)
        self.plans.drop(key)
        return {"version": version, "entities_created": n["entities_created"], "entities_updated": n["entities_merged"], "relations_created": n["relations_created"], "deletions": n["relations_lost"] + n["entities_lost"]}

    def entity_split_plan(self, entity_id: str, new_name: str, *, namespace_id: str = traverse.DEFAULT, **options) -> dict:
        now, base = self.state(), self.store.version()
        planned = split.plan(now["entities"], now["relations"], entity_id, new_name, namespace_id=requests.namespace_id(namespace_id), base=base, embed=self.embed, **options)
        return {"plan_id": self.plans.add(planned)} | split.summary(planned)

    def entity_split_preview(self, key: str) -> dict:
        planned = self.plans.get(key)
        self.plans.saw(key)
        return {"origin": planned.kept, "new_entity": planned.new, "relations": planned.relations, "questions": planned.questions}

    def entity_split_commit(self, key: str) -> dict:
        planned = self.plans.get(key)
        if not self.plans.previewed(key):
            raise RuntimeError("the plan has not been previewed")
        version = split.commit(self.store, self.state(), planned)
        self.plans.drop(key)
        n = split.summary(planned)
        return {"version": version, "origin_id": planned.origin["id"], "new_entity_id": planned.new["id"]} | {k: n[k] for k in ("aliases_moved", "source_refs_moved", "relations_moved", "relations_kept")}
