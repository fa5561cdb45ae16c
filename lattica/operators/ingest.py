"""Ingestion of documents into a graph as change sets: what a batch of sources would change, and its application.

A batch is a table of sources (namespace_id, source_path, text, and order by seq). `plan` works out all changes without
writing any; `apply` gives the tables after them. Ingesting at once is both together. Identity is resolved in the order
of the mentions over the whole batch; relations are resolved once all of its entities are known, so that the pass over
one file and the later one over all files are one join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import chunking
from lattica.functions.text import head_lines, identifier_aliases
from lattica.operators import changes, identity
from lattica.sources.store import SnapshotStore, scratch

PIPELINE_VERSION = 2
#: Columns of what an extractor gives of units (namespace_id, source_path, chunk_index, total_chunks, text).
ENTITY = "namespace_id string, source_path string, chunk_index int, total_chunks int, pos bigint, name string, type string, aliases array<string>, description string, matched_existing_id string"
RELATION = "namespace_id string, source_path string, chunk_index int, pos bigint, from_name string, type string, to_name string"
FAILURE = "namespace_id string, source_path string, error string"
#: Columns of stored tables.
STATE = {
    "entities": f"id string, namespace_id string, name string, normalized_name string, type string, aliases array<string>, normalized_aliases array<string>, blocked_aliases array<string>, description string, embedding array<double>, source_refs {identity.SOURCE_REFS}, created_at timestamp, updated_at timestamp",
    "relations": "id string, namespace_id string, from_id string, type string, to_id string, source_paths array<string>, emitted_in_run_ids array<string>, created_at timestamp, updated_at timestamp",
    "runs": "run_id string, namespace_id string, source_path string, source_hash string, extractor_version string, status string, error string, started_at timestamp, completed_at timestamp",
    "run_entities": "run_id string, entity_id string",
    "run_relations": "run_id string, relation_id string",
}
Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]]


def state(store: SnapshotStore, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of a version of the graph; empty ones where it has none."""
    return {name: (found if (found := store.read(name, version)) is not None else store.spark.createDataFrame([], schema)) for name, schema in STATE.items()}


def scripted(units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The deterministic stand-in for an extractor: node and relation lines of the texts."""
    key = F.to_json(F.struct("namespace_id", "source_path", "chunk_index", "total_chunks"))
    said = identity.scripted_extraction(units.select(key.alias("doc_id"), "text"))
    at = F.from_json("doc_id", "namespace_id string, source_path string, chunk_index int, total_chunks int").alias("u")
    none = F.array().cast("array<string>")
    rows = said.select(at, F.col("line").cast("bigint").alias("pos"), "kind", "a", "b", "c")
    entities = rows.filter("kind = 'entity'").select("u.*", "pos", F.col("a").alias("name"), F.col("b").alias("type"), none.alias("aliases"), F.lit("").alias("description"), F.lit(None).cast("string").alias("matched_existing_id"))
    relations = rows.filter("kind = 'relation'").select("u.namespace_id", "u.source_path", "u.chunk_index", "pos", F.col("a").alias("from_name"), F.col("b").alias("type"), F.col("c").alias("to_name"))
    return entities, relations, units.sparkSession.createDataFrame([], FAILURE)


def called(call: Callable[[str, str], dict], *, attempts: int = 2) -> Extractor:
    """An extractor of call(source_path, text): {entities: [...], relations: [...]}, tried again once; what fails fails its source."""

    def run(batches):
        for pdf in batches:
            out = []
            for ns, path, chunk, total, text in zip(pdf["namespace_id"], pdf["source_path"], pdf["chunk_index"], pdf["total_chunks"], pdf["text"], strict=True):
                said, error = None, None
                for _ in range(attempts):
                    try:
                        said, error = call(path, text), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                out.append((ns, path, int(chunk), int(total), error, [(e["name"], e["type"], list(e.get("aliases") or []), e.get("description") or "", e.get("matched_existing_id")) for e in (said or {}).get("entities", [])], [(r["from_name"], r["type"], r["to_name"]) for r in (said or {}).get("relations", [])]))
            yield pd.DataFrame(out, columns=["namespace_id", "source_path", "chunk_index", "total_chunks", "error", "entities", "relations"])

    schema = "namespace_id string, source_path string, chunk_index int, total_chunks int, error string, entities array<struct<name:string,type:string,aliases:array<string>,description:string,matched_existing_id:string>>, relations array<struct<from_name:string,type:string,to_name:string>>"

    def extract(units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        # Written once: a call to a model is not to be repeated by a second reader.
        said = scratch(units.select("namespace_id", "source_path", "chunk_index", "total_chunks", "text").mapInPandas(run, schema), "extracted")
        place = ["namespace_id", "source_path", "chunk_index"]
        entities = said.select(*place, "total_chunks", F.posexplode("entities").alias("pos", "e")).select(*place, "total_chunks", F.col("pos").cast("bigint").alias("pos"), "e.*")
        relations = said.select(*place, F.posexplode("relations").alias("pos", "r")).select(*place, F.col("pos").cast("bigint").alias("pos"), "r.*")
        return entities, relations, said.filter("error is not null").select("namespace_id", "source_path", "error")

    return extract


def units_of(sources: DataFrame, **options) -> DataFrame:
    """namespace_id, source_path, chunk_index, total_chunks, text: the chunks that an extractor is given of each source."""
    key = F.to_json(F.struct("namespace_id", "source_path"))
    at = F.from_json("doc_id", "namespace_id string, source_path string").alias("s")
    return chunking.chunks(sources.select(key.alias("doc_id"), "text"), **options).select(at, "chunk_index", "total_chunks", "text").select("s.*", "chunk_index", "total_chunks", "text")


def main_entities(sources: DataFrame, call: Callable[[str, str], dict | None], lines: int = 60) -> DataFrame:
    """namespace_id, source_path, name, type, aliases: what each source is about, asked once of its first lines.

    call(source_path, head) gives name, type and aliases, or None; a call that fails, or a blank head, gives no row.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for ns, path, head in zip(pdf["namespace_id"], pdf["source_path"], pdf["head"], strict=True):
                try:
                    said = call(path, head)
                    out += [(ns, path, str(said["name"]), str(said["type"]), [str(a) for a in said.get("aliases") or []])] if said else []
                except Exception:  # noqa: BLE001
                    continue
            yield pd.DataFrame(out, columns=["namespace_id", "source_path", "name", "type", "aliases"])

    heads = sources.select("namespace_id", "source_path", head_lines(F.coalesce("text", F.lit("")), lines).alias("head")).filter(F.col("head").rlike(r"(?U)\S"))
    return heads.mapInPandas(run, "namespace_id string, source_path string, name string, type string, aliases array<string>")


@dataclass
class Changes:
    """What a batch would change; tables are written to the shared folder, and nothing of the graph is."""

    base: int
    sources: DataFrame
    entities: DataFrame
    relations: DataFrame
    lost_entities: DataFrame
    lost_relations: DataFrame
    runs: DataFrame
    run_entities: DataFrame
    run_relations: DataFrame
    unresolved: DataFrame
    questions: list[dict]
    decisions: dict[str, str]
    #: Mentions of each step, sources taken as they are, and the mentions' resolution.
    by_step: dict[int, int] = field(default_factory=dict)
    skipped: int = 0
    resolved: DataFrame | None = None


def _ordered(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with seq, their place in the batch: by source, chunk and place in it. Numbers have gaps, so no task sees all rows."""
    at = sources.select("namespace_id", "source_path", F.col("seq").alias("source_seq"))
    inside = Window.partitionBy("namespace_id", "source_path").orderBy("chunk_index", "pos")
    return rows.join(at, ["namespace_id", "source_path"]).withColumn("seq", F.col("source_seq") * F.lit(1 << 32) + F.row_number().over(inside)).drop("source_seq")


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their rank as seq: by seq, then namespace and path. Ranks come from the sizes of sorted partitions."""
    rows = scratch(sources.orderBy("seq", "namespace_id", "source_path").withColumn("place", F.monotonically_increasing_id()), "ingest-sources")
    part = F.shiftright("place", 33)
    start, offsets = 0, []
    for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets += [F.lit(r["part"]), F.lit(start)]
        start += r["count"]
    offset = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(0)
    return rows.withColumn("seq", (offset + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint")).drop("place")


def _run_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256), 1, 26)


def plan(sources: DataFrame, before: dict[str, DataFrame], base: int = 0, *, extract: Extractor = scripted, version: str = f"p{PIPELINE_VERSION}:scripted", embed: Callable[[str], np.ndarray] = identity.trigram_embedding, decisions: dict[str, str] | None = None, match: float = identity.MATCH, ask: float = identity.ASK, batch: str | None = None, **chunk_options) -> Changes:
    """The changes of a batch of sources (namespace_id, source_path, text, seq) to the tables before.

    Sources that a succeeded run has covered with the same bytes and extractor are left as they are. The others replace
    what their last succeeded run emitted: what they emit no longer loses them as a source. A source of which a chunk
    fails emits nothing, changes nothing, and its run is failed; the other sources are not held up. decisions answer
    questions of an earlier plan by signature. Sources given twice in a batch count as their last row.
    """
    spark = sources.sparkSession
    now = F.current_timestamp()
    space = F.coalesce("namespace_id", F.lit("default"))
    last = sources.groupBy(space.alias("namespace_id"), "source_path").agg(F.max_by(F.coalesce("text", F.lit("")), "seq").alias("text"), F.max("seq").alias("seq"))
    given = _ranked(last.withColumn("source_hash", F.sha2(F.col("text").cast("binary"), 256)).withColumn("extractor_version", F.lit(version)))
    fresh = scratch(changes.unseen(given, before["runs"]).withColumn("run_id", _run_id(F.col("namespace_id"), F.col("source_path"), F.col("source_hash"), F.col("extractor_version"), F.lit(batch or str(base)))), "ingest-fresh")
    said, told, failures = extract(units_of(fresh, **chunk_options))
    failed = scratch(failures.groupBy("namespace_id", "source_path").agg(F.min("error").alias("error")), "ingest-failed")
    at = ["namespace_id", "source_path"]
    taken = fresh.join(failed.select(*at), at, "left_anti")
    mentions = _ordered(said, taken).withColumn("aliases", F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), identifier_aliases(F.col("name")))))
    mentions = scratch(mentions, "ingest-mentions")
    found = identity.resolve(mentions, before["entities"], decisions, embed=embed, match=match, ask=ask)
    # New entities are named by what first mentions them.
    first = mentions.select(F.col("seq").alias("entity_seq"), identity.entity_id(F.col("namespace_id"), F.col("type"), F.col("name"), F.concat_ws("\x1f", "source_path", F.col("seq").cast("string"), F.lit(str(base)))).alias("made"))
    found = scratch(found.join(first, "entity_seq", "left").withColumn("entity_id", F.coalesce("entity_id", "made")).drop("made"), "ingest-found")
    asked = [r.asDict() for r in identity.questions(found, mentions, before["entities"]).collect()]
    by_step = {r["step"]: r["count"] for r in found.groupBy("step").count().collect()}
    entities = identity.merged(mentions, found, before["entities"])
    entities = scratch(_embedded(entities, embed), "ingest-entities")
    relations, unresolved, emitted_relations = _relations(mentions, found, _ordered(told, taken), entities, before, fresh)
    runs_of = fresh.select(*at, "run_id")
    run_entities = scratch(mentions.join(found.select("seq", "entity_id"), "seq").join(runs_of, at).select("run_id", "entity_id").distinct(), "ingest-run-entities")
    run_relations = scratch(emitted_relations.join(runs_of, at).select("run_id", "relation_id").distinct(), "ingest-run-relations")
    runs = fresh.join(failed, at, "left").select("run_id", *at, "source_hash", "extractor_version", F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("status"), "error", now.alias("started_at"), now.alias("completed_at"))
    runs = scratch(runs, "ingest-runs")
    prior = changes.latest_runs(before["runs"]).join(runs.filter("status = 'succeeded'").select(*at, F.col("run_id").alias("new_run")), at)
    lost = lambda emitted, new, key: scratch(emitted.join(prior.select("run_id", "source_path", "new_run"), "run_id").join(new.withColumnRenamed("run_id", "new_run"), ["new_run", key], "left_anti").select(F.col(key).alias("id"), "source_path").distinct(), f"ingest-lost-{key}")
    return Changes(base, given, entities, relations, lost(before["run_entities"], run_entities, "entity_id"), lost(before["run_relations"], run_relations, "relation_id"), runs, run_entities, run_relations, unresolved, asked, decisions or {}, by_step, given.count() - fresh.count(), found)


def _embedded(entities: DataFrame, embed: Callable[[str], np.ndarray]) -> DataFrame:
    """New entities with the vector of their name; merges keep the one they have."""

    @F.pandas_udf("array<double>")
    def vector(names: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(embed(n), float) if n is not None else None for n in names], dtype=object)

    return entities.withColumn("embedding", F.coalesce("embedding", vector(F.when(F.col("embedding").isNull(), F.col("name")))))


def _upserted(new: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations of new triples (with namespace_id, paths, run_ids) as they are afterwards: what is stored gains sources and runs."""
    triple = ["from_id", "type", "to_id"]
    old = relations.select(*triple, "id", "source_paths", "emitted_in_run_ids")
    union = lambda a, b: F.array_union(F.coalesce(a, F.array().cast("array<string>")), b)
    made = F.upper(F.substring(F.sha2(F.concat_ws("\x1f", *triple).cast("binary"), 256), 1, 26))
    return new.join(old, triple, "left").select(F.coalesce("id", made).alias("id"), "namespace_id", *triple, union("source_paths", F.col("paths")).alias("source_paths"), union("emitted_in_run_ids", F.col("run_ids")).alias("emitted_in_run_ids"), F.col("id").isNotNull().alias("changed"))


def _relations(mentions: DataFrame, found: DataFrame, told: DataFrame, entities: DataFrame, before: dict[str, DataFrame], fresh: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Relations made or changed as they are afterwards, the mentions without an end, and (source, relation_id) emitted."""
    at = ["namespace_id", "source_path"]
    told = scratch(told.withColumn("end_id", F.col("seq")), "ingest-told")
    in_file = mentions.join(found.select("seq", "entity_id"), "seq").select(*at, "name", "entity_id", "seq")
    known = before["entities"].select("id", "namespace_id", "name", "normalized_aliases").join(entities.select("id"), "id", "left_anti").unionByName(entities.select("id", "namespace_id", "name", "normalized_aliases"))
    graph = known.withColumnRenamed("id", "entity_id")
    ends = told.select("end_id", *at, F.explode(F.array(F.struct(F.lit("from").alias("end"), F.col("from_name").alias("name")), F.struct(F.lit("to").alias("end"), F.col("to_name").alias("name")))).alias("e"))
    ends = ends.select(F.concat_ws(":", F.col("end_id").cast("string"), "e.end").alias("end_id"), *at, "e.name")
    got = identity.resolve_endpoints(ends, in_file, graph).select(F.split("end_id", ":").alias("x"), "entity_id")
    got = got.groupBy(F.get("x", F.lit(0)).cast("bigint").alias("end_id")).agg(*[F.max(F.when(F.get("x", F.lit(1)) == end, F.col("entity_id"))).alias(f"{end}_id") for end in ("from", "to")])
    linked = scratch(told.join(got, "end_id", "left"), "ingest-linked")
    unresolved = linked.filter("from_id is null or to_id is null").join(fresh.select(*at, "run_id"), at).select(*at, "run_id", "seq", "from_name", "type", "to_name", "from_id", "to_id")
    triple = ["from_id", "type", "to_id"]
    rows = linked.filter("from_id is not null and to_id is not null").join(fresh.select(*at, "run_id"), at)
    new = rows.groupBy(*triple).agg(F.min("namespace_id").alias("namespace_id"), F.array_sort(F.collect_set("source_path")).alias("paths"), F.array_sort(F.collect_set("run_id")).alias("run_ids"))
    out = _upserted(new, before["relations"])
    out = scratch(out, "ingest-relations")
    emitted = rows.join(out.select("id", *triple), triple).select(*at, F.col("id").alias("relation_id")).distinct()
    return out, scratch(unresolved, "ingest-unresolved"), emitted


def second_pass(store: SnapshotStore, unresolved: DataFrame) -> int:
    """Retry relations that earlier batches left without an end (Changes.unresolved) against the graph as it is now.

    Ends are looked up by name or alias in their namespace only, as files of one batch have been tried by the batch
    itself. What is found is published, with the run that said it; gives the number of relations recovered.
    """
    base = store.version()
    before = state(store, base)
    rows = scratch(unresolved.select("namespace_id", "source_path", "run_id", "seq", "from_name", "type", "to_name"), "second-pass")
    ends = rows.select(F.col("seq").alias("end_id"), "namespace_id", "source_path", F.explode(F.array(F.struct(F.lit("from").alias("end"), F.col("from_name").alias("name")), F.struct(F.lit("to").alias("end"), F.col("to_name").alias("name")))).alias("e"))
    none = store.spark.createDataFrame([], "namespace_id string, source_path string, name string, entity_id string, seq bigint")
    graph = before["entities"].select(F.col("id").alias("entity_id"), "namespace_id", "name", "normalized_aliases")
    key = F.concat_ws(":", "namespace_id", "source_path", F.col("end_id").cast("string"), "e.end")
    got = identity.resolve_endpoints(ends.select(key.alias("end_id"), "namespace_id", "source_path", "e.name"), none, graph).filter("entity_id is not null").select("end_id", "entity_id")
    for end in ("from", "to"):
        rows = rows.withColumn("end_id", F.concat_ws(":", "namespace_id", "source_path", F.col("seq").cast("string"), F.lit(end))).join(got.withColumnRenamed("entity_id", f"{end}_id"), "end_id").drop("end_id")
    found = scratch(rows, "second-pass-found")
    n = found.count()
    if not n:
        return 0
    triple = ["from_id", "type", "to_id"]
    new = found.groupBy(*triple).agg(F.min("namespace_id").alias("namespace_id"), F.array_sort(F.collect_set("source_path")).alias("paths"), F.array_sort(F.collect_set("run_id")).alias("run_ids"))
    out = scratch(_upserted(new, before["relations"]), "second-pass-relations")
    nothing = {name: store.spark.createDataFrame([], schema) for name, schema in STATE.items()}
    entities = store.spark.createDataFrame([], f"{STATE['entities']}, changed boolean, created_seq bigint")
    lost = store.spark.createDataFrame([], "id string, source_path string")
    emitted = found.join(out.select("id", *triple), triple).select("run_id", F.col("id").alias("relation_id")).distinct()
    commit(store, Changes(base, found, entities, out, lost, lost, nothing["runs"], nothing["run_entities"], scratch(emitted, "second-pass-emitted"), unresolved, [], {}))
    return n


def delete_source(before: dict[str, DataFrame], source_path: str, namespace_id: str = "default", base: int = 0) -> Changes:
    """The changes of taking a source out: it is compared with a source that emits nothing, and its runs are withdrawn."""
    spark = before["runs"].sparkSession
    mine = changes.latest_runs(before["runs"]).filter((F.col("source_path") == source_path) & (F.col("namespace_id") == namespace_id)).select("run_id")
    lost = lambda emitted, key: scratch(emitted.join(mine, "run_id").select(F.col(key).alias("id"), F.lit(source_path).alias("source_path")).distinct(), f"delete-{key}")
    none = {name: spark.createDataFrame([], schema) for name, schema in STATE.items()}
    gone = before["runs"].filter((F.col("source_path") == source_path) & (F.col("namespace_id") == namespace_id) & (F.col("status") == "succeeded")).withColumn("status", F.lit("withdrawn"))
    nothing = spark.createDataFrame([], f"{STATE['entities']}, changed boolean, created_seq bigint")
    unresolved = spark.createDataFrame([], "namespace_id string, source_path string, run_id string, seq bigint, from_name string, type string, to_name string, from_id string, to_id string")
    sources = spark.createDataFrame([(namespace_id, source_path)], "namespace_id string, source_path string")
    return Changes(base, sources, nothing, spark.createDataFrame([], f"{STATE['relations']}, changed boolean"), lost(before["run_entities"], "entity_id"), lost(before["run_relations"], "relation_id"), scratch(gone, "delete-runs"), none["run_entities"], none["run_relations"], unresolved, [], {})


def apply(before: dict[str, DataFrame], change: Changes) -> dict[str, DataFrame]:
    """All tables after the changes: what is made or merged, then the differences, relations before entities."""
    now = F.current_timestamp()

    def upserted(name: str, rows: DataFrame) -> DataFrame:
        columns = [c.split()[0] for c in _fields(STATE[name])]
        old = before[name]
        kept = old.join(rows.select("id"), "id", "left_anti").select(*columns)
        made = old.select("id", F.col("created_at").alias("was"))
        new = rows.drop("created_at", "updated_at").join(made, "id", "left").withColumn("created_at", F.coalesce("was", now)).withColumn("updated_at", now)
        return kept.unionByName(new.select(*columns))

    relations = changes.trim(upserted("relations", change.relations), change.lost_relations).filter("op <> 'delete'").drop("op")
    entities = changes.trim_refs(upserted("entities", change.entities), change.lost_entities)
    dead = entities.filter("op = 'delete'").select("id")
    for end in ("from_id", "to_id"):
        relations = relations.join(dead.withColumnRenamed("id", end), end, "left_anti")
    again = change.runs.select("run_id")
    runs = before["runs"].join(again, "run_id", "left_anti").unionByName(change.runs.select(*before["runs"].columns))
    add = lambda name, rows: before[name].unionByName(rows).distinct()
    columns = {name: [c.split()[0] for c in _fields(schema)] for name, schema in STATE.items()}
    return {
        "entities": entities.filter("op <> 'delete'").select(*columns["entities"]),
        "relations": relations.select(*columns["relations"]),
        "runs": runs,
        "run_entities": add("run_entities", change.run_entities),
        "run_relations": add("run_relations", change.run_relations),
    }


def _fields(schema: str) -> list[str]:
    """Columns of a schema in text form, whose types may hold commas."""
    out, depth, part = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()]


def commit(store: SnapshotStore, change: Changes) -> int:
    """Publish the tables after the changes as the next version; only namespaces that the changes touch are written anew."""
    before = state(store, change.base)
    spaces = sorted(r[0] for r in change.sources.select("namespace_id").distinct().collect())
    mine = lambda df: df.filter(F.col("namespace_id").isin(spaces))
    # What lies in other namespaces is neither read nor written, but for entities that a decision named there.
    elsewhere = change.entities.filter(~F.col("namespace_id").isin(spaces)).select("namespace_id").distinct().collect()
    spaces = sorted({*spaces, *(r[0] for r in elsewhere)})
    after = apply(before | {n: mine(before[n]) for n in ("entities", "relations")}, change)
    return store.publish(after, change.base, namespaces=spaces)


def ingest(sources: DataFrame, store: SnapshotStore, **options) -> tuple[int, Changes]:
    """Take sources in at once: the version after it, and the changes; nothing is published where all sources are known."""
    base = store.version()
    change = plan(sources, state(store, base), base, **options)
    return base if change.runs.isEmpty() else commit(store, change), change


def totals(change: Changes) -> dict[str, int]:
    """Counts over a batch: what was made, changed, deleted, trimmed and left over, and mentions by step."""
    count = lambda df, c: df.filter(c).count()
    return {
        "sources": change.sources.count(),
        "sources_skipped": change.skipped,
        "sources_failed": count(change.runs, "status = 'failed'"),
        "entities_created": count(change.entities, "not changed"),
        "entities_merged": count(change.entities, "changed"),
        "relations_created": count(change.relations, "not changed"),
        "relations_unresolved": change.unresolved.count(),
        "entities_lost": change.lost_entities.count(),
        "relations_lost": change.lost_relations.count(),
        **{f"step_{k}": n for k, n in sorted(change.by_step.items())},
    }


def isolated_new(change: Changes) -> DataFrame:
    """id, name, type of the new entities that no relation of the batch joins."""
    ends = reduce(DataFrame.unionByName, [change.relations.select(F.col(end).alias("id")) for end in ("from_id", "to_id")])
    return change.entities.filter("not changed").join(ends, "id", "left_anti").select("id", "name", "type")


def dry_run(sources: DataFrame, extract: Extractor = scripted, **chunk_options) -> DataFrame:
    """source_path, chunks, entities, relations, failed: what an extraction would find; no graph is read or written."""
    sources = sources.withColumn("namespace_id", F.coalesce("namespace_id", F.lit("default")))
    units = units_of(sources, **chunk_options)
    said, told, failed = extract(units)
    at = ["namespace_id", "source_path"]
    counted = [(units, "chunks"), (said, "entities"), (told, "relations"), (failed, "failed")]
    out = sources.select(*at).distinct()
    for df, name in counted:
        out = out.join(df.groupBy(*at).agg(F.count("*").alias(name)), at, "left")
    return out.na.fill(0, [name for _, name in counted])


def backfill(entities: DataFrame, embed: Callable[[str], np.ndarray] = identity.trigram_embedding, *, dimension: int | None = None) -> DataFrame:
    """entities with missing normalised names and aliases filled in, and vectors that are missing or of another length made anew."""
    from lattica.functions.text import SELF_REFERENCES, normalize

    none = F.array().cast("array<string>")
    keys = F.filter(F.transform(F.coalesce("aliases", none), lambda a: normalize(a, unicode=False)), lambda k: (k != "") & ~k.isin(SELF_REFERENCES))
    fits = F.size("embedding") == dimension if dimension else F.col("embedding").isNotNull()
    rows = entities.withColumn("normalized_name", F.coalesce(F.nullif("normalized_name", F.lit("")), normalize(F.col("name")))).withColumn("normalized_aliases", F.coalesce("normalized_aliases", keys))
    return _embedded(rows.withColumn("embedding", F.when(fits, F.col("embedding"))), embed)


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in STATE.items()}
