"""Identity resolution: matching mentions to entities, merging, endpoints and relations."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import DEIXIS, SELF_REFERENCES, TRIM_CHARS, distinct_by, normalize, source_ref_union
from lattica.operators.components import components, similar
from lattica.sources.store import scratch

#: Similarity of a match, and the lower end of the band that asks a question.
MATCH, ASK = 0.92, 0.82
MAX_QUESTIONS = 12


def normalize_name(name: str | None) -> str:
    """functions.text.normalize for one string, for use inside a group."""
    t = re.sub(r"\s+", " ", unicodedata.normalize("NFC", (name or "").strip()).lower())
    return t.strip(TRIM_CHARS).strip()


def identifying(normalized: str) -> bool:
    return bool(normalized) and normalized not in SELF_REFERENCES and not re.match(DEIXIS, normalized)


def trigram_embedding(text: str | None, dimension: int = 64) -> np.ndarray:
    """Deterministic stand-in for an embedder: hashed character trigrams, unit length."""
    v, padded = np.zeros(dimension), f"  {(text or '').lower()}  "
    for k in range(len(padded) - 2):
        v[int.from_bytes(hashlib.blake2b(padded[k : k + 3].encode(), digest_size=4).digest()) % dimension] += 1
    norm = math.sqrt(float(v @ v))
    return v / norm if norm else v


def trigram_row(text: str) -> list[tuple]:
    """trigram_embedding as an extractor's rows."""
    return [(trigram_embedding(text).tolist(),)]


def entity_id(namespace: Column, kind: Column, name: Column, source: Column) -> Column:
    """A deterministic id of 26 capitals and digits."""
    return F.upper(F.substring(F.sha2(F.concat_ws("\x1f", namespace, kind, name, source).cast("binary"), 256), 1, 26))


def merge_exact(mentions: DataFrame) -> DataFrame:
    """One entity per (namespace_id, type, normalized name): the batch form for exact names.

    mentions: namespace_id, name, type, description, source_path, chunk_index, seq. The first mention by seq gives the
    name, the longest description wins (the first of equal length), sources are collected once each. Names that are
    empty after normalisation are dropped. Aggregates combine before the shuffle, so a name that a third of all
    mentions share is summed up in every task first.
    """
    rows = mentions.withColumn("normalized_name", normalize(F.col("name"), unicode=False)).filter("normalized_name <> ''")
    description = F.coalesce("description", F.lit(""))
    return rows.groupBy("namespace_id", "type", "normalized_name").agg(
        F.min_by("name", "seq").alias("name"),
        F.min(F.struct(-F.length(description), "seq", description.alias("d"))).getField("d").alias("description"),
        F.array_sort(F.collect_set("source_path")).alias("source_paths"),
        F.min("seq").alias("created_seq"),
        F.count("*").alias("mentions"),
    )


#: Steps: 0 named by the extractor or a person, 1 name, 2 alias, 3 vector, 4 new.
RESOLVED = "seq bigint, entity_id string, entity_seq bigint, step int, similarity double, near_id string, near_seq bigint"


def signature(name: Column, kind: Column) -> Column:
    """What a decision of a person is remembered by: the normalised name and the type."""
    return F.concat(normalize(name), F.lit("\x00"), kind)


def _with_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """df with those of the columns that it lacks, as nulls."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in types.items() if c not in df.columns])


STORED = {"aliases": "array<string>", "normalized_aliases": "array<string>", "blocked_aliases": "array<string>", "embedding": "array<double>"}
MENTION = {"aliases": "array<string>", "matched_existing_id": "string"}
ROWS = ["id", "seq", "type", "name", "aliases", "keys", "blocked", "vector", "wanted", "keep"]


def _groups(mentions: DataFrame, stored: DataFrame, embed: Callable[[str], np.ndarray], least: float) -> DataFrame:
    """All rows with component: mentions and entities that may be matched with each other, directly or over others.

    Rows are joined by a shared key (name or alias) within a namespace and type, by an id that a mention is to be merged
    with, and by vectors of names of at least `least`. Everything the matcher asks lies within a component, so each is
    matched by itself, and a type that holds most mentions is no single task.
    """
    node = lambda *parts: F.xxhash64(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    none = F.array().cast("array<string>")
    both = (
        mentions.select("namespace_id", "type", "name", "seq", F.lit(None).cast("string").alias("id"), "aliases", "wanted", "keep", F.lit(None).cast("array<string>").alias("blocked"), F.lit(None).cast("array<double>").alias("vector"))
        .unionByName(
            stored.select("namespace_id", "type", "name", F.lit(None).cast("bigint").alias("seq"), "id", F.col("normalized_aliases").alias("aliases"), F.lit(None).cast("string").alias("wanted"), F.lit(False).alias("keep"), F.coalesce("blocked_aliases", none).alias("blocked"), "embedding").withColumnRenamed("embedding", "vector")
        )
        .withColumn("key", normalize(F.col("name")))
        .withColumn("keys", F.filter(F.transform(F.coalesce("aliases", none), lambda v: normalize(v, unicode=False)), lambda k: (k != "") & ~k.isin(SELF_REFERENCES)))
        .withColumn("node", F.when(F.col("id").isNull(), node("mention", F.col("seq"))).otherwise(node("entity", F.col("id"))))
    )
    both = scratch(both, "identity-rows")
    spoken = F.explode(F.array_distinct(F.concat(F.filter(F.array("key"), lambda k: k != ""), "keys"))).alias("k")
    by_key = both.select("node", "namespace_id", "type", spoken).select(F.col("node").alias("a"), node("key", F.col("namespace_id"), F.col("type"), F.col("k")).alias("b"))
    by_name = both.select(F.col("node").alias("a"), node("name", F.col("namespace_id"), F.col("type"), F.col("name")).alias("b"))
    by_id = both.filter("wanted is not null").select(F.col("node").alias("a"), node("entity", F.col("wanted")).alias("b"))
    names = both.groupBy("namespace_id", "type", "name").agg(F.max("vector").alias("vector"))
    names = names.select(node(F.col("namespace_id"), F.col("type")).cast("string").alias("kind"), node("name", F.col("namespace_id"), F.col("type"), F.col("name")).alias("node"), "name", "vector")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"kind": pdf["kind"], "node": pdf["node"], "vector": [np.asarray(v if v is not None and len(v) else embed(n), float) for n, v in zip(pdf["name"], pdf["vector"], strict=True)]})

    near = similar(scratch(names.mapInPandas(vectors, "kind string, node bigint, vector array<double>"), "identity-vectors"), least)
    groups = components(by_key.unionByName(by_name).unionByName(by_id).unionByName(near))
    return both.join(groups, "node")


def resolve(mentions: DataFrame, stored: DataFrame | None = None, decisions: dict[str, str] | None = None, *, embed: Callable[[str], np.ndarray] = trigram_embedding, match: float = MATCH, ask: float = ASK) -> DataFrame:
    """What each mention resolves to, in the order of seq (RESOLVED): an entity_id of stored, or the seq that made a new one.

    mentions: namespace_id, type, name, aliases, seq, and matched_existing_id, an id that the extractor names. stored:
    entities with id, name, type, namespace_id and the columns of STORED. decisions: signature to merge:<id> or keep.
    An id that exists is taken (0); else the first that fits of name (1), aliases in their order without those that name
    nobody (2), and the nearest vector of at least `match` (3) whose entity doesn't block the name; else a new entity (4).
    keep makes a new one whatever fits. A merge adds aliases that are not blocked, one by id the name too. Of several
    entities with a key, the oldest is taken. near_* is the best entity in [ask, match) of a new one, else one of the
    same name and another type, the oldest that doesn't block it, with similarity 1.
    """
    spark = mentions.sparkSession
    stored = spark.createDataFrame([], "id string, name string, type string, namespace_id string") if stored is None else stored
    stored, mentions = _with_columns(stored, STORED), _with_columns(mentions, MENTION)
    given = F.lit(None).cast("string")
    if decisions:
        said = F.create_map(*[F.lit(x) for pair in decisions.items() for x in pair])
        given = F.try_element_at(said, signature(F.col("name"), F.col("type")))
    merge = F.when(given.startswith("merge:"), F.substring(given, 7, 1 << 20))
    mentions = mentions.withColumn("wanted", F.coalesce(merge, F.nullif("matched_existing_id", F.lit("")))).withColumn("keep", F.coalesce(given == "keep", F.lit(False)))

    def matched(rows: list[tuple]) -> list[tuple]:
        by_key: dict[tuple, int] = {}
        by_id: dict[str, int] = {}
        ids: list[str | None] = []
        seqs: list[int | None] = []
        kinds: list[tuple] = []
        blocked: list[set] = []
        vectors: dict[tuple, np.ndarray] = {}
        counts: dict[tuple, list[int]] = {}

        def add(kind: tuple, entity: str | None, seq: int | None, keys: list[str], vector: np.ndarray, blocks: set) -> int:
            at = len(ids)
            ids.append(entity)
            seqs.append(seq)
            kinds.append(kind)
            blocked.append(blocks)
            for k in keys:
                by_key.setdefault((kind, k), at)
            held, places = vectors.get(kind), counts.setdefault(kind, [])
            if held is None or len(held) == len(places):
                held = vectors[kind] = np.concatenate([held, np.zeros_like(held)]) if held is not None else np.zeros((8, len(vector)))
            if len(vector) == held.shape[1]:
                norm = np.linalg.norm(vector)
                held[len(places)] = vector / norm if norm else vector
            places.append(at)
            return at

        for r in sorted((r for r in rows if r[1] is not None), key=lambda r: r[1]):
            space, entity, _, kind, name, _, keys, blocks, vector, _, _ = r
            own = normalize_name(name)
            by_id[entity] = add((space, kind), entity, None, [k for k in (own, *keys) if k], np.asarray(vector if vector is not None and len(vector) else embed(name), float), set(blocks))
        out = []
        for r in sorted((r for r in rows if r[1] is None), key=lambda r: r[2]):
            space, _, seq, kind, name, aliases, keys, _, _, wanted, keep = r
            kind = (space, kind)
            key, hit, step, similarity, near = normalize_name(name), None, 4, None, None
            if wanted in by_id:
                hit, step, keys = by_id[wanted], 0, [*keys, key]
            elif key and (kind, key) in by_key:
                hit, step = by_key[kind, key], 1
            else:
                hit = next((by_key[kind, k] for k in map(normalize_name, aliases if aliases is not None else []) if identifying(k) and (kind, k) in by_key), None)
                step = 2 if hit is not None else 4
            vector = None
            if hit is None:
                vector = np.asarray(embed(name), float)
                places = counts.get(kind, [])
                if len(places) and len(vector) == vectors[kind].shape[1]:
                    alike = vectors[kind][: len(places)] @ (vector / (np.linalg.norm(vector) or 1))
                    for k in np.argsort(-alike, kind="stable"):
                        if alike[k] < ask - 1e-12:
                            break
                        if key and key in blocked[places[k]]:
                            continue
                        if alike[k] >= match - 1e-12:
                            hit, step, similarity, near = places[k], 3, float(alike[k]), None
                        elif near is None:
                            near, similarity = places[k], float(alike[k])
                        break
            if hit is None or (keep and step):
                near, similarity = (None, None) if keep else (near, similarity)
                hit, step = add(kind, None, seq, [k for k in (key, *keys) if k], np.asarray(embed(name), float) if vector is None else vector, set()), 4
            else:
                for k in keys:
                    if k and k not in blocked[hit] and k not in SELF_REFERENCES:
                        by_key.setdefault((kinds[hit], k), hit)
            out.append((seq, ids[hit], seqs[hit], step, similarity, ids[near] if near is not None else None, seqs[near] if near is not None else None))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, rows = None, []
        for pdf in batches:
            for component, *row in zip(pdf["component"], pdf["namespace_id"], *[pdf[c] for c in ROWS], strict=True):
                if component != group:
                    if rows:
                        yield _resolved(matched(rows))
                    group, rows = component, []
                row[2] = None if pd.isna(row[2]) else int(row[2])
                rows.append(tuple(row))
        if rows:
            yield _resolved(matched(rows))

    rows = _groups(mentions, stored, embed, ask)
    # Places of rows pass through Python as text, where a null makes no float of them.
    rows = rows.withColumn("seq", F.col("seq").cast("string")).repartition("component").sortWithinPartitions("component")
    found = scratch(rows.select("component", "namespace_id", *ROWS).mapInPandas(run, RESOLVED), "identity-resolved")
    return _with_other_types(found, mentions, stored)


def _resolved(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in RESOLVED.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"entity_seq": "Int64", "near_seq": "Int64", "similarity": "float64"})


def _with_other_types(found: DataFrame, mentions: DataFrame, stored: DataFrame) -> DataFrame:
    """found, with the oldest entity of the same name and another type as the near one of new entities that have none."""
    said = mentions.select("seq", "namespace_id", "type", normalize(F.col("name")).alias("key"), "keep")
    new = found.filter("step = 4").join(said, "seq")
    open_ = new.filter("near_id is null and near_seq is null and not keep and key <> ''").select("seq", "namespace_id", "key", F.col("type").alias("kind"))
    none = F.array().cast("array<string>")
    old = stored.select("namespace_id", normalize(F.col("name")).alias("key"), "type", "id", F.lit(None).cast("bigint").alias("made"), F.coalesce("blocked_aliases", none).alias("blocked"))
    old = old.unionByName(new.select("namespace_id", "key", "type", F.lit(None).cast("string").alias("id"), F.col("seq").alias("made"), none.alias("blocked")))
    # One row for each name and type, so a name that many entities have is no large join.
    old = old.filter("key <> '' and not array_contains(blocked, key)").groupBy("namespace_id", "key", "type").agg(F.min(F.struct(F.col("id").isNull().alias("fresh"), "id", "made")).alias("first"))
    met = open_.join(old, ["namespace_id", "key"]).filter("type <> kind and (first.made is null or first.made < seq)")
    met = met.groupBy("seq").agg(F.min("first").alias("first"))
    return found.join(met, "seq", "left").select(
        "seq", "entity_id", "entity_seq", "step", F.when(F.col("first").isNotNull(), 1.0).otherwise(F.col("similarity")).alias("similarity"), F.coalesce("near_id", "first.id").alias("near_id"), F.coalesce("near_seq", "first.made").alias("near_seq")
    )


def match_sequential(mentions: DataFrame, *, embed: Callable[[str], np.ndarray] = trigram_embedding, match: float = MATCH, ask: float = ASK) -> DataFrame:
    """seq, entity_seq, step, similarity, near_seq: `resolve` of mentions among themselves."""
    return resolve(mentions, embed=embed, match=match, ask=ask).select("seq", "entity_seq", "step", "similarity", "near_seq")


def questions(found: DataFrame, mentions: DataFrame, stored: DataFrame | None = None, most: int = MAX_QUESTIONS) -> DataFrame:
    """id (q1, q2, ...), kind, seq, name, type, candidate_id, candidate_seq, candidate_name, similarity: the nearest misses.

    A candidate of the same name and another type is a same_name_different_type, any other a possible_missed_merge.
    """
    said = mentions.select("seq", "name", "type", normalize(F.col("name"), unicode=False).alias("key"))
    other = said.select(F.col("seq").alias("near_seq"), F.col("name").alias("n1"), F.col("type").alias("t1"), F.col("key").alias("k1"))
    near = found.filter("step = 4 and (near_id is not null or near_seq is not null)").join(said, "seq").join(other, "near_seq", "left")
    columns = [F.lit(None).cast("string").alias(c) for c in ("n2", "t2", "k2")]
    if stored is not None:
        held = stored.select(F.col("id").alias("near_id"), F.col("name").alias("n2"), F.col("type").alias("t2"), normalize(F.col("name"), unicode=False).alias("k2"))
        near = near.join(held, "near_id", "left")
    else:
        near = near.select("*", *columns)
    same = (F.coalesce("k2", "k1") == F.col("key")) & (F.coalesce("t2", "t1") != F.col("type"))
    kind = F.when(same, "same_name_different_type").otherwise("possible_missed_merge")
    ranked = near.select(kind.alias("kind"), "seq", "name", "type", F.col("near_id").alias("candidate_id"), F.col("near_seq").alias("candidate_seq"), F.coalesce("n2", "n1").alias("candidate_name"), "similarity")
    ranked = ranked.orderBy(F.col("similarity").desc(), "seq").limit(most)
    return ranked.withColumn("id", F.concat(F.lit("q"), F.row_number().over(Window.orderBy(F.col("similarity").desc(), "seq")).cast("string")))


def merged(mentions: DataFrame, found: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The entities that mentions make or change, as they are afterwards; changed tells which of them were stored.

    mentions: namespace_id, seq, name, type, aliases, description, source_path, chunk_index, total_chunks; found: their
    resolution, with entity_id filled in. Aliases are old, then new, the first spelling of each form, without blocked
    ones; a merge by id adds the name too. The longer description wins, the old one if equal; sources are kept once by
    path and chunk. normalized_aliases leave out self-references only. An entity that many mentions name is summed up by
    alias and by source before its row is made.
    """
    none = F.array().cast("array<string>")
    rows = mentions.join(found.select("seq", "entity_id", "entity_seq", "step"), "seq")
    aliases = F.coalesce("aliases", none)
    spoken = F.when(F.col("step") == 0, F.concat(F.array("name"), aliases)).otherwise(aliases)
    each = rows.select("entity_id", "seq", F.posexplode(spoken).alias("pos", "alias")).withColumn("key", normalize(F.col("alias"), unicode=False)).filter("key <> ''")
    each = each.groupBy("entity_id", "key").agg(F.min(F.struct("seq", "pos", "alias")).alias("first"))
    new_aliases = each.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list("first")), lambda f: f["alias"]).alias("new_aliases"))
    refs = rows.filter("source_path is not null").groupBy("entity_id", "source_path", "chunk_index").agg(F.min(F.struct("seq", F.col("total_chunks").alias("t"))).alias("first"))
    refs = refs.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("first.seq").alias("seq"), F.struct("source_path", "chunk_index", F.col("first.t").alias("total_chunks")).alias("ref")))), lambda r: r["ref"]).alias("new_refs"))
    text = F.coalesce("description", F.lit(""))
    first = rows.groupBy("entity_id").agg(
        F.min_by("namespace_id", "seq").alias("n_namespace"), F.min_by("name", "seq").alias("n_name"), F.min_by("type", "seq").alias("n_type"), F.min("seq").alias("created_seq"), F.min(F.struct(-F.length(text), "seq", text.alias("d"))).getField("d").alias("n_description")
    )
    new = first.join(new_aliases, "entity_id", "left").join(refs, "entity_id", "left").withColumnRenamed("entity_id", "id")
    types = {"aliases": "array<string>", "normalized_aliases": "array<string>", "blocked_aliases": "array<string>", "description": "string", "source_refs": SOURCE_REFS, "embedding": "array<double>", "name": "string", "type": "string", "namespace_id": "string"}
    old = _with_columns(stored if stored is not None else mentions.sparkSession.createDataFrame([], "id string"), types).select("id", *types, F.lit(True).alias("changed"))
    both = new.join(old, "id", "left")
    blocked = F.coalesce("blocked_aliases", none)
    all_aliases = merge_lists(F.coalesce("aliases", none), F.coalesce("new_aliases", none), blocked)
    longer = F.when(F.length(F.col("n_description")) > F.length(F.coalesce("description", F.lit(""))), F.col("n_description")).otherwise(F.coalesce("description", F.lit("")))
    no_refs = F.array().cast(SOURCE_REFS)
    out = both.select(
        "id", F.coalesce("namespace_id", "n_namespace").alias("namespace_id"), F.coalesce("name", "n_name").alias("name"), F.coalesce("type", "n_type").alias("type"),
        all_aliases.alias("aliases"), longer.alias("description"), blocked.alias("blocked_aliases"),
        source_ref_union(F.coalesce("source_refs", no_refs), F.coalesce("new_refs", no_refs)).alias("source_refs"), "embedding", F.coalesce("changed", F.lit(False)).alias("changed"), "created_seq",
    )
    keys = F.filter(F.transform("aliases", lambda a: normalize(a, unicode=False)), lambda k: (k != "") & ~k.isin(SELF_REFERENCES))
    return out.withColumn("normalized_name", normalize(F.col("name"))).withColumn("normalized_aliases", keys)


SOURCE_REFS = "array<struct<source_path:string,chunk_index:int,total_chunks:int>>"


def merge_lists(old: Column, new: Column, blocked: Column) -> Column:
    """Aliases of a merge: old then new, the first spelling of each form, without those that are blocked."""
    key = lambda v: normalize(v, unicode=False)
    return F.filter(distinct_by(F.concat(old, new), key), lambda v: ~F.array_contains(blocked, key(v)))


def upsert_relations(mentions: DataFrame) -> DataFrame:
    """from_id, type, to_id, source_paths, mentions: one relation per triple; null ends are dropped."""
    rows = mentions.filter("from_id is not null and to_id is not null")
    return rows.groupBy("from_id", "type", "to_id").agg(F.array_sort(F.collect_set("source_path")).alias("source_paths"), F.count("*").alias("mentions"))


def resolve_endpoints(ends: DataFrame, in_file: DataFrame, graph: DataFrame) -> DataFrame:
    """ends (end_id, source_path, name) with entity_id and how: the exact name in its file, the normalised name there,
    or a normalised name or alias that exactly one entity of its namespace has; else null.

    in_file: source_path, name, entity_id, seq (of a name, the last mention wins; of a normalised one, the name that came
    first); graph: entity_id, name, normalized_aliases. Tables may have a namespace_id, the default where they lack it.
    """
    space = {"namespace_id": "string"}
    ends, in_file, graph = (_with_columns(df, space).withColumn("namespace_id", F.coalesce("namespace_id", F.lit("default"))) for df in (ends, in_file, graph))
    graph = _with_columns(graph, {"normalized_aliases": "array<string>"})
    file = ["namespace_id", "source_path"]
    exact = in_file.groupBy(*file, "name").agg(F.max_by("entity_id", "seq").alias("exact"), F.min("seq").alias("came"))
    key = normalize(F.col("name"))
    loose = exact.withColumn("key", key).filter("key <> ''").groupBy(*file, "key").agg(F.min_by("exact", "came").alias("loose"))
    keys = F.explode(F.array_distinct(F.concat(F.array(key), F.coalesce("normalized_aliases", F.array().cast("array<string>")))))
    known = graph.select("namespace_id", "entity_id", keys.alias("key")).filter("key <> ''")
    known = known.groupBy("namespace_id", "key").agg(F.min("entity_id").alias("known"), F.max("entity_id").alias("last")).filter("known = last").drop("last")
    rows = ends.withColumn("key", key).join(exact.drop("came"), [*file, "name"], "left").join(loose, [*file, "key"], "left").join(known, ["namespace_id", "key"], "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("loose").isNotNull(), "normalized").when(F.col("known").isNotNull(), "graph")
    return rows.select("end_id", "source_path", "name", F.coalesce("exact", "loose", "known").alias("entity_id"), how.alias("how"))


def scripted_extraction(texts: DataFrame) -> DataFrame:
    """Deterministic stand-in for an extractor: `노드: name | type` and `관계: from | type | to` lines of doc_id, text.

    Rows: doc_id, line, kind (entity or relation), a, b, c. An extractor of one's own is any function of such a frame.
    """
    lines = texts.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "said"))
    node, edge = r"^\s*노드:\s*([^|]+?)\s*\|\s*([^|]+?)\s*$", r"^\s*관계:\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*$"
    said = F.col("said")
    entity = lines.filter(said.rlike(node)).select("doc_id", "line", F.lit("entity").alias("kind"), F.regexp_extract(said, node, 1).alias("a"), F.regexp_extract(said, node, 2).alias("b"), F.lit("").alias("c"))
    relation = lines.filter(said.rlike(edge)).select("doc_id", "line", F.lit("relation").alias("kind"), *[F.regexp_extract(said, edge, k).alias(c) for k, c in enumerate("abc", 1)])
    return entity.unionByName(relation)


def extract(texts: DataFrame, call: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """Any extractor over doc_id, text: call(text) gives rows of schema; texts are taken in Arrow batches."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(d, *row) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for row in call(t or "")], columns=["doc_id", *names])

    return texts.select("doc_id", "text").mapInPandas(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {schema}")
