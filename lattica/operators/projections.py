"""What readers are shown of stored rows: clamped texts, sources as structures, and JSON without empty fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import clamp

#: Most characters of what is shown, and the type of a relation that has none.
NAME, TYPE, DESCRIPTION = 200, 64, 2000
UNTYPED = "RELATES_TO"


def refs_from_arrays(paths: Column, chunks: Column, totals: Column) -> Column:
    """source_refs of three arrays side by side, where -1, or nothing, stands for no number."""
    number = lambda c, i: F.nullif(F.get(c, i), F.lit(-1))
    return F.transform(F.coalesce(paths, F.array().cast("array<string>")), lambda p, i: F.struct(p.alias("source_path"), number(chunks, i).alias("chunk_index"), number(totals, i).alias("total_chunks")))


def arrays_from_refs(refs: Column) -> tuple[Column, Column, Column]:
    """The three arrays that such references are imported and exported as."""
    number = lambda n: F.transform(refs, lambda r: F.coalesce(r[n], F.lit(-1)))
    return F.transform(refs, lambda r: r["source_path"]), number("chunk_index"), number("total_chunks")


def stored(entities: DataFrame) -> DataFrame:
    """Entities as the engine holds them: missing lists are empty, a missing namespace is the default."""
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, none) for c in ("aliases", "normalized_aliases", "blocked_aliases") if c in entities.columns}
    return entities.withColumns(lists | {"namespace_id": F.coalesce("namespace_id", F.lit("default")), "normalized_name": F.coalesce("normalized_name", F.lit(""))})


def nodes(entities: DataFrame) -> DataFrame:
    """id, name, type, aliases, description, source_refs of entities for readers, without vectors."""
    return entities.select("id", clamp(F.col("name"), NAME).alias("name"), clamp(F.col("type"), TYPE).alias("type"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), clamp(F.col("description"), DESCRIPTION).alias("description"), "source_refs")


def edges(relations: DataFrame) -> DataFrame:
    """id, from_id, to_id, type, source_refs of relations for readers; their sources have no chunk."""
    refs = F.transform(F.coalesce("source_paths", F.array().cast("array<string>")), lambda p: F.struct(p.alias("source_path"), F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast("int").alias("total_chunks")))
    return relations.select("id", "from_id", "to_id", F.coalesce(F.nullif(clamp(F.col("type"), TYPE), F.lit("")), F.lit(UNTYPED)).alias("type"), refs.alias("source_refs"))


def as_json(df: DataFrame) -> DataFrame:
    """body: each row as JSON, without the fields that are null."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("body"))
