"""Incremental ingestion of document changes by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import ingest
from lattica.sources.store import SnapshotStore


def last_texts(batch: DataFrame) -> DataFrame:
    """namespace_id, source_path, text, seq: the last text of each source, whose place in the batch is that of it."""
    space = F.coalesce("namespace_id", F.lit("default")) if "namespace_id" in batch.columns else F.lit("default")
    return batch.groupBy(space.alias("namespace_id"), "source_path").agg(F.max_by("text", "seq").alias("text"), F.max("seq").alias("seq"))


def stream(docs: DataFrame, store: SnapshotStore, checkpoint: str, **options):
    """Start the stream of docs (source_path, text, seq, and namespace_id if there are several): each micro-batch is one version.

    Batches go through the ingest core: a batch that comes again, after a failure, finds its runs and changes nothing;
    one of which a source fails still takes the others in. Only the namespaces of a batch are written anew.
    """

    def batch(df: DataFrame, _: int) -> None:
        last = last_texts(df)
        if not last.isEmpty():
            ingest.ingest(last, store, **options)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
