"""Shared pieces of the training-data operators: scratch tables, word counts, batching."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the mixing and language-model contracts: runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of text that one Arrow batch carries to a Python worker at most.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where that is unset and Spark is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        where = f"file://{tempfile.gettempdir()}/checkpoints/lattica-{os.getpid()}"
    return where.rstrip("/")


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df as Parquet into the shared folder, in folders by the columns in by, and read it back.

    Cuts lineage and survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that a batch of long texts fits a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


#: Rows of a narrow table that a join may broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, hinted for broadcast only if it has at most `most` rows. Meant for written, narrow tables."""
    return F.broadcast(df) if df.count() <= most else df
