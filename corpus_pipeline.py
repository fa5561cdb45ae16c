"""A training corpus from documents, in five stages, each written as Parquet and read again.

Each row is kept or dropped by its own text: rows of one doc_id and text together, rows with a null id as any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import mixing, probminhash, secrets, toxicity, winnowing
from lattica.llm.common import materialize, sized, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with row, the key of id and text."""
    return docs.select(*COLUMNS).withColumn("row", F.xxhash64("doc_id", "text"))


def _without(docs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Rows of keyed docs whose key is not among rows."""
    return docs.join(sized(materialize(rows.distinct(), name)), "row", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near duplicates; one without an id only if none has one."""
    docs = _keyed(docs)
    classes = probminhash.near_duplicates(docs.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "class_id").distinct()
    rows = materialize(classes.join(docs.select("row", "doc_id").distinct(), "row"), "stage-classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = materialize(rows.groupBy("class_id").agg(first.alias("first")).select("first.row"), "stage-kept")
    return _without(docs, rows.select("row").join(sized(kept), "row", "left_anti"), "stage-duplicates")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    One shared window is enough, however long the document: op3's flag asks for a twentieth of the words, which a
    passage in a long text does not reach. The whole document goes, as what stands around a passage often answers it.
    """
    docs = _keyed(docs)
    found = winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=("row",))
    return _without(docs, found.filter("n_hit > 0").select("row"), "stage-contaminated")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [SECRET] in place of every finding, encoded ones included."""
    rows = secrets.scan(docs.select(*COLUMNS)).withColumn("text", F.coalesce("found.redacted", "text"))
    return rows.withColumn("n_chars", F.when(F.col("found.redacted").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes words of, with their complete epochs and the words taken."""
    docs = _keyed(docs)
    taken = mixing.mix(docs, carry=("row",)).filter("taken > 0").select("row", "size", "target", "epochs", "taken")
    return docs.join(taken.dropDuplicates(["row"]), "row").drop("row")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: Learned scores and near duplicates have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
