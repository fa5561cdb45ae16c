"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import SPACE_WORD, materialize, table

#: Key ranges per source; a budget ends inside one of them, and only that one is sorted.
BINS = 4096
MAX_EPOCHS = 3
SEED = "mix-v1"
#: Letters, white space and plain stops; the share of other characters lowers a document's quality weight.
PLAIN = r"[\p{L}\x09-\x0D .,]+"


def quality_weight(text: Column) -> Column:
    """Share of plain characters, at least 0.05; an empty text has weight 1."""
    t = F.coalesce(text, F.lit(""))
    other = F.length(F.regexp_replace(t, PLAIN, "")) / F.greatest(F.length(t), F.lit(1))
    return F.greatest(F.lit(0.05), F.lit(1.0) - other)


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> adds target: the total shared by weights 1, 2, 3 repeating, capped at max_epochs sizes.

    Water filling in closed form. In ascending order of cap over weight, a source is capped exactly if its cap is
    below its share of what is left for it and all after it; integers decide, so ties and reruns agree. One row per
    source, which is the only thing the single-partition windows see.
    """
    big = lambda c: F.col(c).cast("decimal(19,0)")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    ranked = (
        sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("total", F.sum("source_size").over(everything))
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(after))
        .withColumn("capped", big("cap") * big("weights") < big("weight") * big("left"))
    )
    open_ = filled.withColumn("free", F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))).withColumn(
        "free_weights", F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything), F.lit(0))
    )
    level = (F.col("weight") * F.col("free")).cast("double") / F.greatest(F.col("free_weights"), F.lit(1)).cast("double")
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.least(level, F.col("cap").cast("double")))
    return open_.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, *, max_epochs: int = MAX_EPOCHS, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """Words of each document that the mixture takes: doc_id, source, size, source_size, target, epochs, taken.

    A source takes its floor(target / size) complete epochs, then documents in ascending order of their exponential
    key -ln(u) / quality until the rest of the budget is met; the document at the boundary gives its first words only,
    so taken words equal the rounded target. u comes from a digest of the id, so reruns agree.
    Nulls: a null text has size 0 and takes 0; a null source is a source of its own, last; a null id is an id like any.
    Repeated rows are rows of their own; those with one id share a key, and only equal rows can swap places. Empty
    tables give no rows. Only doc_id, text and source of the input are read, and the narrow columns in carry passed on.

    Hot sources: sums per (source, key range) are pre-aggregated, and one range of each source is sorted.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    rows = docs.select(
        "doc_id",
        "source",
        *carry,
        F.coalesce(F.regexp_count("text", F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"),
        (-F.log(u) / quality_weight(F.col("text"))).alias("key"),
    ).withColumn("bin", F.floor(F.col("key") / (F.col("key") + 1) * BINS).cast("int"))
    rows = materialize(rows, "mix-keys")
    ranges = materialize(rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("bin_size").alias("source_size")), max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    plan = targets.withColumn("epochs", epochs.cast("long")).withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edge = ranges.withColumn("before", F.coalesce(F.sum("bin_size").over(upto), F.lit(0))).alias("r")
    plan = materialize(plan, "mix-plan").alias("p")
    edge = (
        plan.join(edge, F.col("p.source").eqNullSafe(F.col("r.source")) & (F.col("before") < F.col("budget")) & (F.col("before") + F.col("bin_size") >= F.col("budget")), "left")
        .select("p.*", F.coalesce("bin", F.lit(-1)).alias("edge"), F.coalesce("before", F.lit(0)).alias("before"))
    )
    plan = materialize(edge, "mix-edges").withColumnRenamed("source", "plan_source")
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = placed.filter("bin = edge").withColumn("room", F.col("budget") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at_edge = at_edge.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("room"))))
    others = placed.filter("bin <> edge").withColumn("part", F.when(F.col("bin") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    out = [*carry, "doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")]
    return at_edge.select(*out).unionByName(others.select(*out))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    greatest(0.05::DOUBLE, 1.0::DOUBLE - length(regexp_replace(coalesce(text, ''), '[\p{L}\x09-\x0D .,]+', '', 'g'))::DOUBLE / greatest(length(coalesce(text, '')), 1)) AS q,
    (('0x' || substr(md5('mix-v1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM {documents}),
k AS (SELECT doc_id, source, size, -ln(u) / q AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS weight, sum(source_size) OVER () AS total FROM s),
f AS (SELECT *, total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM r WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
c AS (SELECT *, cap * weights < weight * rest AS capped FROM f),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE least(
    (weight * (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)))::DOUBLE
    / greatest(coalesce(sum(CASE WHEN NOT capped THEN weight END) OVER (), 0), 1)::DOUBLE, cap::DOUBLE) END AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS epochs FROM t),
b AS (SELECT *, floor(target - epochs * source_size + 0.5)::BIGINT AS budget FROM e),
p AS (SELECT k.*, source_size, target, epochs, budget,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size, target, epochs, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken FROM p
"""

QUERIES = {"op1_mix": op1_mix}
ORACLES = {"op1_mix": MIX_SQL.replace("{documents}", "documents")}
