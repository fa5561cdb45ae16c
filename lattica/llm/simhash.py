"""Document fingerprints by SimHash, in DataFrame operations only."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import materialize, sized, table

#: Bits of a fingerprint; its votes are counted in 16 words of four 16-bit lanes.
BITS = 64
LANES = "281479271743489"  # 0x0001000100010001
#: Terms whose votes fit a lane; longer texts are counted piece by piece.
PIECE = 32000
#: Documents of a run of neighbouring ids; at most LEVEL ** 3 runs, which then hold more.
RUN, LEVEL = 1000, 32
#: Bits in which near fingerprints may differ.
RADIUS = 3
#: Terms are pairs of neighbouring words; a pair weighs as often as it occurs.
SPACES = r"[\x20\x09-\x0D]+"


def _terms(words: Column) -> Column:
    """Term hashes: pairs of neighbouring words, or the word of a text of one."""
    pairs = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda w, i: F.xxhash64(w, F.get(words, i + 1)))
    return F.when(F.size(words) > 0, pairs).otherwise(F.array().cast("array<bigint>"))


def add_fingerprints(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds for each text column (key) its SimHash as 16 hexadecimal digits (value), without a shuffle.

    Every term adds its bits to packed counters; a bit is set if more than half of the terms, counted with their
    weights, have it. Texts without words have the fingerprint of no votes, zero. Null counts as empty. Equal texts
    have equal fingerprints, whatever row they are in. Texts of any length are counted whole. A column of an output's
    name is replaced.
    """
    for text, out in columns.items():
        df = _add_fingerprint(df, text, out)
    return df


def _add_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    # Scratch columns have names that no table has.
    mark = f"_simhash_{uuid.uuid4().hex[:8]}_"
    keep, mask = [c for c in df.columns if c != out], F.lit(int(LANES)).cast("long")
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACES), lambda w: w != "")
    df = df.withColumn(f"{mark}words", words).withColumn(f"{mark}terms", _terms(F.col(f"{mark}words")))
    starts = F.sequence(F.lit(1), F.greatest(F.size(f"{mark}terms"), F.lit(1)), F.lit(PIECE))
    df = df.withColumn(f"{mark}pieces", F.transform(starts, lambda s: F.slice(F.col(f"{mark}terms"), s, PIECE)))
    df = df.withColumn(f"{mark}n", F.size(f"{mark}terms")).drop(f"{mark}words", f"{mark}terms")

    def votes(shift: int) -> Column:
        return F.transform(f"{mark}pieces", lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, shift).bitwiseAND(mask)))

    df = df.select("*", *[votes(j).alias(f"{mark}v{j}") for j in range(16)]).drop(f"{mark}pieces")

    def bit(b: int) -> Column:
        count = F.aggregate(f"{mark}v{b % 16}", F.lit(0).cast("long"), lambda a, v: a + F.shiftrightunsigned(v, 16 * (b // 16)).bitwiseAND(F.lit(0xFFFF)))
        value = F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")
        return F.when(count * 2 > F.col(f"{mark}n"), value).otherwise(F.lit(0).cast("long"))

    number = bit(0)
    for b in range(1, BITS):
        number = number.bitwiseOR(bit(b))
    return df.select(*keep, F.lower(F.lpad(F.hex(number), 16, "0")).alias(out))


def _long(fingerprint: Column) -> Column:
    high = F.conv(F.substring(fingerprint, 1, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(F.conv(F.substring(fingerprint, 9, 8), 16, 10).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return F.lit(1.0) - F.bit_count(_long(a).bitwiseXOR(_long(b))) / F.lit(float(BITS))


def near_prints(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, *, keyed: int = 2) -> DataFrame:
    """All (qf, df, distance) of fingerprints of queries and of prints that differ in at most `radius` bits.

    Permuted block tables: the bits are cut into radius + keyed blocks; within the radius at least `keyed` blocks agree,
    so each choice of that many blocks is the key of one table. A pair is emitted by the first table only in which it
    meets. Null fingerprints match nothing; empty sides give no rows.
    """
    blocks = radius + keyed
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    part = lambda n, i: F.shiftrightunsigned(n, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    tables = list(combinations(range(blocks), keyed))

    def keyed_rows(df: DataFrame, name: str) -> DataFrame:
        numbers = df.select(F.col("fingerprint").alias(name)).filter(F.col(name).isNotNull()).distinct().withColumn("n", _long(F.col(name)))
        keys = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(*[part(F.col("n"), i) for i in which]).alias("k")) for t, which in enumerate(tables)])
        return numbers.select(name, F.col("n").alias(f"{name}_n"), F.inline(keys))

    met = keyed_rows(queries, "qf").join(keyed_rows(prints, "df"), ["t", "k"])
    same = F.col("qf_n").bitwiseXOR(F.col("df_n"))
    first = F.lit(None).cast("int")
    for t, which in reversed(list(enumerate(tables))):
        agree = F.lit(True)
        for i in which:
            agree = agree & (part(same, i) == 0)
        first = F.when(agree, F.lit(t)).otherwise(first)
    return met.withColumn("distance", F.bit_count(same)).filter((F.col("distance") <= radius) & (F.col("t") == first)).select("qf", "df", "distance")


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, *, keyed: int = 2) -> DataFrame:
    """All (query_id, doc_id, distance) whose fingerprints differ in at most `radius` bits, rows with one id aside.

    Both sides have id and fingerprint columns: query_id and doc_id, fingerprint. Equal fingerprints are collapsed
    before the search and expanded after it; where groups of copies are large, `neighbours` counts them instead.
    """
    near = near_prints(queries, prints, radius, keyed=keyed)
    out = near.join(queries.select("query_id", F.col("fingerprint").alias("qf")), "qf").join(prints.select("doc_id", F.col("fingerprint").alias("df")), "df")
    return out.filter("query_id <> doc_id").select("query_id", "doc_id", "distance")


def _bounds(docs: DataFrame) -> list[int]:
    """Ids that cut docs into runs of about RUN rows: quantiles of the ids, at most LEVEL ** 3 - 1."""
    n = docs.count()
    runs = min(LEVEL**3, -(-n // RUN))
    if runs < 2:
        return []
    shares = [k / runs for k in range(1, runs)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 10 * runs)).first()[0]
    return sorted(set(found or []))


def _run_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the bounds are at most doc_id, found in three steps of LEVEL comparisons; -1 for null."""
    of = lambda ids: F.array(*[F.lit(x).cast("bigint") for x in ids])
    reached = lambda ids: F.size(F.filter(ids, lambda b: b <= doc_id))
    if len(bounds) <= LEVEL:
        return F.when(doc_id.isNull(), -1).otherwise(reached(of(bounds))).cast("long")
    coarse = bounds[LEVEL - 1 :: LEVEL]
    block = _run_of(doc_id, coarse)
    parts = F.array(*[of(bounds[k : k + LEVEL]) for k in range(0, len(bounds), LEVEL)])
    inside = F.coalesce(reached(F.get(parts, block.cast("int"))), F.lit(0))
    return F.when(doc_id.isNull(), -1).otherwise(block * LEVEL + F.greatest(inside, F.lit(0))).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint of each row, with next_text and next_fingerprint of the row that follows by doc_id.

    Takes doc_id, text (null is empty). The first row follows the last. Rows with one id are ordered by text; a null id
    is before all others. Quantiles of the ids cut the rows into runs of about equal numbers, wherever the ids lie; each
    run is sorted on its own, and only the first text of each run passes to the run before it. Rows of one id are of one
    run. Texts are shuffled once, with their fingerprints; those of the runs' first texts are made anew, not moved.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    run = _run_of(F.col("doc_id"), _bounds(docs)).alias("run")
    starts = materialize(docs.select("doc_id", run).groupBy("run").agg(F.min("doc_id").alias("start")), "fingerprint-runs")
    heads = docs.join(sized(starts), F.col("doc_id").eqNullSafe(F.col("start"))).groupBy("run").agg(F.min("text").alias("text"))
    heads = add_fingerprints(heads, {"text": "fingerprint"}).select(F.col("run").alias("follow"), F.struct("text", "fingerprint").alias("head"))
    # One row for each of at most LEVEL ** 3 runs.
    in_all = Window.orderBy("run")
    order = starts.select("run", F.coalesce(F.lead("run").over(in_all), F.first("run").over(in_all.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("follow"))
    heads = order.join(heads, "follow").select("run", "head")
    rows = add_fingerprints(docs, {"text": "fingerprint"}).select("doc_id", "text", "fingerprint", run)
    inside = Window.partitionBy("run").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    placed = rows.withColumn("inner", F.lead(F.struct("text", "fingerprint")).over(inside)).join(heads, "run").withColumn("after", F.coalesce("inner", "head"))
    return placed.select("doc_id", "text", "fingerprint", F.col("after.text").alias("next_text"), F.col("after.fingerprint").alias("next_fingerprint"))


def neighbours(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fingerprint, n_near for each fingerprint of queries: the rows of prints within the radius, those equal to it too.

    Both have a column fingerprint. Rows of one fingerprint are counted, not listed, so a group of copies is one entry
    of the block tables, and only the number of different fingerprints counts.
    """
    weights = materialize(prints.filter("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n")), "fingerprint-weights")
    asked = materialize(queries.select("fingerprint").filter("fingerprint is not null").distinct(), "fingerprint-queries")
    near = near_prints(asked, weights.select("fingerprint"), radius).join(weights.withColumnRenamed("fingerprint", "df"), "df")
    return near.groupBy(F.col("qf").alias("fingerprint")).agg(F.sum("n").alias("n_near"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_near, besides the contract's columns: the other documents within RADIUS bits, for every twentieth id as query."""
    rows = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - tail), F.substring(F.col("next_text"), F.lit(1), tail))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = add_fingerprints(rows, {"edited": "edited_fingerprint"})
    rows = materialize(rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited"), "fingerprints")
    near = materialize(neighbours(rows.filter("doc_id % 20 = 0"), rows), "fingerprint-near")
    return rows.join(sized(near), "fingerprint", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.when(F.col("doc_id") % 20 == 0, F.col("n_near") - 1).alias("n_near"),
    )


QUERIES = {"op10_fingerprint": op10_fingerprint}
ORACLES: dict[str, str] = {}
