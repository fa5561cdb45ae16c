"""Benchmark decontamination by winnowing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import lower_ascii, materialize, sized, table

#: Words of a window whose copies are sought.
WINDOW = 13
#: Words of a fingerprinted gram; the least hash of each WINDOW - GRAM + 1 consecutive grams is kept.
GRAM = 5
#: A word: digits, a-z and whatever is not ASCII, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in order; none for null."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), NON_WORD)
    return F.filter(parts, lambda w: w != "")


def gram_hashes(hashes: Column, n: int) -> Column:
    """64-bit hashes of all n consecutive words, in order; none for fewer words."""
    count = F.size(hashes) - (n - 1)
    whole = F.transform(F.slice(hashes, F.lit(1), F.greatest(count, F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, n)]))
    return F.when(count > 0, whole).otherwise(F.array().cast("array<bigint>"))


def winnow(grams: str, span: int = WINDOW - GRAM + 1) -> Column:
    """Distinct least values of each `span` consecutive entries of the array column `grams`."""
    g = F.col(grams)
    starts = F.slice(g, F.lit(1), F.greatest(F.size(g) - (span - 1), F.lit(0)))
    return F.array_distinct(F.transform(starts, lambda x, i: F.least(x, *[F.get(g, i + k) for k in range(1, span)])))


def _sized(n: int):
    return lambda h: F.struct(F.lit(n).alias("length"), h.alias("h"))


def _placed(n: int):
    return lambda h, i: F.struct(i.alias("at"), F.lit(n).alias("length"), h.alias("h"))


def _hashed(df: DataFrame, key: str, *more: str) -> DataFrame:
    return df.select(key, *more, words_of(F.col("text")).alias("words")).select(key, *more, F.size("words").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, gram: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Two texts that share `window` consecutive words share a winnowed fingerprint, so the join of fingerprints loses no
    shared window; documents it finds are extended to the exact hit words by an equi join of their windows with the
    windows of the items. Items of fewer words are one window each; their lengths (at most window - 1 of them) are
    looked up whole.
    Nulls: a null text has no words; a null item_id is left out of items_sha256 and n_items; rows that share a doc_id
    are told apart by their text. Empty tables give no rows, or documents without hits. Ties: none.

    Columns of docs named in carry come last. Window hashes have 64 bits. Nothing is collected but the distinct lengths of short items.
    """
    key = "doc_key"
    # Two keys keep repeated ids apart without a shuffle of texts.
    source = docs.select(F.col("doc_id"), F.col("text"), *carry, F.xxhash64("doc_id", "text").alias(key))
    items = materialize(_hashed(benchmark.select("item_id", "text"), "item_id").filter("n_words > 0"), "winnow-items")
    short = [r[0] for r in items.filter(F.col("n_words") < window).select("n_words").distinct().collect()]

    def windows(df: DataFrame, *keep: str) -> DataFrame:
        """One row per start of a window of `window` words or of a short item's length."""
        sizes = [window, *sorted(short)]
        each = [F.transform(gram_hashes(F.col("hashes"), n), _placed(n)) for n in sizes]
        return df.select(*keep, F.inline(F.concat(*each) if len(each) > 1 else each[0]))

    item_windows = windows(items, "item_id", "n_words").filter((F.col("length") == window) | (F.col("length") == F.col("n_words")))
    item_windows = sized(materialize(item_windows.select("item_id", "length", "h").distinct(), "winnow-windows"))
    known = sized(materialize(item_windows.select("length", "h").distinct(), "winnow-known"))

    def prints(df: DataFrame, *keep: str) -> DataFrame:
        """One row per winnowed fingerprint, and per gram of a short item's length."""
        marks = [F.transform(winnow("grams", window - gram + 1), _sized(window))]
        marks += [F.transform(F.array_distinct(gram_hashes(F.col("hashes"), n)), _sized(n)) for n in sorted(short)]
        grams = df.withColumn("grams", gram_hashes(F.col("hashes"), gram))
        return grams.select(*keep, F.inline(F.concat(*marks) if len(marks) > 1 else marks[0]))

    item_prints = prints(items, "n_words").filter((F.col("length") == window) | (F.col("length") == F.col("n_words"))).select("length", "h").distinct()
    item_prints = materialize(item_prints, "winnow-prints")
    found = prints(_hashed(source, key), key).join(sized(item_prints), ["length", "h"], "left_semi").select(key).distinct()
    found = materialize(found, "winnow-found")
    # Extension: only documents with a shared fingerprint are split into windows.
    touched = _hashed(source.join(sized(found), key, "left_semi"), key).dropDuplicates([key])
    hits = materialize(windows(touched, key).join(known, ["length", "h"], "left_semi").select(key, "at", "length", "h"), "winnow-hits")
    reach = hits.groupBy(key, "at").agg(F.max("length").alias("length"))
    spans = reach.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", (F.col("at") + F.col("length")).alias("end")))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(a["end"], s["at"].cast("long")))).alias("n"), F.greatest(a["end"], s["end"].cast("long")).alias("end")),
        lambda a: a["n"],
    )
    spans = spans.select(key, covered.alias("n_hit"))
    in_doc = hits.select(key, "length", "h").distinct().join(item_windows, ["length", "h"]).select(key, "item_id").distinct()
    in_doc = in_doc.filter("item_id is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    marked = materialize(spans.join(in_doc, key, "left"), "winnow-marked")
    counted = source.select("doc_id", key, *carry, F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    n_hit, items_ = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return counted.join(sized(marked), key, "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
        *carry,
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH letters AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i FROM bs)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, n, w, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i FROM letters, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM letters LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES = {"op3_decontaminate": OP3_SQL}
