"""The pipeline's stages on the smallest tables, and on odd rows."""

import re

import pytest

import corpus_pipeline
from lattica.llm import probminhash, secrets, toxicity, winnowing

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SMALL}/labels.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, SMALL).cache()
        ids, kept = {r[0] for r in before.select("doc_id").collect()}, {r[0] for r in now.select("doc_id").collect()}
        if name == "toxicity":
            want = {r["doc_id"] for r in toxicity.score(before, toxicity.train(before, labels)).filter("predicted = 0").collect()}
        elif name == "near_duplicates":
            want = {r["class_id"] for r in probminhash.near_duplicates(before).collect()}
        elif name == "decontamination":
            want = {r["doc_id"] for r in winnowing.decontaminate(before, bench).filter("n_hit = 0").collect()}
        elif name == "secrets":
            want = ids
            assert all(secrets.all_spans(r["text"])[1] == [] or "[SECRET]" in r["text"] for r in now.collect())
            assert all(r["n_chars"] == len(r["text"]) for r in now.collect() if "[SECRET]" in r["text"])
        else:
            want = {r["doc_id"] for r in now.filter("taken > 0").collect()}
            taken, total = now.groupBy().sum("taken").first()[0], len(" ".join(r["text"] for r in before.collect()).split())
            assert taken == pytest.approx(total, rel=0.02)
        assert kept == want and kept <= ids, name
        if name != "mixing":
            assert now.columns == corpus_pipeline.COLUMNS
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).collect()} == kept


def _windows(text, n=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def test_no_window_of_an_item_is_left(spark):
    """By brute force over the kept texts, with a passage in a document of thousands of words among them."""
    items = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    long = " ".join(f"word{k}" for k in range(9000))
    docs = docs.unionByName(spark.createDataFrame([(10**6, f"{long} {' '.join(items[0].split()[:13])} {long}", "en", "a", 1), (10**6 + 1, f"{long} {' '.join(items[0].split()[:12])} {long}", "en", "a", 1)], docs.schema))
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_contaminated(spark, docs, "/root/testdata/sf0.01").collect()}
    leaked = set().union(*map(_windows, items))
    dirty = {r["doc_id"] for r in docs.collect() if _windows(r["text"]) & leaked}
    assert 10**6 in dirty and kept.keys() == {r["doc_id"] for r in docs.collect()} - dirty
    assert not any(_windows(t) & leaked for t in kept.values())


def test_stages_survive_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "some text", "en", "a", 9), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "word " * 30_000, "en", "a", 150_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, row string")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SMALL)
            assert out.count() <= frame.count()


def test_rows_are_dropped_by_their_own_text(spark):
    """Rows with a null id are judged as others are, and rows that share an id are judged apart."""
    passage = max((r[0] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("text").collect()), key=lambda t: len(t or ""))
    clean, other, copied = ("".join(f"{name}{k} " for k in range(60)) for name in ("clean", "other", "copied"))
    rows = [(None, passage), (1, passage), (1, clean), (2, copied), (None, copied), (3, copied), (3, other), (None, "no id " + other[:40])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")

    def left(out):
        return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)

    assert left(corpus_pipeline.drop_contaminated(spark, docs, SMALL)) == sorted((r for r in rows if r[1] != passage), key=str)
    assert left(corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)) == sorted([r for r in rows if r not in ((None, passage), (None, copied), (3, copied))], key=str)
