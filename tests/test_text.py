import os

import hypothesis.strategies as st
import pytest
from hypothesis import given, settings
from pyspark.sql import functions as F

from lattica.functions import chunking, text
from lattica.operators.identity import identifying, normalize_name, trigram_embedding


def test_normalize_agrees_with_its_python_twin(spark):
    names = ["  Acme,  Inc. ", "Ｅ", "é", " x y ", "“Q”", "...", None, "don't", "- a -b-", "한국 은행"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.normalize(F.col("n")).alias("k")).collect()
    assert [r["k"] for r in rows] == [normalize_name(n) for n in names]
    assert normalize_name("é") == "é" and not identifying("this study") and identifying("acme")


def test_identifiers(spark):
    df = spark.createDataFrame([("Pump AB-1234 (XY9876, 10-K) ab-1234",), (None,)], "n string")
    assert [r[0] for r in df.select(text.identifier_aliases(F.col("n"))).collect()] == [["XY9876", "AB-1234"], []]


def test_small_columns(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([], []), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(text.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0]
    one = spark.createDataFrame([('```json\n{"a": 1}\n```', "a \n b" * 100)], "j string, t string").select(text.lenient_json(F.col("j")).alias("j"), text.one_line(F.col("t")).alias("t")).first()
    assert one["j"] == '{"a": 1}' and len(one["t"]) == 180 and one["t"].endswith("…")
    assert trigram_embedding("x") @ trigram_embedding("X") == pytest.approx(1)


def test_chunks_by_structure():
    doc = "intro\n\n# A\n" + "alpha. " * 30 + "\n\n" + "beta! " * 30 + "\n# B\nshort"
    whole = chunking.chunk_text(doc, budget=10_000)
    assert whole == [doc]
    parts = chunking.chunk_text(doc, budget=40, overlap_ratio=0)
    assert len(parts) > 3 and all(len(chunking.WordTokens().encode(p)) <= 45 for p in parts)
    assert "".join("".join(parts).split()) == "".join(doc.split())
    assert chunking.chunk_for_rag("  ") == []
    assert chunking.sentences("하나다 둘요 셋", multilingual=True) == ["하나다", "둘요", "셋"]
    after = chunking.chunk_for_retrieval("One two. " * 50, budget=30)
    assert after[1].startswith("One two. One two.\n\n")


def test_paragraphs_of_a_section_are_packed_first():
    word = lambda n: " ".join(["w"] * n)
    a, b1, b2, b3 = f"# A\n{word(3)}", f"# B\n{word(5)}", word(5), word(4)
    got = chunking.chunk_text(f"{a}\n{b1}\n\n{b2}\n\n{b3}", budget=12, overlap_ratio=0)
    assert got == [a, f"{b1}\n\n{b2}", b3]


def test_baseline_chunks_end_at_full_width_marks():
    one = "w " * 500 + "끝！"
    assert chunking.chunk_for_rag(f"{one} {one}")[0] == one.strip() and len(chunking.chunk_for_rag(f"{one} {one}")) == 2
    assert chunking.chunk_for_rag("a\n \nb\n\n\nc") == ["a\n\nb\n\nc"]


@pytest.mark.parametrize("name", ["chunk_text", "chunk_for_retrieval", "chunk_for_rag"])
def test_chunks_of_documents_against_brute_force(spark, name):
    """Budgets hold, and texts without their overlaps give the document back."""
    how, budget = getattr(chunking, name), {"chunk_text": 4000, "chunk_for_retrieval": 1500, "chunk_for_rag": 800}[name]
    count = lambda t: len(chunking.WordTokens().encode(t))
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        parts = how(r["text"], **({"overlap_ratio": 0} if name == "chunk_text" else {"overlap": 0}))
        assert all(count(p) <= budget + p.count("\n\n") for p in parts)
        if name != "chunk_for_rag" or count(r["text"]) <= budget:
            assert "".join("".join(parts).split()) == "".join(r["text"].split())


def test_tokens_of_a_vocabulary_file():
    path = next((f"/opt/tokenizers/{n}" for n in sorted(os.listdir("/opt/tokenizers")) if n.endswith(".tiktoken")), None) if os.path.isdir("/opt/tokenizers") else None
    if path is None:
        pytest.skip("no vocabulary file at hand")
    tokens = chunking.Encoding(path, r"\w+|\s+|[^\w\s]+")
    assert tokens.decode(tokens.encode("words and ones")) == "words and ones" and len(chunking.chunk_text("word " * 50, tokens, budget=20)) > 2


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n#가다", max_size=200), st.integers(2, 30))
def test_chunks_lose_nothing(doc, budget):
    parts = chunking.chunk_text(doc, budget=budget, overlap_ratio=0)
    assert "".join("".join(parts).split()) == "".join(doc.split())


def test_keywords_against_brute_force(spark):
    import re
    from collections import Counter

    from lattica.plans.queries import text_keywords

    sf_dir, want = "/root/testdata/sf0.001", {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        counts = Counter(w for w in re.findall(r"\b(?:[A-Z][A-Za-z0-9_\-]+|[가-힣]{2,})\b", r["text"]) if w not in text.TRIVIAL)
        want[r["doc_id"]] = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:6]
    got = {}
    for r in text_keywords(spark, sf_dir).orderBy("doc_id", F.col("n").desc(), "keyword").collect():
        got.setdefault(r["doc_id"], []).append((r["keyword"], r["n"]))
    assert got == {k: v for k, v in want.items() if v}
