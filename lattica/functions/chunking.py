"""Chunking of texts by headings, paragraphs, sentences and tokens, as table functions over documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
EXTRACT_TOKENS, OVERLAP_RATIO = 4000, 0.20
RETRIEVAL_TOKENS, RETRIEVAL_OVERLAP = 1500, 2
RAG_TOKENS, RAG_OVERLAP = 800, 100
HEADING = re.compile(r"(?m)(?=^#{1,6}\s+)")
PARAGRAPH = re.compile(r"\n\s*\n+")
SENTENCE = re.compile(r"(?<=[.!?。])\s+")
#: The plain retrieval baseline ends sentences at full-width marks too, and parts paragraphs at one blank line.
SENTENCE_RAG = re.compile(r"(?<=[.!?。！？])\s+")
PARAGRAPH_RAG = re.compile(r"\n\s*\n")
SENTENCE_MULTILINGUAL = re.compile(r"(?<=[.!?。])(?=\s)|(?<=[다요까])(?=\s)")
TOKEN = re.compile(r"\s*\w+|\s*[^\w\s]|\s+")


class WordTokens:
    """Default tokeniser: words and marks with the space before them, so that joining tokens gives the text back."""

    def encode(self, text: str) -> list[str]:
        return TOKEN.findall(text)

    def decode(self, tokens: list[str]) -> str:
        return "".join(tokens)


def _nonempty(parts: list[str], whole: str) -> list[str]:
    kept = [p.strip() for p in parts if p.strip()]
    return kept or [whole]


def headings(text: str) -> list[str]:
    parts = [p.rstrip() for p in HEADING.split(text)]
    return [p for p in parts if p.strip()] or [text]


def paragraphs(text: str) -> list[str]:
    return _nonempty(PARAGRAPH.split(text), text)


def sentences(text: str, *, multilingual: bool = False) -> list[str]:
    return _nonempty((SENTENCE_MULTILINGUAL if multilingual else SENTENCE).split(text), text)


def pack(units: list[str], budget: int, count: Callable[[str], int]) -> list[str]:
    """Neighbouring units joined by a blank line while their own tokens fit the budget."""
    out, held, size = [], [], 0
    for unit in units:
        n = count(unit)
        if held and size + n > budget:
            out.append("\n\n".join(held))
            held, size = [], 0
        held.append(unit)
        size += n
    return [*out, "\n\n".join(held)] if held else out


def slices(text: str, budget: int, tokens, stride: int | None = None) -> list[str]:
    encoded = tokens.encode(text)
    return [tokens.decode(encoded[k : k + budget]) for k in range(0, len(encoded), stride or budget)]


def chunk_text(text: str, tokens=None, *, budget: int = EXTRACT_TOKENS, overlap_ratio: float = OVERLAP_RATIO) -> list[str]:
    """Chunks for extraction: the whole text if it fits, else sections, paragraphs, sentences and token runs, packed
    again, each after the last tokens of the piece before it."""
    if budget <= 0 or not 0 <= overlap_ratio < 1:
        raise ValueError("budget or overlap out of range")
    tokens = tokens or WordTokens()
    count = lambda t: len(tokens.encode(t))
    if count(text) <= budget:
        return [text]
    units: list[str] = []
    for section in headings(text):
        if count(section) <= budget:
            units.append(section)
            continue
        # The paragraphs of a section are packed by themselves first; only one too large by itself is cut.
        for packed in pack(paragraphs(section), budget, count):
            if count(packed) <= budget:
                units.append(packed)
                continue
            for piece in pack(sentences(packed), budget, count):
                units += [piece] if count(piece) <= budget else slices(piece, budget, tokens)
    pieces, last = pack(units, budget, count), int(budget * overlap_ratio)
    return pieces[:1] + [_after(tokens.decode(tokens.encode(a)[-last:]) if last else "", b) for a, b in zip(pieces, pieces[1:], strict=False)]


def _after(tail: str, piece: str) -> str:
    return f"{tail}\n\n{piece}" if tail else piece


def chunk_for_retrieval(text: str, tokens=None, *, budget: int = RETRIEVAL_TOKENS, overlap: int = RETRIEVAL_OVERLAP) -> list[str]:
    """Chunks for retrieval, each after the last sentences of the piece before it."""
    tokens = tokens or WordTokens()
    count = lambda t: len(tokens.encode(t))
    if count(text) <= budget:
        return [text]
    units: list[str] = []
    for section in headings(text):
        for paragraph in [section] if count(section) <= budget else paragraphs(section):
            if count(paragraph) <= budget:
                units.append(paragraph)
                continue
            for piece in pack(sentences(paragraph, multilingual=True), budget, count):
                units += [piece] if count(piece) <= budget else slices(piece, budget, tokens)
    pieces = pack(units, budget, count)
    return pieces[:1] + [_after(" ".join(sentences(a, multilingual=True)[-overlap:]) if overlap else "", b) for a, b in zip(pieces, pieces[1:], strict=False)]


def chunk_for_rag(text: str, tokens=None, *, budget: int = RAG_TOKENS, overlap: int = RAG_OVERLAP) -> list[str]:
    """Chunks of the plain retrieval baseline: oversize units are cut with a stride, then every chunk gets an overlap."""
    tokens = tokens or WordTokens()
    count = lambda t: len(tokens.encode(t))
    if not text.strip():
        return []
    parts = lambda pattern, t: [p.strip() for p in pattern.split(t) if p.strip()]
    units = [u for p in parts(PARAGRAPH_RAG, text) for u in (parts(SENTENCE_RAG, p) if count(p) > budget else [p])]
    chunks: list[str] = []
    held: list[str] = []
    for unit in [*units, None]:
        if unit is None or count(unit) > budget or (held and sum(map(count, held)) + count(unit) > budget):
            chunks += ["\n\n".join(held)] if held else []
            held = []
        if unit is not None:
            if count(unit) > budget:
                chunks += slices(unit, budget, tokens, budget - overlap)
            else:
                held.append(unit)
    return chunks[:1] + [_after(tokens.decode(tokens.encode(a)[-overlap:]) if overlap else "", b) for a, b in zip(chunks, chunks[1:], strict=False)]


class Encoding:
    """Tokens of a tiktoken encoding read from a vocabulary file, where one is at hand; the file is named by the caller."""

    def __init__(self, path: str, pattern: str, special: dict[str, int] | None = None):
        self.path, self.pattern, self.special, self._made = path, pattern, special or {}, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def _encoding(self):
        if self._made is None:
            import tiktoken
            from tiktoken.load import load_tiktoken_bpe

            self._made = tiktoken.Encoding(self.path, pat_str=self.pattern, mergeable_ranks=load_tiktoken_bpe(self.path), special_tokens=self.special)
        return self._made

    def encode(self, text: str) -> list[int]:
        return self._encoding().encode(text, disallowed_special=())

    def decode(self, tokens: list[int]) -> str:
        return self._encoding().decode(tokens)


def chunks(docs: DataFrame, how: Callable[..., list[str]] = chunk_text, **options) -> DataFrame:
    """doc_id, chunk_index, total_chunks, text for each chunk of each document; null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                pieces = how(text or "", **options)
                rows += [(doc, k, len(pieces), p) for k, p in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "total_chunks", "text"])

    # Ids pass through Python as text, which holds nulls and all numbers.
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id string, chunk_index int, total_chunks int, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
