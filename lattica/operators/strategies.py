"""Ways of answering questions, composed of graph reads and chunk search; models are functions of the caller.

A model is called with a prompt and gives text, or a dictionary of an answer. Every strategy gives the record of its
run: what it read, what it asked, and what came back.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import KnowledgeGraph, NotFound
from lattica.operators import context, search

Model = Callable[[str], dict]
#: Chunks that are searched, entries, nodes and steps of a read, and the choices of a question.
TOP_CHUNKS, MAX_ENTRIES, MAX_STEPS = 8, 10, 6
CHOICES = ("a", "b", "c", "d", "e")
NO_CHUNKS = {"chunks": "(검색 결과 없음)", "guided": "(그래프 진입점에 연결된 원본 발췌 없음)"}
NO_GRAPH = "(엔티티 없음)\n(관계 없음)"
PRIMITIVES = ("find_entities", "get_entity", "get_neighbors", "find_path", "get_subgraph", "get_schema")


def options_block(options: list[tuple[str, str]]) -> str:
    return "\n".join(f"{o}) {text}" for o, text in options)


def prompt(question: str, options: list[tuple[str, str]], *blocks: str) -> str:
    """The blocks of what was read, the question and its options, parted by blank lines."""
    return "\n\n".join([*blocks, question, options_block(options)])


def chosen(answer: dict | None) -> str | None:
    """The choice of an answer, trimmed and in lower case; none if it is no choice."""
    said = str((answer or {}).get("choice", "")).strip().lower()
    return said if said in CHOICES else None


def chunk_texts(hits: DataFrame, chunks: DataFrame, kind: str = "chunks") -> str:
    """Hits (id, similarity) of one query as text, the nearest first: number, source and chunk index, then the text."""
    rows = hits.join(chunks.select("id", "source_path", "chunk_index", "text"), "id").orderBy(F.col("similarity").desc(), "id").collect()
    blocks = [f"--- 청크 {k} (출처: {r['source_path']}:{r['chunk_index']}) ---\n{r['text']}" for k, r in enumerate(rows, 1)]
    return "\n\n".join(blocks) or NO_CHUNKS[kind]


def full_context(question: str, options: list[tuple[str, str]], corpus: str, answer: Model) -> dict:
    """The whole corpus as one text before the question."""
    said = answer(prompt(question, options, corpus))
    return {"strategy": "full_context", "choice": chosen(said), "answer": said}


def _query(spark, question: str, embed: Callable[[str], np.ndarray]) -> DataFrame:
    return spark.createDataFrame([(0, [float(x) for x in embed(question)])], "query int, vector array<double>")


def chunk_rag(question: str, options: list[tuple[str, str]], chunks: DataFrame, embed: Callable[[str], np.ndarray], answer: Model, *, top: int = TOP_CHUNKS) -> dict:
    """The nearest chunks (id, vector, source_path, chunk_index, text) before the question."""
    hits = search.dense(_query(chunks.sparkSession, question, embed), chunks, top)
    said = answer(prompt(question, options, chunk_texts(hits, chunks)))
    return {"strategy": "chunk_rag", "choice": chosen(said), "answer": said}


def read_graph(graph: KnowledgeGraph, question: str, anchors: Callable[[str], list[tuple[str, list[str]]]], *, max_nodes: int = 200, namespace_id: str = "default") -> dict:
    """What a question reads: its anchors' names, the entities that they find, the subgraph around those, and paths of pairs.

    anchors gives names with aliases, and is asked again once if it fails. Gives names, entries, plan, text and sources.
    """
    names: list[str] = []
    for _ in range(2):
        try:
            names = context.anchor_names(anchors(question))
            break
        except Exception:  # noqa: BLE001
            continue
    entries: list[str] = []
    if names:
        found = graph.find_entities(names[: search.MOST_KEYWORDS], limit=MAX_ENTRIES, namespace_id=namespace_id)["matches"]
        entries = [r["id"] for r in found.select("id").collect()]
    plan = context.read_plan(entries)
    out = {"names": names, "entries": entries, "plan": plan, "text": NO_GRAPH, "sources": [], "truncated": False}
    if not plan["hops"]:
        return out
    near = graph.get_subgraph(entries, hops=plan["hops"], max_nodes=max_nodes, namespace_id=namespace_id)
    lines, through = [], []
    for a, b in plan["pairs"]:
        for p in graph.find_path(a, b, namespace_id=namespace_id).collect():
            lines.append((p["nodes"], p["edges"], p["hub_score"]))
            through += p["nodes"]
    state = graph.state()
    held = state["entities"].filter(F.col("id").isin(list(dict.fromkeys(through)) or [""])).select("id", "name")
    shown = {r["id"]: r["name"] for r in held.collect()}
    used = [e for _, edges, _ in lines for e in edges]
    types = {r["id"]: r["type"] for r in state["relations"].filter(F.col("id").isin(used or [""])).select("id", "type").collect()}
    paths = [context.path_line([shown.get(n, n) for n in nodes], [types[e] for e in edges], hub) for nodes, edges, hub in lines]
    sources = [
        df.select(F.posexplode("source_refs").alias("position", "ref")).select(F.col("ref.source_path").alias("source_path"), "position") for df in (near["nodes"], near["edges"])
    ]
    named = context.source_paths(*sources).orderBy("part", "position", "source_path")
    return out | {"text": context.graph_text(context.graph_blocks(near["nodes"], near["edges"]), paths), "sources": [r["source_path"] for r in named.collect()], "truncated": near["truncated"]}


def graph_only(question: str, options: list[tuple[str, str]], graph: KnowledgeGraph, anchors, answer: Model, **options_) -> dict:
    read = read_graph(graph, question, anchors, **options_)
    said = answer(prompt(question, options, read["text"]))
    return {"strategy": "graph", "choice": chosen(said), "answer": said, "read": read}


def combined(question: str, options: list[tuple[str, str]], graph: KnowledgeGraph, anchors, chunks: DataFrame, embed, answer: Model, *, top: int = TOP_CHUNKS, **options_) -> dict:
    """The nearest chunks of all, and what the graph says."""
    read = read_graph(graph, question, anchors, **options_)
    hits = search.dense(_query(chunks.sparkSession, question, embed), chunks, top)
    said = answer(prompt(question, options, chunk_texts(hits, chunks), read["text"]))
    return {"strategy": "combined", "choice": chosen(said), "answer": said, "read": read}


def augmented(question: str, options: list[tuple[str, str]], graph: KnowledgeGraph, anchors, chunks: DataFrame, embed, answer: Model, *, top: int = TOP_CHUNKS, **options_) -> dict:
    """The nearest chunks of the sources that the graph names, of all where it names none, and what the graph says."""
    read = read_graph(graph, question, anchors, **options_)
    hits = context.guided_chunks(_query(chunks.sparkSession, question, embed), chunks, read["sources"], top)
    said = answer(prompt(question, options, chunk_texts(hits, chunks, "guided"), read["text"]))
    reason = hits.select("reason").first()
    return {"strategy": "augmented", "choice": chosen(said), "answer": said, "read": read, "reason": reason[0] if reason else None}


def triple(question: str, options: list[tuple[str, str]], graph: KnowledgeGraph, anchors, chunks: DataFrame, embed, answer: Model, *, top: int = TOP_CHUNKS, joined: bool = False, **options_) -> dict:
    """Chunks of the graph's sources, the nearest of all, and what the graph says; joined takes each chunk once, at its best."""
    read = read_graph(graph, question, anchors, **options_)
    asked = _query(chunks.sparkSession, question, embed)
    near, all_ = context.guided_chunks(asked, chunks, read["sources"], top), search.dense(asked, chunks, top)
    if joined:
        both = [h.join(chunks.select("id", "source_path", "chunk_index"), "id").withColumnRenamed("similarity", "score") for h in (near, all_)]
        best = search.distinct_chunks(*both, limit=top).join(chunks.select("id", "source_path", "chunk_index"), ["source_path", "chunk_index"])
        blocks = [chunk_texts(best.select("id", F.col("score").alias("similarity")), chunks)]
    else:
        blocks = [chunk_texts(near, chunks, "guided"), chunk_texts(all_, chunks)]
    said = answer(prompt(question, options, *blocks, read["text"]))
    return {"strategy": "triple_joined" if joined else "triple", "choice": chosen(said), "answer": said, "read": read}


def _plain(value):
    return [r.asDict(recursive=True) for r in value.collect()] if isinstance(value, DataFrame) else {k: _plain(v) for k, v in value.items()} if isinstance(value, dict) else value


def step(said) -> dict | None:
    """A step that a model asked for, from a dictionary or its JSON in text, fenced or not; none if it is none."""
    if isinstance(said, str):
        body = re.sub(r"^```(?:json)?\s*|\s*```$", "", said.strip())
        try:
            said = json.loads(body)
        except ValueError:
            return None
    return said if isinstance(said, dict) and said.get("next") in ("call", "answer") else None


def dispatch(graph: KnowledgeGraph, primitive: str, args: dict, namespace_id: str = "default") -> tuple[object, str | None]:
    """What a read gives, or what is wrong with it; a model may call these six reads only."""
    needs = {"find_entities": ["keywords"], "get_entity": ["id"], "get_neighbors": ["id"], "find_path": ["from_id", "to_id"], "get_subgraph": ["entry_ids"], "get_schema": []}
    if primitive not in PRIMITIVES:
        return None, f"no such read: {primitive!r}"
    if missing := [n for n in needs[primitive] if not args.get(n)]:
        return None, f"{primitive} needs {', '.join(missing)}"
    args = dict(args)
    first = [args.pop(n) for n in needs[primitive]]
    try:
        return _plain(getattr(graph, primitive)(*first, namespace_id=namespace_id, **args)), None
    except (NotFound, ValueError, TypeError) as e:
        return None, f"{type(e).__name__}: {e}"


def agentic(question: str, options: list[tuple[str, str]], graph: KnowledgeGraph, model: Callable[[str], object], answer: Model, *, max_steps: int = MAX_STEPS, namespace_id: str = "default") -> dict:
    """A model reads the graph step by step and then answers; out of steps, or asking the same twice, it has to answer.

    model gives {next: call, primitive, args} or {next: answer, choice}; what it read, or what was wrong, goes before its
    next step.
    """
    seen: list[str] = []
    steps, last, choice = [], None, None
    for left in range(max_steps, 0, -1):
        said = step(model(prompt(question, options, *seen, f"({left})")))
        steps.append(said)
        if said is None:
            seen.append("the step could not be read; answer with next=answer if you can")
        elif said["next"] == "answer":
            if choice := chosen(said):
                return {"strategy": "agentic", "choice": choice, "steps": steps, "forced": False, "observations": seen}
            seen.append(f"the choice has to be one of {', '.join(CHOICES)}")
        else:
            key = (said.get("primitive"), json.dumps(said.get("args") or {}, sort_keys=True))
            if key == last:
                seen.append("the same read again: answer from what was read")
                break
            last = key if key[0] in PRIMITIVES else last
            data, wrong = dispatch(graph, str(key[0]), said.get("args") or {}, namespace_id)
            seen.append(f"[{key[0]}] {wrong or json.dumps(data, ensure_ascii=False, default=str)}")
    said = answer(prompt(question, options, *(seen or [NO_GRAPH])))
    return {"strategy": "agentic", "choice": chosen(said), "steps": steps, "forced": True, "observations": seen, "answer": said}


def sweep(run: Callable[..., dict], questions: list, **grid: list) -> list[dict]:
    """run(question, **setting) of every question under every setting of a grid, such as max_nodes, in order."""
    settings = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    return [{"setting": s, "question": k, **run(q, **s)} for s in settings for k, q in enumerate(questions)]
