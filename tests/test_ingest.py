import json

import pytest

from lattica.functions import requests, text
from lattica.graph import KnowledgeGraph, NotFound
from lattica.operators import changes, evaluation, identity, ingest, projections, split
from lattica.sources import files
from lattica.sources.store import SnapshotStore
from lattica.streaming import incremental

A = "노드: Acme | org\n노드: Bob | person\n관계: Bob | works_at | Acme\nnoise"
B = "노드: Acme | org\n노드: Eve | person\n관계: Eve | works_at | Acme\n관계: Eve | knows | Zed"
C = "노드: Zed | person"


def docs(spark, *rows):
    return spark.createDataFrame([("default", p, t, k) for k, (p, t) in enumerate(rows)], "namespace_id string, source_path string, text string, seq bigint")


def state(store):
    now = ingest.state(store)
    nodes = {r["name"]: sorted({x["source_path"] for x in r["source_refs"]}) for r in now["entities"].collect()}
    names = {r["id"]: r["name"] for r in now["entities"].collect()}
    return nodes, {(names[r["from_id"]], r["type"], names[r["to_id"]]): sorted(r["source_paths"]) for r in now["relations"].collect()}


def test_ingest_trims_deletes_and_repeats(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/kg")
    _, change = ingest.ingest(docs(spark, ("a", A), ("b", B)), store)
    nodes, relations = state(store)
    assert nodes == {"Acme": ["a", "b"], "Bob": ["a"], "Eve": ["b"]}
    assert relations == {("Bob", "works_at", "Acme"): ["a"], ("Eve", "works_at", "Acme"): ["b"]}
    assert [(r["from_name"], r["to_name"]) for r in change.unresolved.collect()] == [("Eve", "Zed")]
    n = ingest.totals(change)
    assert (n["entities_created"], n["relations_created"], n["relations_unresolved"], n["step_1"], n["step_4"]) == (3, 2, 1, 1, 3)
    left = change.unresolved
    assert ingest.second_pass(store, left) == 0 and store.version() == 1
    version, change = ingest.ingest(docs(spark, ("a", A), ("b", B)), store)
    assert version == 1 and change.skipped == 2 and state(store) == (nodes, relations)
    # A source that changes loses what it no longer says; one whose bytes are new is read again against the whole graph.
    version, change = ingest.ingest(docs(spark, ("a", ""), ("c", C), ("b", B + "\n")), store)
    nodes, relations = state(store)
    assert nodes == {"Acme": ["b"], "Eve": ["b"], "Zed": ["c"]} and version == 2
    assert relations == {("Eve", "works_at", "Acme"): ["b"], ("Eve", "knows", "Zed"): ["b"]}
    assert store.read("entities", 1).count() == 3
    with pytest.raises(RuntimeError):
        store.publish({}, 1)
    more = left.replace("Eve", "Acme", "from_name")
    assert ingest.second_pass(store, more) == 1 and state(store)[1][("Acme", "knows", "Zed")] == ["b"]
    runs = {(r["source_path"], r["status"]) for r in store.read("runs").collect()}
    assert runs == {("a", "succeeded"), ("b", "succeeded"), ("c", "succeeded")}


def test_a_failing_source_holds_nothing_up(spark, tmp_path):
    store, asked = SnapshotStore(spark, f"file://{tmp_path}/kg"), []

    def call(path, said):
        if path == "bad":
            raise ValueError("no answer")
        return {"entities": [{"name": "Pump AB-1234", "type": "part", "aliases": ["the company"]}, {"name": "Other", "type": "part", "matched_existing_id": "nobody"}], "relations": [{"from_name": "pump ab-1234", "type": "of", "to_name": "Other"}]}

    _, change = ingest.ingest(docs(spark, ("good", "x"), ("bad", "y")), store, extract=ingest.called(call))
    runs = {r["source_path"]: (r["status"], r["error"]) for r in store.read("runs").collect()}
    assert runs == {"good": ("succeeded", None), "bad": ("failed", "ValueError: no answer")} and not asked
    (pump,) = ingest.state(store)["entities"].filter("name like 'Pump%'").collect()
    assert pump["aliases"] == ["the company", "AB-1234"] and pump["normalized_aliases"] == ["ab-1234"] and len(pump["embedding"]) == 64
    assert store.read("relations").count() == 1 and ingest.isolated_new(change).count() == 0
    counted = {r["source_path"]: (r["chunks"], r["entities"], r["failed"]) for r in ingest.dry_run(docs(spark, ("good", "x"), ("bad", "y")), ingest.called(call)).collect()}
    assert counted == {"good": (1, 2, 0), "bad": (1, 0, 1)} and store.version() == 1


def test_namespaces_are_written_and_read_apart(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/kg")
    graph = KnowledgeGraph(store)
    both = docs(spark, ("a", A)).unionByName(docs(spark, ("a", A)).replace("default", "two", "namespace_id"))
    ingest.ingest(both, store)
    other = {r["id"] for r in ingest.state(store)["entities"].filter("namespace_id = 'two'").collect()}
    assert len(other) == 2 and ingest.state(store)["entities"].count() == 4
    graph.ingest_delete("a", "default")
    plan = graph.ingest_delete("a", "default")
    assert plan["deletion_count"] == 3
    with pytest.raises(RuntimeError):
        graph.ingest_commit(plan["plan_id"])
    assert graph.ingest_preview(plan["plan_id"])["deletion_count"] == 3
    assert graph.ingest_commit(plan["plan_id"])["deletions"] == 3
    assert {r["id"] for r in ingest.state(store)["entities"].collect()} == other
    with pytest.raises(NotFound):
        graph.get_entity(min(other))
    assert graph.get_entity(min(other), "two")["edge_counts"].count() == 1
    assert [tuple(r) for r in graph.namespaces().collect()] == [("two", 2)]


def test_plans_questions_and_splits(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/kg")
    graph = KnowledgeGraph(store)
    key = graph.ingest_content("노드: Acme Holding | org\n노드: Bob | person\n관계: Bob | works_at | Acme Holding\n관계: Bob | of | Nowhere", "one")
    assert (key["entities_created"], key["relations_created"], key["open_questions"], key["warning_count"]) == (2, 1, 0, 1)
    seen = graph.ingest_preview(key["plan_id"])
    assert {(r["from_name"], r["to_name"]) for r in seen["new_relations"].collect()} == {("Bob", "Acme Holding")}
    assert seen["warnings"][0]["pairs"] == ["Bob -> Nowhere"] and store.version() == 0
    assert graph.ingest_commit(key["plan_id"])["entities_created"] == 2
    with pytest.raises(KeyError):
        graph.plans.get(key["plan_id"])
    # The same name under another type is asked about; the answer joins them, under the same plan.
    second = graph.ingest_content("노드: Acme Holding | company\n노드: Acme Ltd | org\n관계: Acme Ltd | owns | Acme Holding", "two")["plan_id"]
    questions = graph.ingest_preview(second)["questions"]
    assert [(q["kind"], q["similarity"]) for q in questions] == [("same_name_different_type", 1.0)]
    with pytest.raises(RuntimeError):
        graph.ingest_commit(second)
    with pytest.raises(ValueError):
        graph.ingest_resolve(second, {"q9": "keep"})
    assert graph.ingest_resolve(second, {questions[0]["id"]: "merge"})["open_questions"] == 0
    with pytest.raises(RuntimeError):
        graph.ingest_commit(second)
    assert {r["before_name"] for r in graph.ingest_preview(second)["merges"].collect()} == {"Acme Holding"}
    graph.ingest_commit(second)
    (acme,) = ingest.state(store)["entities"].filter("name = 'Acme Holding'").collect()
    assert sorted(r["source_path"] for r in acme["source_refs"]) == ["one", "two"]
    # A split by sources: relations follow them.
    with pytest.raises(ValueError):
        graph.entity_split_plan(acme["id"], "acme holding", move_source_paths=["two"])
    with pytest.raises(ValueError):
        graph.entity_split_plan(acme["id"], "Acme Two", move_source_paths=["one", "two"])
    planned = graph.entity_split_plan(acme["id"], "Acme Two", move_source_paths=["two"])
    assert (planned["relations_moved"], planned["relations_kept"], planned["open_questions"]) == (1, 1, 0)
    with pytest.raises(RuntimeError):
        graph.entity_split_commit(planned["plan_id"])
    assert len(graph.entity_split_preview(planned["plan_id"])["relations"]) == 2
    done = graph.entity_split_commit(planned["plan_id"])
    nodes, relations = state(store)
    assert nodes["Acme Two"] == ["two"] and nodes["Acme Holding"] == ["one"]
    assert relations == {("Bob", "works_at", "Acme Holding"): ["one"], ("Acme Ltd", "owns", "Acme Two"): ["two"]}
    held = {r["id"]: r["blocked_aliases"] for r in ingest.state(store)["entities"].collect()}
    assert held[done["origin_id"]] == ["acme two"] and "acme holding" in held[done["new_entity_id"]]
    # Reads of the facade.
    assert graph.find_entities(["acme two"], limit=1, include_scores=True)["matches"].first()["name"] == "Acme Two"
    assert graph.find_entities(limit=2)["total"] == 4 and graph.get_schema()["entity_types"].count() == 2
    bob = ingest.state(store)["entities"].filter("name = 'Bob'").first()["id"]
    assert {r["name"] for r in graph.get_neighbors(bob)["nodes"].collect()} == {"Bob", "Acme Holding"}
    assert graph.find_path(bob, done["origin_id"]).first()["length"] == 1 and graph.find_path(bob, done["new_entity_id"]).count() == 0
    assert [r["id"] for r in graph.find_related([bob]).collect()] == [done["origin_id"]]
    assert graph.graph_health()["isolated_total"] == 0 and graph.get_subgraph([bob, "none"])["entry_ids"] == [bob, "none"]


def test_undecided_splits_are_refused(spark):
    refs = [{"source_path": "x", "chunk_index": 0, "total_chunks": 1}, {"source_path": "y", "chunk_index": 0, "total_chunks": 1}]
    row = ("1", "default", "One", "one", "t", ["Two", "Uno"], ["two", "uno"], [], "d", [1.0], [tuple(r.values()) for r in refs], None, None)
    other = ("2", "default", "Other", "other", "t", [], [], [], "", [1.0], [], None, None)
    entities = spark.createDataFrame([row, other], ingest.STATE["entities"])
    relations = spark.createDataFrame([("r", "default", "1", "k", "2", ["x", "y"], [], None, None)], ingest.STATE["relations"])
    planned = split.plan(entities, relations, "1", "Two", move_aliases=["Two"])
    assert planned.new["aliases"] == [] and planned.kept["aliases"] == ["Uno"] and [q["id"] for q in planned.questions] == ["r"]
    with pytest.raises(RuntimeError):
        split.apply(entities, relations, planned)
    decided = split.plan(entities, relations, "1", "Two", move_aliases=["Two"], relation_decisions={"r": "move"})
    after, moved = split.apply(entities, relations, decided)
    assert {r["name"] for r in after.collect()} == {"One", "Two", "Other"} and moved.first()["from_id"] == decided.new["id"]
    for wrong in ({"move_aliases": ["Nope"]}, {}, {"move_aliases": ["Two"], "relation_decisions": {"zzz": "move"}}):
        with pytest.raises(ValueError):
            split.plan(entities, relations, "1", "Two", **wrong)
    with pytest.raises(ValueError):
        split.plan(entities, relations, "1", "Other", move_aliases=["Two"])
    with pytest.raises(KeyError):
        split.plan(entities, relations, "1", "Two", move_aliases=["Two"], namespace_id="else")


def test_resolution_rules(spark):
    """Blocked names, decisions, ids of an extractor, near misses and the order of steps."""
    stored = spark.createDataFrame(
        [("e1", "Northern Acme Trading Corporation", "org", "n", ["acme"], ["blocked name"], None), ("e2", "Blocked Names", "org", "n", [], ["blocked name"], None), ("e3", "Acme", "place", "n", [], [], None)],
        "id string, name string, type string, namespace_id string, normalized_aliases array<string>, blocked_aliases array<string>, embedding array<double>",
    )
    rows = [("n", "org", "ACME.", [], 1, None), ("n", "org", "Blocked Name", [], 2, None), ("n", "org", "Northern Acme Trading Corporations", [], 3, None), ("n", "org", "Zeta", ["we", "northern acme trading corporation"], 4, None), ("n", "org", "Fresh", [], 5, "e1"), ("n", "org", "fresh", [], 6, "gone"), ("other", "org", "Acme", [], 7, None), ("n", "person", "acme", [], 8, None), ("n", "org", "Kept", ["acme"], 9, None)]
    df = spark.createDataFrame(rows, "namespace_id string, type string, name string, aliases array<string>, seq bigint, matched_existing_id string")
    got = {r["seq"]: r for r in identity.resolve(df, stored, {"kept\x00org": "keep"}).collect()}
    assert (got[1]["entity_id"], got[1]["step"]) == ("e1", 1)
    assert (got[2]["entity_id"], got[2]["step"]) == (None, 4) and got[2]["near_id"] is None
    assert (got[3]["entity_id"], got[3]["step"]) == ("e1", 3) and got[3]["similarity"] >= 0.92
    assert (got[4]["entity_id"], got[4]["step"]) == ("e1", 2)
    assert (got[5]["entity_id"], got[5]["step"]) == ("e1", 0) and (got[6]["entity_id"], got[6]["step"]) == ("e1", 1)
    assert got[7]["entity_seq"] == 7 and got[7]["near_id"] is None
    assert got[8]["step"] == 4 and got[8]["near_id"] == "e3" and got[8]["similarity"] == 1.0
    assert got[9]["step"] == 4 and got[9]["entity_seq"] == 9 and got[9]["near_id"] is None


def test_stream(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/kg")
    schema = "source_path string, text string, seq bigint"
    source = f"file://{tmp_path}/in"
    spark.createDataFrame([("a", A, 1), ("b", "", 1), ("b", B, 2)], schema).coalesce(1).write.parquet(source)
    for _ in range(2):
        incremental.stream(spark.readStream.schema(schema).parquet(source), store, f"file://{tmp_path}/ck").awaitTermination(300)
    assert state(store)[0] == {"Acme": ["a", "b"], "Bob": ["a"], "Eve": ["b"]} and store.version() == 1


def test_store_refuses_the_second_of_two_writers(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/kg")
    one = spark.createDataFrame([("1",)], "id string")
    assert store.publish({"runs": one}, 0) == 1
    # Both began at version 1: the second finds its number taken when it is done.
    late = SnapshotStore(spark, f"file://{tmp_path}/kg")
    late.version = lambda: 1
    assert store.publish({"runs": one.union(one)}, 1) == 2
    with pytest.raises(RuntimeError):
        late.publish({"runs": one}, 1)
    assert store.version() == 2 and store.read("runs").count() == 2 and store.read("runs", 1).count() == 1
    assert store.publish({"runs": one}, 2, append=("runs",)) == 3 and store.read("runs").count() == 3


def test_plan_registry():
    plans = changes.Plans()
    key = plans.add("first")
    assert not plans.previewed(key)
    plans.saw(key)
    assert plans.previewed(key) and plans.add("second", key) == key and not plans.previewed(key) and plans.get(key) == "second"
    late = changes.Plans(seconds=1e-9)
    with pytest.raises(KeyError):
        late.get(late.add("x"))


def test_bridges_and_projections(spark):
    links = spark.createDataFrame([("r", "1")], "run_id string, relation_id string")
    assert changes.append_emitted(links, "r", ["1", "2"], "relation_id").count() == 2
    rows = spark.createDataFrame([("1", "n" * 300, "t" * 99, None, None, None, ["p", "q"], [3, -1], None)], "id string, name string, type string, aliases array<string>, description string, namespace_id string, paths array<string>, chunks array<int>, totals array<int>")
    from pyspark.sql import functions as F

    held = rows.withColumn("source_refs", projections.refs_from_arrays(F.col("paths"), F.col("chunks"), F.col("totals")))
    (node,) = projections.nodes(held).collect()
    assert (len(node["name"]), len(node["type"]), node["aliases"]) == (200, 64, [])
    assert [tuple(r) for r in node["source_refs"]] == [("p", 3, None), ("q", None, None)]
    assert [list(x) for x in held.select(*projections.arrays_from_refs(F.col("source_refs"))).first()] == [["p", "q"], [3, -1], [-1, -1]]
    body = json.loads(projections.as_json(projections.nodes(held)).first()["body"])
    assert "description" not in body and body["aliases"] == []
    kept = projections.stored(held.withColumns({"normalized_name": F.lit(None).cast("string")})).first()
    assert kept["namespace_id"] == "default" and kept["normalized_name"] == ""
    edge = projections.edges(spark.createDataFrame([("e", "a", "b", "", ["p"])], "id string, from_id string, to_id string, type string, source_paths array<string>")).first()
    assert edge["type"] == "RELATES_TO" and edge["source_refs"][0]["source_path"] == "p"
    assert requests.namespace_id("a.b:c") == "a.b:c"


def test_backfill(spark):
    df = spark.createDataFrame([("1", " Acme ", None, ["A.", "we"], None, [1.0]), ("2", "B", "b", [], [], None)], "id string, name string, normalized_name string, aliases array<string>, normalized_aliases array<string>, embedding array<double>")
    got = {r["id"]: r for r in ingest.backfill(df, dimension=64).collect()}
    assert got["1"]["normalized_name"] == "acme" and got["1"]["normalized_aliases"] == ["a"] and len(got["1"]["embedding"]) == len(got["2"]["embedding"]) == 64


# --- files ----------------------------------------------------------------------------------------------------------


def test_files(spark, tmp_path):
    for name, content in {"a.md": b"x", "sub/b.txt": "é".encode(), "node_modules/c.md": b"n", ".hidden/d.md": b"h", "e.xyz": b"?", "skip/f.md": b"s", "skip/keep.md": b"k", "g.png": b"\x89PNG\r\n\x1a\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = files.crawl(spark, f"file://{tmp_path}", ["skip/*", "# note", "!skip/keep.md"])
    assert {r["path"]: r["kind"] for r in found.select("path", "kind").collect()} == {"a.md": "supported", "sub/b.txt": "supported", "e.xyz": "unsupported", "g.png": "supported", "skip/keep.md": "supported"}
    assert {r["text"] for r in files.texts(found).collect()} == {"x", "é", "k"} and files.crawl_summary(found).first()["unsupported"] == 1
    assert files.images(found).first()["mime"] == "image/png"
    import hashlib

    rest = found.filter("path in ('a.md', 'sub/b.txt')")
    assert files.corpus_hash(rest) == hashlib.sha256(b"a.md\0x\xffsub/b.txt\0" + "é".encode() + b"\xff").hexdigest()
    assert files.ignore_regex("*.md") == r"(^|/)[^/]*\.md(/|$)"
    blocks = {r["path"]: r["block"] for r in files.serialized(found.filter("kind = 'supported'")).collect()}
    assert blocks["a.md"] == "=== FILE: a.md ===\nx" and blocks["g.png"].startswith("=== IMAGE: g.png ===\n")
    with pytest.raises(Exception, match="unknown file type"):
        files.serialized(found).collect()


def test_pages(spark):
    png = b"\x89PNG\r\n\x1a\n1234"

    def reader(content):
        if content == b"broken":
            raise ValueError("no PDF")
        yield from [("one two. " * 4, [png]), (" ", [png, png]), ("", []), ("last", [])]

    pdfs = spark.createDataFrame([("a.pdf", "pdf", b"x"), ("b.pdf", "pdf", b"broken")], "path string, ext string, content binary")
    pages = files.pdf_pages(pdfs, reader)
    rows = pages.collect()
    assert [r["page"] for r in rows if r["path"] == "a.pdf"] == [0, 1, 2, 3] and [r["error"] for r in rows if r["path"] == "b.pdf"] == ["ValueError: no PDF"]
    units = files.pdf_units(pages.withColumn("images", files.page_images()), budget=6, overlap_ratio=0).orderBy("chunk_index").collect()
    assert [(u["chunk_index"], u["page"], len(u["images"])) for u in units] == [(0, 0, 1), (1, 0, 0), (2, 1, 2), (3, 3, 0)]
    assert units[2]["text"] is None and units[3]["text"] == "last"
    none = spark.createDataFrame([], "path string, ext string, content binary, length bigint")
    (unit,) = files.text_units(none, pages).collect()
    assert unit["path"] == "a.pdf" and unit["text"].endswith(". \n\nlast")
    (block,) = files.serialized(none, pages).collect()
    assert block["block"].startswith("=== FILE: a.pdf ===\n\n--- PAGE 1/4 ---\none two.") and "--- PAGE 2/4 (이미지 페이지) ---" in block["block"] and "2 장" in block["block"]


def test_cache_and_responses(spark, tmp_path):
    units = spark.createDataFrame([("k1", False, "x"), ("k1", False, "x"), ("k2", True, "y")], "key string, image boolean, text string")
    calls = []

    def call(df):
        calls.append(df.count())
        return df.selectExpr("key", "upper(text) as result")

    path = f"file://{tmp_path}/cache"
    for _ in range(2):
        assert {tuple(r) for r in files.extract_cached(units, path, call).collect()} == {("k1", "X"), ("k2", "Y")}
    assert calls == [1, 1, 0, 1] and spark.read.parquet(path).count() == 1
    (tmp_path / "one.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "b.json").write_text('{"a":\n 4}')
    (tmp_path / "two" / "a.json").write_text('{"a": 3}')
    read = lambda s: [json.loads(r["body"])["a"] for r in files.responses(spark, f"file://{tmp_path}", s).collect()]
    assert (read("one"), read("two"), read("none")) == ([1, 2], [3, 4], [])
    dataset, questions = files.question_set(spark, "dataset_id: d\nquestions:\n- id: Q01\n  question: what is it\n  options:\n  - {id: a, text: yes it is, is_correct: true}\n  reference_reasoning: because\n")
    assert dataset == "d" and questions.first()["options"][0]["is_correct"] is True and questions.first()["expected_sources"] == []
    prices = files.price_table(spark, "openai/m:\n  input: 2\n  output: 8\nv/n:\n  input: 1\n")
    asked = spark.createDataFrame([("m",), ("v/n",), ("x",)], "model string")
    assert {r["model"]: r["in_price"] for r in evaluation.priced(asked, prices).collect()} == {"m": 2.0, "v/n": 1.0, "x": None}


# --- evaluation -----------------------------------------------------------------------------------------------------


def test_statistics_of_the_evaluation(spark):
    rows = [("s", 1, 1, q, t, float(t), 0.0) for q, t in zip([0, 1, 2, 2], [1, 2, 3, 4], strict=True)] + [("s", 2, 0, None, 5, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "strategy string, question_id int, correct int, quality int, tokens int, latency double, price double")
    (m,) = evaluation.aggregate_columns(df).collect()
    assert (m["accuracy"], m["quality_median"], m["tokens_p95"], m["response_count"]) == (0.5, 0.5, 5, 5)
    hundred = spark.range(1, 101).selectExpr("'s' as strategy", "id as tokens")
    assert evaluation.nearest_rank(hundred, "tokens", 0.95, "p").first()["p"] == 95 and evaluation.nearest_rank(hundred.filter("tokens < 4"), "tokens", 0.95, "p").first()["p"] == 3
    lost = spark.createDataFrame([("s", "wrong_choice", 1)], "strategy string, failure string, n int")
    said = evaluation.report(evaluation.aggregate_columns(df), lost, {"full": "s", "rag": "r", "graph": "g"}, questions=2)
    assert "| s (full) | 5 | 50.0% |" in said and "no verdict" in said and "| s | 0 | 1 | 0 |" in said and "| r (rag) | - |" in said
    three = df.unionByName(df.replace("s", "r", "strategy")).unionByName(df.replace("s", "g", "strategy"))
    assert "\npassed\n" in evaluation.report(evaluation.aggregate_columns(three), lost, {"full": "s", "rag": "r", "graph": "g"})
    assert (evaluation.amortised(10, 3), evaluation.amortised(10, 0)) == (3, 10)


def test_judge():
    answers = iter([{"score": 5}, {"score": 2, "rationale": "ok"}, ValueError("down"), {"score": "1"}, {"score": 1}])

    def call(_):
        said = next(answers)
        if isinstance(said, Exception):
            raise said
        return said

    assert evaluation.judge(call, "q") == {"score": 2, "rationale": "ok", "error": None, "retried": True}
    assert evaluation.judge(call, "q")["error"] == "the score is no whole number"
    assert evaluation.judge(call, "q", evaluation.FAITHFULNESS_SCORES) == {"score": 1, "rationale": "", "error": None, "retried": False}


OPTIONS = "array<struct<id:string,text:string,is_correct:boolean,failure_mode_tested:string>>"


def test_lint(spark):
    unsure = ("e", "정보 부족", False, "retrieval_failure")
    good = ("Q01", "what is it", "single_doc", 1, [("a", "x", True, None), ("b", "y", False, "m"), ("c", "z", False, None), unsure], "r" * 60, ["corpus/p.md", "p.md"], [])
    bad = ("X1", "hm", "odd", 9, [("a", "x", True, None), ("z", "", True, "unknown")], "r" * 19, ["gone.md", "/abs.md"], [])
    none = ("Q02", "what else", "single_doc", 2, [("a", "x", False, None), ("b", "y", False, None), ("c", "z", False, None), unsure], "r" * 501, [], [])
    q = spark.createDataFrame([good, bad, none], files.QUESTION)
    found = evaluation.lint_questions(q, spark.createDataFrame([("p.md",), (".archeignore",), ("x.exe",)], "path string"), ["m", "retrieval_failure"])
    got = {(r["rule"], r["id"]) for r in found.collect()}
    assert got == {("multiple_correct_answers", "X1"), ("missing_info_insufficient_option", "X1"), ("unknown_failure_mode", "X1"), ("expected_source_missing", "X1"), ("expected_source_absolute_path", "X1"), ("reference_too_short", "X1"), ("no_correct_answer", "Q02"), ("reference_too_long", "Q02"), ("domain_pattern_skewed", None), ("unsupported_corpus_file", "x.exe")}
    form = evaluation.schema_faults(q)
    assert {(r["id"], r["rule"]) for r in form.collect()} == {("X1", x) for x in ("id_shape", "question_length", "reference_reasoning_length", "domain_pattern", "hops_required", "option_count", "option_id", "option_text")}
    assert {r["rule"] for r in evaluation.lint(form, found).collect()} >= {"schema_violation:id_shape", "unsupported_corpus_file"} and evaluation.lint(form, found).filter("rule = 'no_correct_answer'").isEmpty()
    assert evaluation.meta_faults({"dataset_id": "d", "domain": 1, "corpus": {"file_count": -1}}) == [("domain", "no text"), ("language", "missing"), ("corpus.file_count", "no count")]


def test_dry_run_units(spark):
    seen = spark.createDataFrame([("a.pdf", "pdf"), ("b.png", "png"), ("c.md", "md"), (".h.png", "png")], "path string, ext string")
    chunks = spark.createDataFrame([(7,), (8,)], "tokens int")
    assert sorted(r[0] for r in evaluation.dry_run_units(seen, chunks).collect()) == [7, 8, 800, 1500]


def test_strategies(spark, tmp_path):
    from lattica.operators import strategies

    store = SnapshotStore(spark, f"file://{tmp_path}/kg")
    ingest.ingest(docs(spark, ("a.md", A), ("b.md", B)), store)
    graph = KnowledgeGraph(store)
    vectors = [("c1", identity.trigram_embedding("Bob works").tolist(), "a.md", 0, "Bob works at Acme"), ("c2", identity.trigram_embedding("weather").tolist(), "z.md", 0, "It rains")]
    chunks = spark.createDataFrame(vectors, "id string, vector array<double>, source_path string, chunk_index int, text string")
    prompts, options = [], [("a", "Acme"), ("b", "Other")]

    def answer(p):
        prompts.append(p)
        return {"choice": " A "}

    anchors = lambda q: [("Bob", []), ("Acme", ["ACME"])]
    got = strategies.augmented("Where does Bob work?", options, graph, anchors, chunks, identity.trigram_embedding, answer, top=1)
    assert got["choice"] == "a" and got["reason"] == "sources" and "Bob works at Acme" in prompts[-1] and "It rains" not in prompts[-1]
    assert got["read"]["names"] == ["Bob", "Acme", "ACME"] and got["read"]["sources"][0] in ("a.md", "b.md") and "works_at" in got["read"]["text"]
    nothing = strategies.graph_only("?", options, graph, lambda q: [], answer)
    assert nothing["read"]["entries"] == [] and strategies.NO_GRAPH in prompts[-1]
    assert strategies.chunk_rag("weather", options, chunks, identity.trigram_embedding, answer, top=1)["choice"] == "a" and "It rains" in prompts[-1]
    steps = iter(["no json", {"next": "call", "primitive": "nope", "args": {}}, {"next": "call", "primitive": "get_schema"}, '```json\n{"next": "call", "primitive": "get_schema"}\n```'])
    run = strategies.agentic("?", options, graph, lambda p: next(steps), answer)
    assert run["forced"] and run["choice"] == "a" and len(run["steps"]) == 4 and "same read again" in prompts[-1]
    assert strategies.agentic("?", options, graph, lambda p: {"next": "answer", "choice": "B"}, answer)["forced"] is False
    assert strategies.dispatch(graph, "get_entity", {})[1] == "get_entity needs id" and strategies.dispatch(graph, "get_entity", {"id": "X"})[1].startswith("NotFound")
    grid = strategies.sweep(lambda q, max_nodes: {"n": max_nodes}, ["x", "y"], max_nodes=[80, 200])
    assert [(g["question"], g["n"]) for g in grid] == [(0, 80), (1, 80), (0, 200), (1, 200)]


def test_small_text_functions(spark):
    from pyspark.sql import functions as F

    refs = "array<struct<source_path:string,chunk_index:int>>"
    row = spark.createDataFrame([([("a", 1), ("a", None)], [("a", 1), ("b", 1), ("b", 1)], '```json\n{"x": 3}\n```')], f"a {refs}, b {refs}, j string")
    out = row.select(text.source_ref_union(F.col("a"), F.col("b")).alias("u"), text.lenient_json(F.col("j"), "x int").alias("j"), text.extractor_version(2, F.lit("p"), F.lit("s"), F.lit("m")).alias("v")).first()
    assert [tuple(r) for r in out["u"]] == [("a", 1), ("a", None), ("b", 1)] and out["j"]["x"] == 3 and len(out["v"]) == 19 and out["v"].startswith("p2:")
