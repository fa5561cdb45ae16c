"""Small graphs with values worked out by hand."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from lattica.operators import changes, components, identity, search, statistics, traverse


def graph(spark, edges, kind="r"):
    nodes = sorted({x for e in edges for x in e})
    entities = spark.createDataFrame([(n, n, "t", "default") for n in nodes], "id string, name string, type string, namespace_id string")
    relations = spark.createDataFrame([(f"{a}>{b}", a, kind, b) for a, b in edges], "id string, from_id string, type string, to_id string")
    return entities, relations


HUB = [("A", "SPEC"), ("SPEC", "B"), ("A", "HUB"), ("HUB", "B"), *[("HUB", f"D{k}") for k in range(8)]]


def test_hubs_come_last(spark):
    entities, relations = graph(spark, HUB)
    paths = traverse.shortest_paths(traverse.index(entities, relations), "A", "B").collect()
    assert [p["nodes"] for p in paths] == [["A", "SPEC", "B"], ["A", "HUB", "B"]]
    assert paths[0]["hub_score"] == pytest.approx(math.log(3)) and paths[1]["hub_score"] == pytest.approx(math.log(11))
    cut = traverse.expand(traverse.index(entities, relations, stored=False), ["A"], hops=1, max_nodes=2)
    assert cut.truncated and set(cut.hops) == {"A", "SPEC"}


def test_paths_of_no_and_one_step(spark):
    relations = traverse.index(*graph(spark, [("a", "b"), ("c", "d")]))
    assert traverse.shortest_paths(relations, "a", "c").collect() == []
    (one,) = traverse.shortest_paths(relations, "b", "a").collect()
    assert (one["length"], one["hub_score"]) == (1, 0.0)
    assert traverse.shortest_paths(relations, "a", "b", types=["other"]).collect() == []
    with pytest.raises(ValueError):
        traverse.shortest_paths(relations, "a", "a")


def test_proximity(spark):
    entities, relations = graph(spark, [("S", "A"), ("A", "B")])
    assert [tuple(r) for r in traverse.related(traverse.index(entities, relations), ["S"]).collect()] == [("A", 1.0, 1), ("B", 0.5, 2)]
    entities, relations = graph(spark, [("S1", "X"), ("S2", "X"), ("S1", "Y")])
    rows = traverse.related(traverse.index(entities, relations), ["S1", "S2"]).collect()
    assert rows[0]["id"] == "X" and rows[0]["score"] == 1.0 and "Y" in [r["id"] for r in rows]


def test_result_is_not_the_induced_subgraph(spark):
    entities, relations = graph(spark, [("S", "A"), ("S", "B"), ("A", "B")])
    near = traverse.expand(traverse.index(entities, relations, stored=False), ["S", "missing"], hops=1)
    assert {r["id"] for r in near.edges.collect()} == {"S>A", "S>B"} and not near.truncated


def test_seeds_may_exceed_the_cap(spark):
    entities, relations = graph(spark, [("a", "b"), ("c", "d")])
    near = traverse.expand(traverse.index(entities, relations, stored=False), ["a", "b", "c"], hops=2, max_nodes=2)
    assert set(near.hops) == {"a", "b", "c"} and near.truncated


def test_reads_stay_in_their_namespace(spark):
    entities, relations = graph(spark, [("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("x", "y"), ("a", "a")])
    entities = entities.selectExpr("id", "name", "type", "case when id in ('x', 'y') then 'other' when id = 'a' then null else 'default' end as namespace_id")
    at = traverse.index(entities, relations)
    near = traverse.expand(at, ["a", "x"], hops=2)
    assert set(near.hops) == {"a", "b", "c"} and {r["id"] for r in near.edges.collect()} == {"a>b", "b>c", "a>a"}
    assert set(traverse.expand(at, ["a", "x"], hops=2, namespace_id="other").hops) == {"x", "y"}
    (path,) = traverse.shortest_paths(at, "a", "c").collect()
    assert path["nodes"] == ["a", "b", "c"] and traverse.shortest_paths(at, "a", "x").collect() == []
    assert traverse.entity_exists(at, "a") and not traverse.entity_exists(at, "x") and traverse.stored_entity(entities, "x").count() == 1
    assert {(r["direction"], r["type"]): r["n"] for r in traverse.entity_counts(at, ["a"]).collect()} == {("outgoing", "r"): 2, ("incoming", "r"): 1}
    assert {r["id"] for r in traverse.entity_relations(at, "a").collect()} == {"a>b", "a>a"}
    assert {r["id"]: r["degree"] for r in traverse.degrees(relations, entities).collect()} == {"a": 3, "b": 2, "c": 1}


@pytest.mark.parametrize("small", [5000, 2])
def test_paths_against_brute_force(spark, monkeypatch, small):
    """All shortest paths of a dense random graph with parallel relations, by enumeration; levels as lists and as tables."""
    monkeypatch.setattr(traverse, "SMALL", small)
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(34)]
    rows = [(f"{k}", a, "pq"[k % 2], b) for k, (a, b) in enumerate(edges)]
    nodes = sorted({x for e in edges for x in e})
    entities = spark.createDataFrame([(n, n, "t", "default") for n in nodes], "id string, name string, type string, namespace_id string")
    relations = spark.createDataFrame(rows, "id string, from_id string, type string, to_id string")
    at = traverse.index(entities, relations)
    degree = Counter(x for e in edges for x in e)

    def brute(start, end, types):
        found, now = [], [([start], [], [])]
        for _ in range(6):
            now = [(n + [y], e + [i], t + [kind]) for n, e, t in now for i, a, kind, b in rows for x, y in ((a, b), (b, a)) if x == n[-1] and y not in n and n[-1] != end]
            found = [p for p in now if p[0][-1] == end]
            if found:
                break
        found = [p for p in found if not types or {*p[2]} <= {*types}]
        return sorted((len(e), round(sum(math.log1p(degree[x]) for x in n[1:-1]), 9), e, n) for n, e, _ in found)[:5]

    for end, types in [(nodes[-1], None), (nodes[5], ["p"]), (nodes[7], None)]:
        got = [(r["length"], r["hub_score"], r["edges"], r["nodes"]) for r in traverse.shortest_paths(at, nodes[0], end, max_hops=6, types=types).collect()]
        assert [g[:1] + g[2:] for g in got] == [w[:1] + w[2:] for w in brute(nodes[0], end, types)]
        assert [g[1] for g in got] == pytest.approx([w[1] for w in brute(nodes[0], end, types)])


@pytest.mark.parametrize("small", [20_000, 0])
def test_components_and_similarity(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 6), (9, 9), (6, 7), (7, 8), (8, 4)], "a bigint, b bigint")
    assert {r["node"]: r["component"] for r in components.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4, 8: 4, 9: 9}
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 3))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame([("k", k, v.tolist()) for k, v in enumerate(vectors)] + [("other", 100, vectors[0].tolist()), ("k", 101, [1.0])], "kind string, node bigint, vector array<double>")
    want = components_of({(i, j) for i in range(60) for j in range(i) if vectors[i] @ vectors[j] >= 0.97})
    for block in (100, 7):
        pairs = {(r["a"], r["b"]) for r in components.similar(df, 0.97, block).collect()}
        assert all(vectors[a] @ vectors[b] >= 0.97 - 1e-6 for a, b in pairs) and components_of(pairs) == want


def components_of(pairs):
    group = {}
    for a, b in pairs:
        x, y = group.get(a, {a}), group.get(b, {b})
        for n in x | y:
            group[n] = x | y
    return {frozenset(g) for g in group.values() if len(g) > 1}


def test_duplicates_and_overmerged(spark):
    rows = [("1", "Acme", ["the Company", "AB1234", "CD5678", "EF9012"]), ("2", " acme. ", []), ("3", "...", None)]
    df = spark.createDataFrame(rows, "id string, name string, aliases array<string>")
    assert [tuple(r) for r in statistics.duplicate_names(df).collect()] == [("acme", 2, "1")]
    assert [r["reasons"] for r in statistics.overmerged(df).collect()] == ["distinct_identifiers=3;non_identifying_aliases=1"]


def test_fusion(spark):
    lex = spark.createDataFrame([("a", "k", 2.0), ("b", "k", 1.0)], "id string, matched_keyword string, score double")
    den = spark.createDataFrame([("b", "k", 0.9), ("c", "k", 0.5)], "id string, matched_keyword string, score double")
    out = {r["id"]: r["score"] for r in search.fuse(lex, den).collect()}
    best = 1 / 62 + 1 / 61
    assert out == {"b": 1.0, "a": round(1 / 61 / best, 6), "c": round(1 / 62 / best, 6)}
    kinds = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "id string, type string")
    some = {r["id"]: (r["score"], r["lexical"], r["dense"]) for r in search.fuse(lex, den, kinds, ["x"]).collect()}
    assert some == {"a": (1.0, 2.0, 0.0), "c": (round(61 / 62, 6), 0.0, 0.5)}


def test_sequential_identity(spark):
    rows = [("ns", "org", "Acme Corp", ["ACME"], 1), ("ns", "org", "acme", ["we"], 2), ("ns", "org", "Other", ["we"], 3), ("ns", "person", "Acme", [], 4), ("ns", "org", "Acme Corp.", None, 5)]
    df = spark.createDataFrame(rows, "namespace_id string, type string, name string, aliases array<string>, seq bigint")
    got = {r["seq"]: (r["entity_seq"], r["step"]) for r in identity.match_sequential(df).collect()}
    assert got == {1: (1, 4), 2: (1, 1), 3: (3, 4), 4: (4, 4), 5: (1, 1)}
    asked = identity.questions(identity.resolve(df), df).collect()
    assert [(q["kind"], q["seq"], q["candidate_seq"], q["candidate_name"]) for q in asked] == []


def test_endpoints(spark):
    ends = spark.createDataFrame([(1, "f", "Acme"), (2, "f", "ACME "), (3, "f", "Twin"), (4, "f", "Solo"), (5, "g", "Acme")], "end_id int, source_path string, name string")
    in_file = spark.createDataFrame([("f", "Acme", "e1", 1), ("f", "Acme", "e2", 2)], "source_path string, name string, entity_id string, seq int")
    known = spark.createDataFrame([("t1", "Twin"), ("t2", "twin"), ("s", "solo")], "entity_id string, name string")
    got = {r["end_id"]: (r["entity_id"], r["how"]) for r in identity.resolve_endpoints(ends, in_file, known).collect()}
    assert got == {1: ("e2", "exact"), 2: ("e2", "normalized"), 3: (None, None), 4: ("s", "graph"), 5: (None, None)}


def test_split_decisions_and_moves(spark):
    rows = [("1", ["a"]), ("2", ["a", "b"]), ("3", ["b"]), ("4", []), ("5", ["a"])]
    df = spark.createDataFrame(rows, "id string, source_paths array<string>")
    assert {r["id"]: r["decision"] for r in changes.split_relations(df, ["a"], {"5": "keep"}).collect()} == {"1": "move", "2": "ask", "3": "keep", "4": "ask", "5": "keep"}
    rel = spark.createDataFrame([("1", "x", "r", "z", ["a"]), ("2", "y", "r", "z", ["b", "a"])], "id string, from_id string, type string, to_id string, source_paths array<string>")
    (row,) = changes.move_endpoint(rel, ["1"], "x", "y").collect()
    assert (row["from_id"], row["source_paths"]) == ("y", ["a", "b"])
