"""Registered queries over the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import chunking, text
from lattica.operators import changes, context, evaluation, identity, ingest, projections, search, statistics, traverse
from lattica.plans.stargraph import GRAPH_SQL, entities, graph, relation_rows, relations, table
from lattica.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = False):  # noqa: A002
    """Register a query under its function's name; graph puts the views of the star graph before its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {GRAPH_SQL} {sql}" if graph else sql
        return f

    return register


def quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def expand_sql(seeds: list[str], hops: int, most: int, direction: str = "both", types: list[str] | None = None) -> str:
    """CTEs f0.., v0.. (visited after each hop), x (expanded), s (edges), of the capped breadth-first search."""
    only = f" WHERE type IN ({quoted(types)})" if types else ""
    ends = {"outgoing": "SELECT from_id AS src, to_id AS dst, id, type FROM r", "incoming": "SELECT to_id AS src, from_id AS dst, id, type FROM r", "both": "SELECT * FROM a"}[direction]
    out = [f"j AS (SELECT * FROM ({ends}){only})", f"f0 AS (SELECT id, 0 AS hop FROM e WHERE id IN ({quoted(seeds)}))", "v0 AS (SELECT * FROM f0)", "t0 AS (SELECT false AS cut)"]
    for k in range(1, hops + 1):
        b = k - 1
        out += [
            f"c{k} AS (SELECT DISTINCT dst AS id FROM j JOIN f{b} ON src = f{b}.id WHERE NOT (SELECT cut FROM t{b}) AND dst NOT IN (SELECT id FROM v{b}))",
            f"t{k} AS (SELECT (SELECT cut FROM t{b}) OR (SELECT count(*) FROM c{k}) > {most} - (SELECT count(*) FROM v{b}) AS cut)",
            f"f{k} AS (SELECT id, {k} AS hop FROM (SELECT id, row_number() OVER (ORDER BY degree, id) AS n FROM c{k} JOIN g USING (id)) WHERE n <= {most} - (SELECT count(*) FROM v{b}))",
            f"v{k} AS (SELECT * FROM v{b} UNION ALL SELECT * FROM f{k})",
        ]
    done = " UNION ALL ".join(f"SELECT id FROM f{k} WHERE NOT (SELECT cut FROM t{k})" for k in range(hops))
    out += [f"x AS ({done})", f"s AS (SELECT DISTINCT j.id, j.type, r.from_id, r.to_id FROM j JOIN r ON j.id = r.id WHERE j.src IN (SELECT id FROM x) AND j.dst IN (SELECT id FROM v{hops}))"]
    return ", ".join(out)


SEEDS = ["S1", "S2", "S3"]


# --- traversal ----------------------------------------------------------------------------------------------------


@query("SELECT id, degree FROM g", graph=True)
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.degrees(relations(spark, sf_dir))


def _neighbours(direction):
    def run(spark, sf_dir):
        return traverse.expand(graph(spark, sf_dir), ["N1"], direction=direction, hops=1, max_nodes=100).nodes

    run.__name__ = f"graph_neighbours_{direction}"
    return query(f", {expand_sql(['N1'], 1, 100, direction)} SELECT id, hop FROM v1", graph=True)(run)


for _direction in ("both", "outgoing", "incoming"):
    _neighbours(_direction)


@query(f", {expand_sql(['O1', 'O2'], 2, 60)} SELECT id, hop FROM v2", graph=True)
def graph_subgraph_nodes(spark, sf_dir):
    return traverse.expand(graph(spark, sf_dir), ["O1", "O2"], hops=2, max_nodes=60).nodes


@query(f", {expand_sql(['O1', 'O2'], 2, 60)} SELECT id, type, from_id, to_id FROM s", graph=True)
def graph_subgraph_edges(spark, sf_dir):
    return traverse.expand(graph(spark, sf_dir), ["O1", "O2"], hops=2, max_nodes=60).edges


@query(f", {expand_sql(['S1'], 3, 400, types=['supplied_by'])} SELECT id, hop FROM v3", graph=True)
def graph_subgraph_typed(spark, sf_dir):
    return traverse.expand(graph(spark, sf_dir), ["S1"], types=["supplied_by"], hops=3, max_nodes=400).nodes


@query(
    f""", {expand_sql(SEEDS, 2, 100)},
w AS (SELECT from_id AS p, to_id AS q FROM s UNION SELECT to_id, from_id FROM s),
d AS (SELECT id AS seed, id AS node, 0 AS d FROM f0 UNION SELECT seed, q, d + 1 FROM d JOIN w ON node = p WHERE d < 6),
m1 AS (SELECT seed, node, min(d) AS d FROM d GROUP BY seed, node),
z AS (SELECT node AS id, sum(pow(0.5, d)) AS total, min(d) AS distance FROM m1 WHERE node NOT IN (SELECT id FROM f0) GROUP BY node),
k AS (SELECT * FROM z ORDER BY round(total, 12) DESC, distance, id LIMIT 10)
SELECT id, round(total / (SELECT max(total) FROM k), 6) AS score, distance FROM k""",
    graph=True,
)
def graph_related(spark, sf_dir):
    return traverse.related(graph(spark, sf_dir), SEEDS, top_k=10, max_hops=2).withColumn("score", F.round("score", 6))


PATH_SQL = """, p AS (SELECT 'S1' AS node, ['S1'] AS nodes, []::VARCHAR[] AS edges, 0 AS n
  UNION ALL SELECT dst, list_append(nodes, dst), list_append(edges, a.id), n + 1 FROM p JOIN a ON node = src WHERE n < 3 AND node <> 'S2' AND NOT list_contains(nodes, dst)),
b AS (SELECT * FROM p WHERE node = 'S2' AND n = (SELECT min(n) FROM p WHERE node = 'S2'))
SELECT n AS length, round(coalesce((SELECT sum(ln(1 + degree)) FROM g WHERE list_contains(nodes[2:-2], g.id)), 0), 9) AS hub_score, array_to_string(nodes, ',') AS nodes, array_to_string(edges, ',') AS edges
FROM b ORDER BY 1, 2, 4 LIMIT 5"""


def _paths(found: DataFrame) -> DataFrame:
    return found.select("length", "hub_score", F.array_join("nodes", ",").alias("nodes"), F.array_join("edges", ",").alias("edges"))


@query(PATH_SQL, graph=True)
def graph_shortest_paths(spark, sf_dir):
    return _paths(traverse.shortest_paths(graph(spark, sf_dir), "S1", "S2", max_hops=4, max_paths=5))


@query("SELECT id, 'outgoing' AS direction, type, count(*) AS n FROM (SELECT from_id AS id, type FROM r) GROUP BY ALL UNION ALL SELECT id, 'incoming', type, count(*) FROM (SELECT to_id AS id, type FROM r) GROUP BY ALL", graph=True)
def graph_edge_counts(spark, sf_dir):
    return traverse.edge_counts(relations(spark, sf_dir))


@query("SELECT id, type, from_id, to_id FROM r WHERE from_id = 'P7' OR to_id = 'P7'", graph=True)
def graph_entity_relations(spark, sf_dir):
    return traverse.entity_relations(graph(spark, sf_dir), "P7")


def _apart(sql: str) -> str:
    """expand_sql or other SQL over the graph whose nations and regions are a namespace of their own."""
    return f", ns AS (SELECT id, CASE WHEN type IN ('nation', 'region') THEN 'places' ELSE 'default' END AS ns FROM e){sql}"


@query(
    _apart(", o AS (SELECT a.*, y.ns AS dns FROM a JOIN ns y ON y.id = dst), k AS (SELECT DISTINCT dst AS id FROM o JOIN ns x ON x.id = src WHERE src IN ('C1', 'S1') AND dns = 'default')")
    + " SELECT id, 0 AS hop FROM e WHERE id IN ('C1', 'S1') UNION ALL SELECT id, 1 FROM k WHERE id NOT IN ('C1', 'S1')",
    graph=True,
)
def graph_namespace_neighbours(spark, sf_dir):
    """A hop that stays in its namespace: the nations of a customer and a supplier lie in another one."""
    return traverse.expand(graph(spark, sf_dir, "places"), ["C1", "S1", "N1"], hops=1, max_nodes=5000).nodes


@query(_apart(", o AS (SELECT a.*, y.ns AS dns FROM a JOIN ns y ON y.id = dst) SELECT DISTINCT dst AS id, 1 AS hop FROM o WHERE src = 'N1' AND dns = 'places' UNION ALL SELECT 'N1', 0"), graph=True)
def graph_namespace_places(spark, sf_dir):
    return traverse.expand(graph(spark, sf_dir, "places"), ["N1", "C1"], hops=1, max_nodes=5000, namespace_id="places").nodes


@query(_apart(" SELECT src AS id, CASE WHEN r.from_id = src THEN 'outgoing' ELSE 'incoming' END AS direction, a.type, count(*) AS n FROM a JOIN r ON r.id = a.id JOIN ns y ON y.id = dst WHERE src IN ('S1', 'C1') AND y.ns = 'default' GROUP BY ALL"), graph=True)
def graph_entity_counts(spark, sf_dir):
    return traverse.entity_counts(graph(spark, sf_dir, "places"), ["S1", "C1", "N1"])


@query(_apart(" SELECT z.id, count(*) AS degree FROM (SELECT unnest([from_id, to_id]) AS id FROM r JOIN ns x ON x.id = from_id JOIN ns y ON y.id = to_id WHERE x.ns = 'default' AND y.ns = 'default') z GROUP BY 1"), graph=True)
def graph_health_degree(spark, sf_dir):
    nodes = entities(spark, sf_dir).withColumn("namespace_id", F.when(F.col("type").isin("nation", "region"), "places").otherwise("default"))
    return traverse.degrees(relations(spark, sf_dir), nodes)


@query("SELECT id, left(name, 200) AS name, left(type, 64) AS type, left(description, 2000) AS description FROM e", graph=True)
def projected_nodes(spark, sf_dir):
    rows = entities(spark, sf_dir).withColumn("aliases", F.lit(None).cast("array<string>")).withColumn("source_refs", F.lit(None).cast(identity.SOURCE_REFS))
    return projections.nodes(rows).select("id", "name", "type", "description")


@query("SELECT id, from_id, to_id, type, 'star' AS source FROM r", graph=True)
def projected_edges(spark, sf_dir):
    rows = projections.edges(relations(spark, sf_dir).withColumn("source_paths", F.array(F.lit("star"))))
    return rows.select("id", "from_id", "to_id", "type", F.element_at("source_refs", 1)["source_path"].alias("source"))


@query("SELECT id, name, type FROM e WHERE type IN ('supplier', 'nation') ORDER BY id LIMIT 25 OFFSET 10", graph=True)
def graph_enumerate(spark, sf_dir):
    return traverse.page(entities(spark, sf_dir), types=["supplier", "nation"], offset=10, limit=25)[1].select("id", "name", "type")


# --- counts and health --------------------------------------------------------------------------------------------


@query("SELECT type, count(*) AS n, (SELECT string_agg(name, ';' ORDER BY id DESC) FROM (SELECT id, name FROM e x WHERE x.type = e.type ORDER BY id DESC LIMIT 5)) AS examples FROM e GROUP BY type", graph=True)
def schema_entity_types(spark, sf_dir):
    return statistics.entity_types(entities(spark, sf_dir))


@query(
    """, c AS (SELECT r.type, x.type AS from_type, y.type AS to_type, count(*) AS n FROM r JOIN e x ON x.id = from_id JOIN e y ON y.id = to_id GROUP BY ALL)
SELECT type, from_type, to_type, n, sum(n) OVER (PARTITION BY type)::BIGINT AS total FROM c QUALIFY row_number() OVER (PARTITION BY type ORDER BY n DESC, from_type, to_type) <= 5""",
    graph=True,
)
def schema_relation_types(spark, sf_dir):
    return statistics.relation_types(entities(spark, sf_dir), relations(spark, sf_dir))


@query("SELECT CASE WHEN type IN ('nation', 'region') THEN 'places' ELSE 'default' END AS namespace_id, count(*) AS n FROM e GROUP BY 1", graph=True)
def count_by_namespace(spark, sf_dir):
    return graph(spark, sf_dir, "places").nodes.groupBy(F.col("ns").alias("namespace_id")).agg(F.count("*").alias("n"))


@query("SELECT type, count(*) AS n FROM e GROUP BY type", graph=True)
def health_type_counts(spark, sf_dir):
    return statistics.type_counts(entities(spark, sf_dir))


@query("SELECT lower(name) AS normalized_name, count(*) AS n, min(id) AS first_id FROM e GROUP BY 1 HAVING count(*) > 1", graph=True)
def health_duplicate_names(spark, sf_dir):
    return statistics.duplicate_names(entities(spark, sf_dir))


@query("SELECT id, type FROM e WHERE id NOT IN (SELECT id FROM g)", graph=True)
def health_isolated(spark, sf_dir):
    return statistics.isolated(entities(spark, sf_dir), relations(spark, sf_dir)).select("id", "type")


@query(
    """WITH p AS (SELECT p_name, p_size, p_brand || ' ' || p_type || ' ' || p_size AS alias, p_partkey FROM part),
s AS (SELECT p_name, count(DISTINCT alias) AS n, count(DISTINCT CASE WHEN p_size = 50 THEN p_partkey END) AS k, max(CASE WHEN p_size = 1 THEN 1 ELSE 0 END) AS v FROM p GROUP BY p_name),
f AS (SELECT p_name, n + k + v AS n, k AS c, v FROM s)
SELECT p_name AS id, p_name AS name, concat_ws(';', CASE WHEN n > 30 THEN 'alias_count=' || n || '>30' END, CASE WHEN c > 2 THEN 'distinct_identifiers=' || c END, CASE WHEN v > 0 THEN 'non_identifying_aliases=' || v END) AS reasons FROM f WHERE n > 30 OR c > 2 OR v > 0"""
)
def health_overmerged(spark, sf_dir):
    """Parts by name: their kinds are aliases, those of one size give codes, and one size an alias that names nobody."""
    kind = F.concat_ws(" ", "p_brand", "p_type", "p_size")
    code = F.when(F.col("p_size") == 50, F.concat(F.lit("PN"), (F.col("p_partkey") + 100000).cast("string")))
    vague = F.when(F.col("p_size") == 1, F.lit("the Company"))
    rows = table(spark, sf_dir, "part").select("p_name", F.explode(F.array_compact(F.array(kind, code, vague))).alias("alias")).groupBy("p_name").agg(F.collect_set("alias").alias("aliases"))
    return statistics.overmerged(rows.select(F.col("p_name").alias("id"), F.col("p_name").alias("name"), "aliases"))


# --- search -------------------------------------------------------------------------------------------------------

KEYWORDS = ["red widget", "economy", "gear"]
BM25_SQL = """, tok AS (SELECT id, list_filter(regexp_split_to_array(lower(name || ' ' || description), '[^\\pL\\pN]+'), lambda t: t <> '') AS w FROM e WHERE type = 'part'),
u AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM tok),
q AS (SELECT 'red widget' AS kw, unnest(['red', 'widget']) AS term UNION ALL SELECT 'economy', 'economy' UNION ALL SELECT 'gear', 'gear'),
ps AS (SELECT id, term, dl, count(*) AS tf FROM u GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM ps GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(w)) AS av FROM tok),
sc AS (SELECT id, kw AS matched_keyword, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av))), 6) AS score FROM ps JOIN q USING (term) JOIN dfs USING (term), st GROUP BY ALL)
SELECT id, matched_keyword, score FROM sc QUALIFY row_number() OVER (PARTITION BY matched_keyword ORDER BY score DESC, id) <= 10"""


def _parts(spark, sf_dir):
    return entities(spark, sf_dir).filter("type = 'part'").withColumn("search_text", F.concat_ws(" ", "name", "description"))


@query(BM25_SQL, graph=True)
def search_lexical(spark, sf_dir):
    return search.bm25(_parts(spark, sf_dir), KEYWORDS, 10)


DENSE_SQL = """SELECT q.vec_id AS query, d.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0{same} QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, d.vec_id) <= 5"""


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return rows.filter("id % 20 = 0").withColumnRenamed("id", "query"), rows


@query(DENSE_SQL.replace("{same}", ""))
def search_dense(spark, sf_dir):
    return search.dense(*_vectors(spark, sf_dir), 5)


@query(DENSE_SQL.replace("{same}", " AND q.label = d.label"))
def search_dense_typed(spark, sf_dir):
    return search.dense(*_vectors(spark, sf_dir), 5, same="label")


FUSED_SQL = (
    BM25_SQL.replace("SELECT id, matched_keyword, score FROM sc", ", b AS (SELECT id, matched_keyword, score FROM sc").replace("<= 10", "<= 20")
    + """),
kv AS (SELECT * FROM (VALUES ('red widget', 0), ('economy', 1), ('gear', 2)) AS t(matched_keyword, v)),
dn AS (SELECT 'P' || d.vec_id AS id, matched_keyword, round(list_cosine_similarity(d.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings d JOIN part ON p_partkey = d.vec_id, kv JOIN embeddings q ON q.vec_id = v
  QUALIFY row_number() OVER (PARTITION BY matched_keyword ORDER BY score DESC, 'P' || d.vec_id) <= 20),
rk AS (SELECT *, 'lexical' AS list, row_number() OVER (PARTITION BY matched_keyword ORDER BY score DESC, id) AS r FROM b UNION ALL SELECT id, matched_keyword, greatest(0.0::DOUBLE, score), 'dense', row_number() OVER (PARTITION BY matched_keyword ORDER BY greatest(0.0::DOUBLE, score) DESC, id) FROM dn),
bk AS (SELECT id, matched_keyword, sum(1.0::DOUBLE / (60 + r)) AS part, coalesce(max(CASE WHEN list = 'lexical' THEN score END), 0) AS lexical, coalesce(max(CASE WHEN list = 'dense' THEN score END), 0) AS dense FROM rk GROUP BY ALL),
nd AS (SELECT id, sum(part) AS total FROM bk GROUP BY id),
bs AS (SELECT * FROM bk JOIN kv USING (matched_keyword) QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(part, 12) DESC, round(lexical + dense, 6) DESC, v) = 1),
ok AS (SELECT nd.id, bs.matched_keyword, total, lexical, dense FROM nd JOIN bs USING (id) JOIN part ON 'P' || p_partkey = nd.id WHERE p_size > 10)
SELECT id, matched_keyword, round(total / (SELECT max(total) FROM ok), 6) AS score, lexical, dense, (SELECT count(*) FROM ok) AS total FROM ok ORDER BY score DESC, id LIMIT 10 OFFSET 3"""
)


@query(FUSED_SQL, graph=True)
def search_find_entities(spark, sf_dir):
    """Lexical and dense hits fused, then a type, a total and a page: vectors of the table stand for those of parts and keywords."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    kinds = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.when(F.col("p_size") > 10, "large").otherwise("small").alias("type"))
    parts = _parts(spark, sf_dir).drop("type").join(kinds, "id")
    held = vectors.select(F.concat(F.lit("P"), "vec_id").alias("id"), "vector").join(kinds.select("id"), "id", "left_semi")
    asked = [r["vector"] for r in vectors.filter(F.col("vec_id") < len(KEYWORDS)).orderBy("vec_id").collect()]
    total, found = search.find_entities(parts, KEYWORDS, held, asked, types=["large"], limit=10, offset=3)
    return found.withColumn("total", F.lit(total).cast("bigint"))


@query("SELECT q.vec_id AS query, d.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0 AND d.label IN (1, 2) QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, d.vec_id) <= 8")
def search_restricted(spark, sf_dir):
    """Dense search within given sources only (here: two labels), for the whole query set."""
    queries, rows = _vectors(spark, sf_dir)
    return search.dense(queries, rows.filter(F.col("label").isin(1, 2)), 8)


CHUNK_KEYWORDS = [(1, "red widget"), (1, "gear"), (2, "economy"), (2, "gear"), (3, "")]
KNOWN_SQL = BM25_SQL.replace("SELECT id, matched_keyword, score FROM sc", ", b AS (SELECT id, matched_keyword, score FROM sc") + """),
n AS (SELECT * FROM (VALUES (1, 'red widget'), (1, 'gear'), (2, 'economy'), (2, 'gear')) AS t(chunk, matched_keyword))
SELECT chunk, id, max(score) AS score FROM n JOIN b USING (matched_keyword) GROUP BY chunk, id QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY max(score) DESC, id) <= 10"""


@query(KNOWN_SQL, graph=True)
def context_known_entities(spark, sf_dir):
    """Entities that the keywords of three chunks find."""
    return context.known_entities(spark.createDataFrame(CHUNK_KEYWORDS, "chunk int, keyword string"), _parts(spark, sf_dir))


SOURCES_SQL = """WITH p AS (SELECT source AS source_path, 0 AS part, doc_id AS position FROM documents WHERE lang = 'de' AND doc_id % 3 = 0
  UNION ALL SELECT source, 1, doc_id FROM documents WHERE lang = 'fr' UNION ALL SELECT source, 2, doc_id FROM documents)
SELECT source_path, arg_min(part, part * 10000000000 + position) AS part, arg_min(position, part * 10000000000 + position) AS position FROM p WHERE source_path IS NOT NULL GROUP BY source_path"""


@query(SOURCES_SQL)
def context_source_paths(spark, sf_dir):
    """Sources of nodes, then edges, then paths, by first mention; documents of some languages stand for them."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_path"), F.col("doc_id").alias("position"), "lang")
    return context.source_paths(docs.filter("lang = 'de' and position % 3 = 0"), docs.filter("lang = 'fr'"), docs)


@query("SELECT q.vec_id AS query, d.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS similarity, 'sources' AS reason FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0 AND d.label = 1 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, d.vec_id) <= 8 + 4")
def context_guided_chunks(spark, sf_dir):
    """Chunks of one source (a label, as a folder's file) near each query vector."""
    queries, rows = _vectors(spark, sf_dir)
    return context.guided_chunks(queries, rows.withColumn("source_path", F.concat(F.lit("corpus/"), F.col("label").cast("string"), F.lit(".md"))), ["1.md"])


@query(
    f""", {expand_sql(['O1', 'O2'], 2, 60)},
nn AS (SELECT v2.id, name, type, description, count(*) OVER (PARTITION BY name) AS n FROM v2 JOIN e USING (id)),
dn AS (SELECT *, CASE WHEN n > 1 THEN name || ' [id=' || id[:6] || ']' ELSE name END AS display FROM nn)
SELECT 'nodes' AS section, id, '- ' || display || ' (type: ' || type || ', aliases: [])' || CASE WHEN description <> '' THEN chr(10) || '  설명: ' || description ELSE '' END || chr(10) || '  출처: (없음)' AS block FROM dn
UNION ALL SELECT 'edges', s.id, '- ' || a.display || ' --' || s.type || '--> ' || b.display || chr(10) || '  출처: star:0' FROM s JOIN dn a ON a.id = from_id JOIN dn b ON b.id = to_id""",
    graph=True,
)
def context_graph_blocks(spark, sf_dir):
    """The nodes and relations of a bounded search as text."""
    found = traverse.expand(graph(spark, sf_dir), ["O1", "O2"], hops=2, max_nodes=60)
    refs = "array<struct<source_path:string,chunk_index:int>>"
    nodes = entities(spark, sf_dir).join(F.broadcast(found.nodes), "id").withColumn("aliases", F.array().cast("array<string>")).withColumn("source_refs", F.lit(None).cast(refs))
    return context.graph_blocks(nodes, found.edges.withColumn("source_refs", F.array(F.struct(F.lit("star").alias("source_path"), F.lit(0).alias("chunk_index")))))


# --- text ---------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN lower(p_name || ' ' || p_brand) WHEN 1 THEN nfc_normalize(lower('e' || chr(769) || 'a' || chr(776) || ' ' || p_name)) WHEN 2 THEN lower(p_name) || ' ' || lower(p_brand) ELSE lower(p_brand) || '-' || lower(p_name) END AS normalized FROM part""")
def text_normalize(spark, sf_dir):
    """Names with spaces and stops around them, decomposed accents, Unicode spaces, and quotation marks at the ends."""
    forms = [
        F.concat(F.lit("  "), "p_name", F.lit("  "), "p_brand", F.lit(". ")),
        F.concat(F.lit("E\u0301A\u0308 "), "p_name"),
        F.concat("p_name", F.lit("\u00a0\u3000\t"), "p_brand"),
        F.concat(F.lit("\u201c\u2018"), "p_brand", F.lit("-"), "p_name", F.lit("\u2019\u201d·")),
    ]
    name = forms[3]
    for k in (2, 1, 0):
        name = F.when(F.col("p_partkey") % 4 == k, forms[k]).otherwise(name)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.normalize(name).alias("normalized"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey >= 100 THEN 'PN-' || p_partkey ELSE '' END AS codes FROM part")
def text_identifiers(spark, sf_dir):
    name = F.concat("p_name", F.lit(" (PN-"), F.col("p_partkey").cast("string"), F.lit("), No 10-K"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.identifier_aliases(name), ",").alias("codes"))


@query()
def text_keywords(spark, sf_dir):
    """Six keywords of each document. Word bounds are those of Unicode, which DuckDB's expressions lack."""
    return text.top_keywords(table(spark, sf_dir, "documents"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def file_hashes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("content", F.col("text").cast("binary")).select("doc_id", files.file_hash().alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def _chunk_query(name, how, **options):
    def run(spark, sf_dir):
        return chunking.chunks(table(spark, sf_dir, "documents"), how, **options)

    run.__name__ = name
    return query()(run)


_chunk_query("chunk_extraction", chunking.chunk_text)
_chunk_query("chunk_retrieval", chunking.chunk_for_retrieval)
_chunk_query("chunk_rag", chunking.chunk_for_rag)

#: Texts whose chunks can be told without a chunker: paragraphs of ten sentences of a hundred tokens each, as many as the
#: nation's number and one. What a chunk is made of and what comes before it, by its place.
FORM = {"sentence": "'x' || repeat(' x', 97) || ' y.'", "paragraph": "s || repeat(' ' || s, 9)"}
FORMS_SQL = f"""WITH s AS (SELECT n_nationkey AS doc_id, n_nationkey + 1 AS k, {FORM['sentence']} AS s FROM nation), p AS (SELECT *, {FORM['paragraph']} AS p FROM s),
c AS (SELECT *, unnest(range(total)) AS chunk_index FROM (SELECT *, {{total}} AS total FROM p))
SELECT doc_id, chunk_index::INT AS chunk_index, total::INT AS total_chunks, CASE WHEN chunk_index > 0 THEN {{tail}} || chr(10) || chr(10) ELSE '' END || {{piece}} AS text FROM c"""
GAP = "chr(10) || chr(10)"


def _form_query(name, how, total, tail, piece):
    def run(spark, sf_dir):
        sentence = "x" + " x" * 97 + " y."
        paragraph = " ".join([sentence] * 10)
        docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.array_join(F.array_repeat(F.lit(paragraph), F.col("n_nationkey") + 1), "\n\n").alias("text"))
        return chunking.chunks(docs, how)

    run.__name__ = name
    return query(FORMS_SQL.replace("{total}", total).replace("{tail}", tail).replace("{piece}", piece))(run)


# Four paragraphs are 4,000 tokens, a fifth of which goes before the next piece; one and a half are 1,500, before which go
# two sentences; eight sentences are 800, before which go the last hundred tokens with the blank line before them.
_form_query("chunk_extraction_forms", chunking.chunk_text, "ceil(k / 4)::INT", "repeat(' ' || s, 8)", f"p || repeat({GAP} || p, least(4, k - 4 * chunk_index)::INT - 1)")
_form_query("chunk_retrieval_forms", chunking.chunk_for_retrieval, "k", "s || ' ' || s", "p")
_form_query("chunk_rag_forms", chunking.chunk_for_rag, "ceil(k * 10 / 8)::INT", f"{GAP} || s", f"s || repeat({GAP} || s, least(8, k * 10 - 8 * chunk_index)::INT - 1)")


# --- identity and changes -----------------------------------------------------------------------------------------


def _part_mentions(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.lit("default").alias("namespace_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("description"),
        F.col("p_brand").alias("source_path"), F.lit(0).alias("chunk_index"), F.col("p_partkey").alias("seq"), F.array(F.concat_ws(" ", "p_name", "p_brand")).alias("aliases"),
    )


@query(
    """SELECT 'default' AS namespace_id, p_type AS type, lower(p_name) AS normalized_name, arg_min(p_name, p_partkey) AS name,
  first(p_brand ORDER BY length(p_brand) DESC, p_partkey) AS description, count(DISTINCT p_brand) AS sources, min(p_partkey) AS created_seq, count(*) AS mentions FROM part GROUP BY p_type, p_name"""
)
def identity_merge(spark, sf_dir):
    return identity.merge_exact(_part_mentions(spark, sf_dir)).withColumn("sources", F.size("source_paths").cast("long")).drop("source_paths")


@query("SELECT p_partkey AS seq, min(p_partkey) OVER (PARTITION BY p_type, p_name) AS entity_seq, CASE WHEN p_partkey = min(p_partkey) OVER (PARTITION BY p_type, p_name) THEN 4 ELSE 1 END AS step FROM part")
def identity_match(spark, sf_dir):
    """Sequential matching at the thresholds in use; no two different names of the parts are near enough to be merged."""
    return identity.match_sequential(_part_mentions(spark, sf_dir)).select("seq", "entity_seq", "step")


STORED_SQL = """WITH t AS (SELECT p_partkey AS seq, p_type, p_name, 'B|' || p_type || '|' || p_brand AS own, 'B|' || p_type || '|' || min(p_brand) OVER (PARTITION BY p_type) AS wanted, p_size = 1 AS named FROM part),
f AS (SELECT *, min(CASE WHEN named THEN seq END) OVER w AS since FROM t WINDOW w AS (PARTITION BY p_type, p_name)),
g AS (SELECT *, seq > since AS later FROM f)
SELECT seq, CASE WHEN named THEN wanted WHEN later THEN wanted ELSE own END AS entity_id, CASE WHEN named THEN 0 WHEN later THEN 1 ELSE 2 END AS step FROM g"""


@query(STORED_SQL)
def identity_stored(spark, sf_dir):
    """Matching against stored entities: brands of each type are stored, parts name them as an alias, and those of one size by id.

    A part that is merged by id leaves its name behind, which later parts of that name find.
    """
    parts = table(spark, sf_dir, "part")
    stored = parts.groupBy("p_type", "p_brand").agg(F.lit("default").alias("namespace_id")).select(F.concat_ws("|", F.lit("B"), "p_type", "p_brand").alias("id"), F.col("p_brand").alias("name"), F.col("p_type").alias("type"), "namespace_id")
    first = parts.groupBy("p_type").agg(F.min("p_brand").alias("first"))
    mentions = _part_mentions(spark, sf_dir).join(first.withColumnRenamed("p_type", "type"), "type").withColumn("aliases", F.array("description"))
    sizes = parts.select(F.col("p_partkey").alias("seq"), "p_size")
    mentions = mentions.join(sizes, "seq").withColumn("matched_existing_id", F.when(F.col("p_size") == 1, F.concat_ws("|", F.lit("B"), "type", "first")))
    return identity.resolve(mentions, stored).select("seq", "entity_id", "step")


@query(
    """WITH t AS (SELECT 'P' || p_partkey AS id, 'B' || p_type || p_brand AS target, p_partkey AS seq, p_name, p_size FROM part),
a AS (SELECT target, lower(p_name) AS k, arg_min(p_name, seq) AS alias, min(seq) AS seq FROM t WHERE lower(p_name) <> 'blocked' GROUP BY ALL)
SELECT target AS id, (SELECT string_agg(alias, ';' ORDER BY seq) FROM a WHERE a.target = t.target) AS aliases, count(DISTINCT 'f' || p_size) AS sources, first(p_name ORDER BY length(p_name) DESC, seq) AS description FROM t GROUP BY target"""
)
def identity_merged(spark, sf_dir):
    """Entities after a merge: distinct aliases in order, the longest description, each source once."""
    parts = table(spark, sf_dir, "part")
    mentions = parts.select(F.lit("default").alias("namespace_id"), F.col("p_partkey").alias("seq"), F.col("p_brand").alias("name"), F.col("p_type").alias("type"), F.array("p_name").alias("aliases"), F.col("p_name").alias("description"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("source_path"), F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"))
    found = parts.select(F.col("p_partkey").alias("seq"), F.concat(F.lit("B"), "p_type", "p_brand").alias("entity_id"), F.lit(None).cast("bigint").alias("entity_seq"), F.lit(2).alias("step"))
    out = identity.merged(mentions, found)
    return out.select("id", F.array_join("aliases", ";").alias("aliases"), F.size("source_refs").cast("bigint").alias("sources"), "description")


@query("SELECT from_id, type, to_id, count(DISTINCT source_path) AS sources, count(*) AS mentions FROM m GROUP BY ALL", graph=True)
def relation_upsert(spark, sf_dir):
    return identity.upsert_relations(relation_rows(spark, sf_dir)).withColumn("sources", F.size("source_paths").cast("long")).drop("source_paths")


@query(
    """, p AS (SELECT p_partkey AS k, p_name, 'f' || p_size AS f, 'P' || p_partkey AS id FROM part),
x AS (SELECT f, p_name, arg_max(id, k) AS hit FROM p GROUP BY ALL),
n AS (SELECT lower(name) AS key, min(id) AS id FROM e WHERE type IN ('nation', 'region') GROUP BY 1 HAVING count(*) = 1),
q AS (SELECT p.*, CASE k % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'normalized' WHEN 2 THEN 'graph' END AS how, n_name FROM p JOIN nation ON n_nationkey = k % 25)
SELECT k AS end_id, CASE WHEN how IN ('exact', 'normalized') THEN hit WHEN how = 'graph' THEN n.id END AS entity_id, CASE WHEN how = 'graph' AND n.id IS NULL THEN NULL ELSE how END AS how
FROM q LEFT JOIN x USING (f, p_name) LEFT JOIN n ON n.key = lower(n_name)""",
    graph=True,
)
def endpoint_resolution(spark, sf_dir):
    """Ends by the exact name in their file, the normalised one there, a name that one entity of the graph has, or nothing."""
    parts = table(spark, sf_dir, "part").withColumn("file", F.concat(F.lit("f"), F.col("p_size").cast("string")))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("at"), "n_name")
    rows = parts.join(nations, F.col("at") == F.col("p_partkey") % 25)
    turn = F.col("p_partkey") % 4
    name = F.when(turn == 0, F.col("p_name")).when(turn == 1, F.concat(F.lit(" "), F.upper("p_name"), F.lit("."))).when(turn == 2, F.lower("n_name")).otherwise(F.concat(F.lit("nothing "), "p_name"))
    ends = rows.select(F.col("p_partkey").alias("end_id"), F.when(turn == 2, "elsewhere").otherwise(F.col("file")).alias("source_path"), name.alias("name"))
    in_file = parts.select(F.col("file").alias("source_path"), F.col("p_name").alias("name"), F.concat(F.lit("P"), "p_partkey").alias("entity_id"), F.col("p_partkey").alias("seq"))
    graph = entities(spark, sf_dir).filter(F.col("type").isin("nation", "region")).select(F.col("id").alias("entity_id"), "name")
    return identity.resolve_endpoints(ends, in_file, graph).select("end_id", "entity_id", "how")


@query(
    """WITH d AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'entity' AS kind, n_name AS a, 'nation' AS b, '' AS c, 1 AS sources FROM d UNION ALL SELECT 'entity', r_name, 'region', '', count(*) FROM d GROUP BY r_name
UNION ALL SELECT 'relation', n_name, 'in', r_name, 1 FROM d UNION ALL SELECT 'unresolved', n_name, 'near', 'nowhere', 1 FROM d"""
)
def ingest_plan(spark, sf_dir):
    """What a batch would change: a text for each nation, with its region, a relation, and one whose end is nowhere."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    said = F.format_string("노드: %s | nation\n노드: %s | region\n관계: %s | in | %s\n관계: %s | near | nowhere", "n_name", "r_name", "n_name", "r_name", "n_name")
    sources = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("default").alias("namespace_id"), F.col("n_name").alias("source_path"), said.alias("text"), F.col("n_nationkey").cast("bigint").alias("seq"))
    # Names that differ by a digit stay apart in more dimensions.
    change = ingest.plan(sources, ingest.empty(spark), embed=partial(identity.trigram_embedding, dimension=1024))
    names = change.entities.select("id", "name")
    rows = change.entities.select(F.lit("entity").alias("kind"), F.col("name").alias("a"), F.col("type").alias("b"), F.lit("").alias("c"), F.size("source_refs").cast("bigint").alias("sources"))
    ends = change.relations.join(names.select(F.col("id").alias("from_id"), F.col("name").alias("a")), "from_id").join(names.select(F.col("id").alias("to_id"), F.col("name").alias("c")), "to_id")
    rows = rows.unionByName(ends.select(F.lit("relation").alias("kind"), "a", F.col("type").alias("b"), "c", F.size("source_paths").cast("bigint").alias("sources")))
    return rows.unionByName(change.unresolved.select(F.lit("unresolved").alias("kind"), F.col("from_name").alias("a"), F.col("type").alias("b"), F.col("to_name").alias("c"), F.lit(1).cast("bigint").alias("sources")))


def _runs(spark, sf_dir):
    """Every document is a file; events are runs over them."""
    files = table(spark, sf_dir, "documents").select(F.lit("default").alias("namespace_id"), F.concat(F.lit("f"), F.pmod("doc_id", F.lit(200))).alias("source_path"), F.sha2(F.col("text").cast("binary"), 256).alias("source_hash"), F.lit("p2").alias("extractor_version"), "doc_id")
    runs = files.filter("doc_id % 3 <> 0").withColumn("status", F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("succeeded")).withColumn("run_id", F.col("doc_id")).withColumn("completed_at", F.col("doc_id") % 50)
    return files, runs


RUNS_SQL = """f AS (SELECT 'f' || (doc_id % 200) AS source_path, sha256(text) AS source_hash, doc_id FROM documents),
u AS (SELECT *, doc_id % 50 AS completed_at FROM f WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 0)"""


@query(f"WITH {RUNS_SQL} SELECT doc_id, source_path FROM f WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.source_path = f.source_path AND u.source_hash = f.source_hash)")
def ingest_unseen(spark, sf_dir):
    files, runs = _runs(spark, sf_dir)
    return changes.unseen(files, runs).select("doc_id", "source_path")


@query(f"WITH {RUNS_SQL} SELECT source_path, max_by(doc_id, completed_at * 1000000000 + doc_id) AS run_id, max(completed_at) AS completed_at FROM u GROUP BY source_path")
def ingest_latest_runs(spark, sf_dir):
    return changes.latest_runs(_runs(spark, sf_dir)[1]).select("source_path", "run_id", "completed_at")


@query("""SELECT 'P' || l_partkey AS id, CASE WHEN count(*) FILTER (WHERE q = 1) = 0 THEN 'keep' WHEN count(*) FILTER (WHERE q <> 1) = 0 THEN 'delete' ELSE 'trim' END AS op,
  count(*) FILTER (WHERE q <> 1) AS sources FROM (SELECT DISTINCT l_partkey, strftime(l_shipdate, '%Y-%m') AS month, month(l_shipdate) AS q FROM lineitem) GROUP BY l_partkey""")
def ingest_diff(spark, sf_dir):
    """Parts by ship month; every January is re-ingested without them."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("id"), F.date_format("l_shipdate", "yyyy-MM").alias("source_path"))
    parts = rows.groupBy("id").agg(F.collect_set("source_path").alias("source_paths"))
    lost = rows.filter(F.col("source_path").endswith("-01")).distinct()
    return changes.trim(parts, lost).select("id", "op", F.size("source_paths").cast("long").alias("sources"))


# --- evaluation ---------------------------------------------------------------------------------------------------

ANSWERS_SQL = """WITH w AS (SELECT event_type AS strategy, user_id % 50 AS question_id, event_id % 3 AS run, event_id AS seq, value AS latency,
  (props->>'k')::BIGINT AS tokens, CASE WHEN event_id % 4 <> 0 THEN 1 ELSE 0 END AS correct, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 3 END AS quality,
  event_id % 5 AS faithful, chr((97 + (event_id * 7) % 5)::INT) AS choice FROM events)"""


def _answers(spark, sf_dir):
    """Events as answers: question by user, strategy by type."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_type").alias("strategy"), (F.col("user_id") % 50).alias("question_id"), (F.col("event_id") % 3).alias("run"), F.col("event_id").alias("seq"), F.col("value").alias("latency"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"), (F.col("event_id") % 4 != 0).cast("int").alias("correct"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 3).alias("quality"), (F.col("event_id") % 5).alias("faithful"), F.char(97 + (F.col("event_id") * 7) % 5).alias("choice"),
    )


METRICS_SQL = f"""{ANSWERS_SQL},
q AS (SELECT strategy, question_id, avg(correct) AS correct, coalesce(quantile_disc(quality, 0.5), 0) AS quality, median(tokens) AS tokens, median(latency) AS latency FROM w GROUP BY ALL),
x AS (SELECT strategy, round(avg(correct), 6) AS accuracy, round(median(quality)::DOUBLE, 6) AS quality_median, round(median(tokens)::DOUBLE, 6) AS tokens_median, round(median(latency)::DOUBLE, 6) AS latency_median FROM q GROUP BY strategy),
y AS (SELECT strategy, count(*) AS response_count, quantile_disc(tokens, 0.95)::DOUBLE AS tokens_p95, round(sum(tokens * 2.5::DOUBLE / 1000000), 6) AS cost FROM w GROUP BY strategy)"""


def _metrics(spark, sf_dir):
    return evaluation.aggregate_columns(_answers(spark, sf_dir).withColumn("price", F.col("tokens") * 2.5 / 1e6)).withColumn("tokens_p95", F.col("tokens_p95").cast("double"))


@query("SELECT event_id::VARCHAR AS question_id, event_id % 3 AS run_index, (props->>'k')::BIGINT AS input_tokens, 7 AS output_tokens, event_id % 5 AS embedding_tokens, (props->>'k')::BIGINT + 7 + event_id % 5 AS total_tokens, 0 AS latency_ms, event_type AS model, 'b' AS choice, '' AS reasoning, NULL AS parse_error FROM events")
def eval_canonical_metrics(spark, sf_dir):
    """Stored answers of the graph's shape, read from JSON."""
    said = F.struct(F.col("event_type").alias("model"), F.struct(F.lit(" B ").alias("choice")).alias("parsed"))
    body = F.struct(F.col("event_id").alias("question_id"), (F.col("event_id") % 3).alias("run_index"), F.get_json_object("props", "$.k").cast("bigint").alias("total_input_tokens"), F.lit(7).alias("total_output_tokens"), (F.col("event_id") % 5).alias("embedding_tokens_estimated"), said.alias("answer_generation"))
    return evaluation.canonical_metrics(table(spark, sf_dir, "events").select(F.to_json(body).alias("body")), "graph")


@query(f"{METRICS_SQL} SELECT * FROM x JOIN y USING (strategy)")
def eval_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@query(f"{METRICS_SQL}, z AS (SELECT max(accuracy) FILTER (WHERE strategy = 'view') AS fa, max(accuracy) FILTER (WHERE strategy = 'click') AS ga, max(tokens_median) FILTER (WHERE strategy = 'click') AS gt, max(tokens_median) FILTER (WHERE strategy = 'error') AS rt, max(latency_median) FILTER (WHERE strategy = 'click') AS gl, max(latency_median) FILTER (WHERE strategy = 'error') AS rl FROM x) SELECT ga + 1e-9 >= fa AS accuracy_ok, gt <= rt + 1e-9 AS tokens_ok, gl <= rl + 1e-9 AS latency_ok, ga + 1e-9 >= fa AND gt <= rt + 1e-9 AND gl <= rl + 1e-9 AS passed FROM z")
def eval_pareto(spark, sf_dir):
    return evaluation.pareto(_metrics(spark, sf_dir), "view", "error", "click")


@query(f"{ANSWERS_SQL} SELECT strategy, question_id, choice FROM (SELECT strategy, question_id, choice, count(*) AS n, min(seq) AS f FROM w GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY strategy, question_id ORDER BY n DESC, f) = 1")
def eval_majority(spark, sf_dir):
    return evaluation.majority(_answers(spark, sf_dir))


@query(f"{ANSWERS_SQL}, p AS (SELECT DISTINCT strategy, question_id FROM w WHERE correct = 0 AND seq % 7 = question_id % 7), a AS (SELECT question_id FROM p WHERE strategy = 'view'), b AS (SELECT question_id FROM p WHERE strategy = 'click') SELECT 'only_a' AS part, count(*) AS n FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'only_b', count(*) FROM (FROM b EXCEPT FROM a) UNION ALL SELECT 'both', count(*) FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'either', count(*) FROM (FROM a UNION FROM b)")
def eval_error_sets(spark, sf_dir):
    return evaluation.error_sets(_answers(spark, sf_dir).filter("correct = 0 and seq % 7 = question_id % 7"), "view", "click")


@query(f"{ANSWERS_SQL} SELECT seq, CASE WHEN correct = 1 THEN NULL WHEN seq % 8 = 0 THEN 'parse_error' WHEN choice = 'e' THEN 'unknown_choice' ELSE 'wrong_choice' END AS failure FROM w")
def eval_failures(spark, sf_dir):
    said = F.when(F.col("choice") == "e", "Insufficient information to tell").otherwise("x")
    return _answers(spark, sf_dir).select("seq", evaluation.failure(F.col("correct"), F.when(F.col("seq") % 8 == 0, "bad"), said).alias("failure"))


@query(f"{ANSWERS_SQL} SELECT strategy, question_id, run, seq, coalesce(CASE WHEN seq % 10 = 0 THEN 2 END, quality) AS quality FROM w")
def eval_overrides(spark, sf_dir):
    rows = _answers(spark, sf_dir)
    lines = rows.filter("seq % 10 = 0").select("seq", F.explode(F.array(F.struct(F.lit(1).alias("line"), F.lit(0).alias("q")), F.struct(F.lit(2).alias("line"), F.lit(2).alias("q")))).alias("x"))
    overrides = lines.select("seq", F.col("x.line").alias("line"), F.col("x.q").cast("long").alias("human_quality"))
    return evaluation.with_overrides(rows, overrides, ["seq"]).select("strategy", "question_id", "run", "seq", "quality")


@query(f"{ANSWERS_SQL}, t AS (SELECT strategy, question_id, run, seq, concat_ws('+', CASE WHEN correct = 1 AND quality = 0 THEN 'lucky_correct' END, CASE WHEN faithful = 0 THEN 'hallucination_suspect' END) AS triggers FROM w) SELECT strategy, question_id, run, triggers FROM t WHERE triggers <> ''")
def eval_spot_checks(spark, sf_dir):
    return evaluation.spot_checks(_answers(spark, sf_dir))


@query("SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(count(*) / sum(count(*)) OVER (), 6) > 0.6 AS skewed FROM documents GROUP BY lang")
def eval_skew(spark, sf_dir):
    return evaluation.skewed(table(spark, sf_dir, "documents"), "lang")


@query("SELECT m.model, count(*) AS units, sum(n_chars // 4)::BIGINT AS tokens, round((sum(n_chars // 4) * m.i + count(*) * 200 * m.o) / 1000000, 6) AS usd FROM documents, (VALUES ('small', 0.5::DOUBLE, 2.0::DOUBLE), ('large', 2.5::DOUBLE, 10.0::DOUBLE)) m(model, i, o) GROUP BY m.model, m.i, m.o")
def eval_dry_run(spark, sf_dir):
    units = table(spark, sf_dir, "documents").select(F.expr("n_chars div 4").alias("tokens"))
    return evaluation.dry_run_cost(units, spark.createDataFrame([("small", 0.5, 2.0), ("large", 2.5, 10.0)], "model string, input double, output double"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes nearest to three suppliers."""
    return graph_related(spark, sf_dir)
