"""Queries over routed retrieval; benchmark items stand for questions, documents for concepts and raw chunks, their sources for bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import KEYWORD_STOPWORDS, keyword_terms, words_between
from tessera.operators import retrieval, routed
from tessera.plans.base import query, table, view, view_sql

_QUESTION = {
    "query_id": "item_id", "needs_graph": "item_id % 4 = 1", "clarified": "item_id % 6 = 5",
    "route": "CASE item_id % 8 WHEN 0 THEN 'rag_only' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'hybrid' ELSE 'okf_only' END",
    "scope": "CASE item_id % 3 WHEN 0 THEN ARRAY_OF('b0') WHEN 1 THEN ARRAY_OF('b2', 'b0', 'b1') ELSE ARRAY_OF('b3', 'b1') END",
}
_FOUND = {"query_id": "doc_id % 40", "bundle_id": "'b' || (CAST(floor(doc_id / 40) AS BIGINT) % 4)", "doc_id": "doc_id"}
_PLACE = "row_number() OVER (PARTITION BY query_id, bundle_id ORDER BY doc_id)"
_SQL = f"""{view_sql("q", _QUESTION, "benchmark")}, {view_sql("f", _FOUND, "documents")},
ap AS (SELECT *, 'c' || doc_id AS path, CASE doc_id % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'automated' END AS provenance, {_PLACE} AS place FROM f WHERE doc_id % 7 < 3 AND query_id % 5 <> 2 QUALIFY place <= 4),
gr AS (SELECT *, 'c' || doc_id AS path, {_PLACE} AS place FROM f WHERE doc_id % 5 < 2 AND query_id % 3 <> 0),
gn AS (SELECT * FROM gr WHERE (query_id, bundle_id, path) NOT IN (SELECT query_id, bundle_id, path FROM ap)),
ra AS (SELECT *, {_PLACE} AS place, doc_id % 5 = 0 AS covered FROM f WHERE doc_id % 4 > 0 QUALIFY place <= 6),
cl AS (SELECT DISTINCT query_id, bundle_id FROM f WHERE query_id % 10 IN (2, 3) AND bundle_id IN ('b0', 'b3')),
s AS (SELECT query_id, route, needs_graph, clarified, len(scope) AS n, unnest(scope) AS bundle_id, generate_subscripts(scope, 1) AS rank FROM q WHERE route <> 'unsupported'),
x AS (SELECT s.*, route <> 'rag_only' AND EXISTS (SELECT 1 FROM ap WHERE ap.query_id = s.query_id AND ap.bundle_id = s.bundle_id) AS has, EXISTS (SELECT 1 FROM gn WHERE gn.query_id = s.query_id AND gn.bundle_id = s.bundle_id) AS leads,
  NOT clarified AND EXISTS (SELECT 1 FROM cl WHERE cl.query_id = s.query_id AND cl.bundle_id = s.bundle_id) AS could FROM s),
y AS (SELECT *, could AND (route = 'hybrid' OR (route = 'okf_only' AND NOT has)) AS asks, has AND NOT (could AND route = 'hybrid') AS ok FROM x),
z AS (SELECT *, bool_or(ok OR asks) OVER (PARTITION BY query_id) AS settled, ok AND route = 'okf_only' AND needs_graph AS graphed FROM y),
p AS (SELECT *, CASE WHEN route = 'rag_only' OR (route = 'hybrid' AND NOT asks) OR (graphed AND NOT leads) THEN 'first' WHEN route = 'okf_only' AND NOT settled THEN 'fallback' END AS phase FROM z),
e0 AS (SELECT p.query_id, p.bundle_id, p.route, p.rank, p.n, 'okf' AS source_type, path AS key, provenance, false AS covered, CASE WHEN graphed AND leads THEN 'graph' ELSE 'direct' END AS mode, 0 AS step, place FROM p JOIN ap USING (query_id, bundle_id) WHERE ok
  UNION ALL SELECT p.query_id, p.bundle_id, p.route, p.rank, p.n, 'okf', path, NULL, false, 'graph', 1, place FROM p JOIN gn USING (query_id, bundle_id) WHERE graphed),
e1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, bundle_id ORDER BY step, place) AS i FROM e0 QUALIFY i <= 4),
e AS (SELECT query_id, bundle_id, route, rank, n, source_type, key, CASE WHEN provenance = 'human' THEN 0 WHEN provenance = 'automated' THEN 1 ELSE 2 END AS trust, covered, mode, i FROM e1
  UNION ALL SELECT p.query_id, p.bundle_id, p.route, p.rank, p.n, 'rag', CAST(doc_id AS VARCHAR), 3, covered, NULL, 4 + place FROM p JOIN ra USING (query_id, bundle_id) WHERE phase IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY trust, rank, i) AS place FROM e
  WHERE n = 1 OR NOT (route = 'okf_only' AND source_type = 'rag' AND NOT covered AND query_id IN (SELECT query_id FROM e WHERE source_type = 'okf'))),
m AS (SELECT *, CASE WHEN n = 1 THEN row_number() OVER (PARTITION BY query_id ORDER BY i) ELSE row_number() OVER (PARTITION BY query_id ORDER BY source_type, trust, rank, i) END AS new_index
  FROM k WHERE n = 1 OR place <= CASE WHEN source_type = 'okf' THEN 4 ELSE 6 END)"""


def _retrieved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = view(spark, sf_dir, _FOUND, "documents")
    i = F.col("doc_id")
    place = F.row_number().over(Window.partitionBy("query_id", "bundle_id").orderBy("doc_id"))
    path = F.concat(F.lit("c"), i)
    approved = found.filter("doc_id % 7 < 3 and query_id % 5 <> 2").select("query_id", "bundle_id", path.alias("path"), place.alias("place"), F.when(i % 3 == 0, "human").when(i % 3 == 1, "automated").alias("provenance"))
    graph = found.filter("doc_id % 5 < 2 and query_id % 3 <> 0").select("query_id", "bundle_id", path.alias("path"), place.alias("place"))
    asks = found.filter("query_id % 10 in (2, 3) and bundle_id in ('b0', 'b3')").select("query_id", "bundle_id").distinct()
    chunks = found.filter("doc_id % 4 > 0").select("query_id", "bundle_id", i.alias("chunk_id"), place.alias("place"), F.when(i % 5 == 0, 1).otherwise(0).alias("covered"))
    ranked = F.transform("scope", lambda b, n: F.struct(b.alias("bundle_id"), (n + 1).alias("rank")))
    questions = view(spark, sf_dir, _QUESTION, "benchmark").withColumn("bundles", ranked)
    return routed.routed_retrieval(questions, approved, asks, graph, lambda asked: chunks.join(asked, ["query_id", "bundle_id"], "left_semi"))


@query(f"WITH {_SQL} SELECT query_id, CAST(new_index AS INTEGER) AS new_index, bundle_id, source_type, key, mode FROM m")
def routed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of every question in order, over the bundles of its scope."""
    return _retrieved(spark, sf_dir)[0]


@query(
    f"""WITH {_SQL}, u AS (SELECT query_id, rank, unnest(list_filter([CASE WHEN route <> 'rag_only' THEN 'okf_retrieval' END, CASE WHEN graphed THEN 'okf_relation_traversal' END, CASE WHEN phase IS NOT NULL THEN 'rag_retrieval' END], lambda t: t IS NOT NULL)) AS tool FROM p),
v AS (SELECT query_id, tool, min(rank * 10 + CASE tool WHEN 'okf_retrieval' THEN 0 WHEN 'rag_retrieval' THEN 2 ELSE 1 END) AS first FROM u GROUP BY ALL),
t AS (SELECT query_id, string_agg(tool, ',' ORDER BY first) AS tools FROM v GROUP BY query_id),
g AS (SELECT query_id, count(*) AS n_bundles, bool_or(ok) AS any_ok, arg_min(CASE WHEN asks THEN bundle_id END, CASE WHEN asks THEN rank END) AS asker, coalesce(bool_or(phase = 'fallback'), false) AS fallback FROM p GROUP BY query_id),
c AS (SELECT query_id, count_if(source_type = 'okf') AS n_okf, count_if(source_type = 'rag') AS n_rag FROM m GROUP BY query_id)
SELECT q.query_id, route, coalesce(tools, '') AS tools, coalesce(n_okf, 0) > 0 AS approved_available, NOT coalesce(any_ok, false) AND coalesce(n_rag, 0) > 0 AS discovery_only,
  CASE WHEN coalesce(n_okf, 0) + coalesce(n_rag, 0) = 0 THEN asker END AS asks, CAST(coalesce(n_okf, 0) AS BIGINT) AS n_okf, CAST(coalesce(n_rag, 0) AS BIGINT) AS n_rag, coalesce(n_bundles, 0) AS n_bundles, coalesce(fallback, false) AS fallback
FROM q LEFT JOIN t USING (query_id) LEFT JOIN g USING (query_id) LEFT JOIN c USING (query_id)"""
)
def routed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools, labels and fallback of every question."""
    return _retrieved(spark, sf_dir)[1].withColumn("tools", F.array_join("tools", ","))


_ASKED = "vec_id % 100 = 0"


@query(
    f"""WITH d AS (SELECT doc_id, source, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3)) AS words FROM documents),
q AS (SELECT vec_id AS query_id, embedding AS v, list_sort(list_filter(words, lambda w: w NOT IN {tuple(KEYWORD_STOPWORDS)}))[1:5] AS terms FROM embeddings LEFT JOIN d ON doc_id = vec_id WHERE {_ASKED}),
kw AS (SELECT query_id, source AS bundle_id, doc_id, len(list_intersect(words, terms)) AS hits, row_number() OVER (PARTITION BY query_id, source ORDER BY hits DESC, doc_id) AS rank FROM q, d WHERE len(list_intersect(words, terms)) > 0 QUALIFY rank <= 10),
ve AS (SELECT query_id, source AS bundle_id, doc_id, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS rank
  FROM q, embeddings JOIN documents ON doc_id = vec_id QUALIFY rank <= 10),
b AS (SELECT query_id, bundle_id, doc_id, rank FROM kw UNION ALL SELECT query_id, bundle_id, doc_id, rank FROM ve),
fu AS (SELECT query_id, bundle_id, doc_id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 12) AS score FROM b GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id, bundle_id ORDER BY score DESC, doc_id) AS rank FROM fu QUALIFY rank <= 10),
ok AS (SELECT *, doc_id % 4 AS relevance FROM fr WHERE doc_id % 11 <> 0),
wh AS (SELECT query_id, bundle_id, query_id % 300 <> 0 AS whole FROM ok GROUP BY query_id, bundle_id)
SELECT query_id, bundle_id, doc_id AS chunk_id, CAST(row_number() OVER (PARTITION BY query_id, bundle_id ORDER BY CASE WHEN whole THEN relevance END DESC, rank) AS INTEGER) AS place FROM ok JOIN wh USING (query_id, bundle_id) WHERE NOT whole OR relevance > 0 QUALIFY place <= 6"""
)
def answer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw evidence of the stated questions (vectors with ids divisible by 100, and the first terms of their documents) in every bundle."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("bundle_id"), "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = vectors.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("v"))
    terms = F.slice(F.array_sort(keyword_terms(F.col("text"))), 1, 5)
    wanted = docs.filter("chunk_id % 100 = 0").join(asked.select(F.col("query_id").alias("chunk_id")), "chunk_id").select(F.col("chunk_id").alias("query_id"), F.explode(terms).alias("word"))
    words = docs.select("chunk_id", "bundle_id", F.explode(F.array_distinct(words_between(F.col("text"), "[^a-z0-9]+", 3))).alias("word"))
    keyword = retrieval.term_search(docs.select("chunk_id", "bundle_id"), words, wanted.withColumnRenamed("query_id", "_id"), "chunk_id", "bundle_id").withColumnRenamed("_id", "query_id")
    vector = retrieval.vector_search(vectors.join(docs.select("chunk_id", "bundle_id"), "chunk_id"), asked, "query_id", "v", "embedding", "chunk_id", within="bundle_id")
    found = routed.fused_candidates(keyword, vector, ["query_id", "bundle_id"])
    chunks = docs.select("chunk_id", F.when(F.col("chunk_id") % 11 != 0, "raw_extraction").otherwise("okf_topic").alias("source_type"), F.lit("raw_extracted").alias("review_status"))
    kept = found.filter("chunk_id % 11 <> 0")
    scores = kept.filter("query_id % 300 <> 0 or chunk_id % 2 = 0").select("query_id", "bundle_id", "chunk_id", (F.col("chunk_id") % 4).alias("relevance"))
    missing = kept.filter("query_id % 300 = 0").select("query_id", "bundle_id", F.lit(-1).cast("long").alias("chunk_id"), F.lit(1).cast("long").alias("relevance")).distinct()
    return routed.answer_candidates(found, chunks, scores.unionByName(missing))


_CITED = {"query_id": "CAST(floor(doc_id / 12) AS BIGINT)", "index": "doc_id % 12", "source_type": "CASE WHEN doc_id % 12 % 5 < 2 THEN 'okf' ELSE 'rag' END", "identity": "'i' || (doc_id * 5 % 17)", "again": "doc_id % 2"}


@query(
    f"""WITH {view_sql("c", _CITED, "documents")}, r AS (SELECT DISTINCT query_id, CASE WHEN query_id % 4 = 0 THEN 'rag_only' ELSE 'hybrid' END AS route FROM c),
u AS (SELECT c.*, route FROM c JOIN r USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id, identity ORDER BY again, index) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY again, index) AS place FROM u WHERE route <> 'rag_only' OR source_type = 'rag'),
m AS (SELECT * FROM k WHERE place <= CASE WHEN source_type = 'okf' THEN 4 ELSE 6 END),
a AS (SELECT query_id, count(*) AS citations, count_if(source_type = 'okf') AS approved, count_if(source_type = 'rag') AS raw FROM m WHERE (query_id, identity) NOT IN (SELECT query_id, identity FROM c WHERE again = 0) GROUP BY query_id),
n AS (SELECT query_id, count(*) AS n, string_agg(identity, ',' ORDER BY source_type, place) AS identities FROM m GROUP BY query_id)
SELECT r.query_id, coalesce(citations, 0) AS citations, CAST(coalesce(approved, 0) AS BIGINT) AS approved, CAST(coalesce(raw, 0) AS BIGINT) AS raw, coalesce(identities, '') AS identities FROM r LEFT JOIN a USING (query_id) LEFT JOIN n USING (query_id)"""
)
def retry_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of first tries and retries merged, and what each retry added."""
    cited = view(spark, sf_dir, _CITED, "documents")
    routes = cited.select("query_id").distinct().withColumn("route", F.when(F.col("query_id") % 4 == 0, "rag_only").otherwise("hybrid"))
    merged, deltas = routed.merged_attempts(cited.filter("again = 0").drop("again"), cited.filter("again = 1").drop("again"), routes)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("new_index", "identity"))), lambda x: x["identity"]), ",")
    return deltas.join(merged.groupBy("query_id").agg(listed.alias("identities")), "query_id", "left").fillna("", ["identities"])
