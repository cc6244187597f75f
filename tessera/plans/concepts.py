"""Queries over concepts; documents stand for concepts, embeddings of the same number for theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import concepts, graph
from tessera.plans.base import query, table, view, view_sql
from tessera.plans.search import _PHRASE, _TOK

_ASKED = [(1, "nd st er", 0), (2, "zzz", 100), (3, "nd zzz yyy", 200)]
_CONCEPT = {
    "path": "doc_id", "title": "substr(text, 1, 25)", "description": "substr(text, 26, 40)", "metadata": "source || ' ' || lang", "body": "text",
    "provenance": "CASE WHEN doc_id % 3 = 0 THEN 'automated' ELSE 'human' END", "content_hash": "doc_id % 9",
}
_EVIDENCE_SQL = f"""WITH {view_sql("c", _CONCEPT, "documents")}, a(query_id, q, vec) AS (VALUES (1, ['nd', 'st', 'er'], 0), (2, ['zzz'], 100), (3, ['nd', 'zzz', 'yyy'], 200)),
f AS (SELECT path, title, provenance, {_TOK.format("title")} AS t, {_TOK.format("description")} AS d, {_TOK.format("metadata")} AS m, {_TOK.format("body")} AS b FROM c),
s AS (SELECT query_id, path, title, provenance, len(q) AS nq, {_PHRASE.format("t")} AS pt, {_PHRASE.format("d")} AS pd, {_PHRASE.format("m")} AS pm, {_PHRASE.format("b")} AS pb,
  list_filter(q, lambda x: list_contains(t, x)) AS mt, list_filter(q, lambda x: list_contains(d, x)) AS md, list_filter(q, lambda x: list_contains(m, x)) AS mm, list_filter(q, lambda x: list_contains(b, x)) AS mb FROM f, a),
r AS (SELECT *, (CASE WHEN pt THEN 100 ELSE 0 END) + (CASE WHEN pd THEN 50 ELSE 0 END) + (CASE WHEN pm THEN 30 ELSE 0 END) + (CASE WHEN pb THEN 10 ELSE 0 END) + 20 * len(mt) + 8 * len(md) + 5 * len(mm) + len(mb) AS score,
  (pt OR pd OR pm) AS exact, len(list_distinct(list_concat(list_concat(mt, md), mm))) AS named FROM s WHERE len(mt) + len(md) + len(mm) + len(mb) > 0),
l AS (SELECT *, (exact OR named >= CASE WHEN nq <= 2 THEN 1 ELSE 2 END) AND score >= 8 AS qualifies, CASE WHEN (exact AND nq > 1) OR len(mt) >= 2 THEN 'strong' ELSE 'medium' END AS strength FROM r),
le AS (SELECT query_id, path, 'evidence' AS kind, 'lexical' AS mode, CAST(score AS DOUBLE) AS score, strength, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, provenance = 'automated', title, path) AS rank FROM l WHERE qualifies QUALIFY rank <= 4),
v AS (SELECT a.query_id, e.vec_id AS path, round(list_cosine_similarity(e.embedding::DOUBLE[], w.embedding::DOUBLE[]), 6) AS score FROM a JOIN embeddings w ON w.vec_id = a.vec, embeddings e JOIN c ON c.path = e.vec_id AND c.content_hash = CASE WHEN e.vec_id % 5 = 0 THEN -1 ELSE e.vec_id % 9 END
  WHERE a.query_id NOT IN (SELECT query_id FROM le) QUALIFY row_number() OVER (PARTITION BY a.query_id ORDER BY score DESC, e.vec_id) <= 8),
vm AS (SELECT v.*, title, provenance FROM v JOIN c USING (path)),
ve AS (SELECT query_id, path, 'evidence' AS kind, 'vector' AS mode, score, CASE WHEN score >= 0.7 THEN 'strong' ELSE 'medium' END AS strength, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, provenance = 'automated', title, path) AS rank FROM vm WHERE score >= LEAST QUALIFY rank <= 4),
n AS (SELECT coalesce(w.query_id, x.query_id) AS query_id, coalesce(w.path, x.path) AS path, coalesce(w.title, x.title) AS title, w.score AS ls, x.score AS vs FROM (SELECT * FROM l WHERE NOT qualifies) w
  FULL JOIN (SELECT * FROM vm WHERE score < LEAST AND score >= LEAST - 0.15::DOUBLE) x ON w.query_id = x.query_id AND w.path = x.path),
ne AS (SELECT query_id, path, 'near_miss' AS kind, CASE WHEN vs IS NOT NULL THEN 'vector' ELSE 'lexical' END AS mode, coalesce(vs, ls) AS score, 'weak' AS strength, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(vs, -2) DESC, coalesce(ls, -1) DESC, title, path) AS rank
  FROM n WHERE query_id NOT IN (SELECT query_id FROM le UNION SELECT query_id FROM ve) QUALIFY rank <= 8)
SELECT query_id, path, kind, mode, score, strength, CAST(rank AS INTEGER) AS rank FROM (SELECT * FROM le UNION ALL SELECT * FROM ve UNION ALL SELECT * FROM ne)"""


def _evidence(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    stale = F.when(F.col("vec_id") % 5 == 0, -1).otherwise(F.col("vec_id") % 9)
    held = vectors.select(F.col("vec_id").alias("path"), stale.alias("content_hash"), F.col("embedding").alias("vector"))
    asked = spark.createDataFrame(_ASKED, "query_id int, question string, vec long")
    questions = vectors.join(F.broadcast(asked), F.col("vec_id") == F.col("vec")).select("query_id", "question", F.col("embedding").alias("vector"))
    return concepts.concept_evidence(questions, view(spark, sf_dir, _CONCEPT, "documents"), held, least=least)


@query(_EVIDENCE_SQL.replace("LEAST", "0.5::DOUBLE"))
def concept_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for the asked questions: lexical first, by vector where there is none."""
    return _evidence(spark, sf_dir, 0.5)


@query(_EVIDENCE_SQL.replace("LEAST", "1.01::DOUBLE"))
def concept_near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where no similarity is enough, so that near misses come out."""
    return _evidence(spark, sf_dir, 1.01)


@query(r"""WITH x AS (SELECT doc_id, '[Bundle: ' || source || ' | Type: ' || coalesce(lang, 'unknown') || ']' AS h, substr(text, 1, 25) AS t, CASE WHEN doc_id % 3 = 0 THEN '' ELSE substr(text, 26, 40) END AS d, trim(substr(text, 66, 50)) AS b FROM documents),
y AS (SELECT doc_id, h || CASE WHEN t <> '' THEN chr(10) || t ELSE '' END || CASE WHEN d <> '' THEN chr(10) || d ELSE '' END || CASE WHEN b <> '' THEN chr(10) || b ELSE '' END AS embedded,
  trim(t) || CASE WHEN trim(t) <> '' AND trim(d) <> '' THEN chr(10) || chr(10) ELSE '' END || trim(d) AS chunk FROM x)
SELECT doc_id, sha256(embedded) AS embedded_sha256, chunk, 'okf_' || doc_id || '_' || substr(sha256(chunk), 1, 16) AS chunk_id FROM y""")
def concept_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedded text and the topic chunk of every document."""
    title, description = F.substring("text", 1, 25), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.substring("text", 26, 40))
    text, name = concepts.topic_chunk(F.col("doc_id"), title, description)
    embedded = concepts.embedding_text(F.col("source"), F.col("lang"), title, description, F.substring("text", 66, 50))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(embedded, 256).alias("embedded_sha256"), text.alias("chunk"), name.alias("chunk_id"))


_CHUNK = {"chunk_id": "doc_id", "document_id": "CAST(floor(doc_id / 4) AS BIGINT)", "source_type": "CASE WHEN doc_id % 2 = 0 THEN 'raw' ELSE 'topic' END", "version": "CAST(floor(doc_id / 4) % 3 AS BIGINT)", "active": "doc_id % 10 <> 0"}
_K = view_sql("k", _CHUNK, "documents")


@query(f"""WITH {_K} SELECT chunk_id, document_id, source_type, version, active AND NOT (document_id % 5 = 0 AND source_type = 'raw') AS active FROM k
UNION ALL SELECT chunk_id + 1000000, document_id, source_type, version + 1, true FROM k WHERE document_id % 5 = 0 AND source_type = 'raw'""")
def chunk_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks after every fifth document's raw chunks are made anew."""
    held = view(spark, sf_dir, _CHUNK, "documents")
    fresh = held.filter("document_id % 5 = 0 AND source_type = 'raw'").select((F.col("chunk_id") + 1000000).alias("chunk_id"), "document_id", "source_type")
    return concepts.replaced_chunks(held, fresh)


@query(f"WITH {_K} SELECT chunk_id, document_id, 1.0::DOUBLE AS score FROM k WHERE active AND chunk_id % 3 = 0 AND document_id % 7 <> 0 ORDER BY chunk_id LIMIT 10")
def chunk_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten active chunks of a wanted set whose documents are live."""
    held = view(spark, sf_dir, _CHUNK, "documents")
    documents = held.select("document_id", F.when(F.col("document_id") % 7 == 0, F.current_date()).alias("deleted_at")).distinct()
    return concepts.fetched(held, held.filter("chunk_id % 3 = 0").select("chunk_id"), documents).select("chunk_id", "document_id", "score")


@query(f"WITH {_K} SELECT DISTINCT document_id FROM k WHERE active AND source_type = 'raw'")
def indexed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least one active raw chunk."""
    held = view(spark, sf_dir, _CHUNK, "documents")
    return held.select("document_id").distinct().join(held.filter("active AND source_type = 'raw'").select("document_id"), "document_id", "left_semi")


_RELATION = {
    "path": "'c' || CAST(floor(doc_id / 3) AS BIGINT) || '.md'", "idx": "doc_id % 3", "relation": "CASE WHEN doc_id % 8 = 0 THEN 'invented' ELSE 'supports' END",
    "target": "CASE WHEN doc_id % 7 = 0 THEN '../c1.md' WHEN doc_id % 11 = 0 THEN 'c1.txt' ELSE 'c' || (doc_id * 7 % 400) || '.md' END",
    "target_type": "CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE 't' || (doc_id * 7 % 400 % 3) END", "reason": "CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE 'r' END",
}
_R = f"""{view_sql("r", _RELATION, "documents")}, f AS (SELECT DISTINCT 'c' || (doc_id % 300) || '.md' AS path, 't' || (doc_id % 300 % 3) AS type FROM documents)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 300
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), n, F.lit(".md")).alias("path"), F.concat(F.lit("t"), n % 3).alias("type")).distinct()


@query(
    f"""WITH {_R}, x AS (SELECT r.path, idx, CASE WHEN relation = 'invented' THEN 'relation_type_not_allowed' WHEN target LIKE '../%' OR target LIKE '%.txt' THEN 'relation_target_invalid' WHEN f.path IS NULL THEN 'relation_target_missing'
  WHEN target_type <> f.type THEN 'relation_target_type_mismatch' WHEN trim(reason) = '' THEN 'relation_reason_required' END AS code FROM r LEFT JOIN f ON f.path = r.target)
SELECT path, min(idx) AS idx, arg_min(code, idx) AS code FROM x WHERE code IS NOT NULL GROUP BY path"""
)
def relation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first violation of every concept's relations."""
    return concepts.relation_violations(view(spark, sf_dir, _RELATION, "documents"), _files(spark, sf_dir), graph.RELATIONS)


@query(
    f"""WITH {_R}, x AS (SELECT r.path, idx, target, CASE WHEN target LIKE '../%' OR target LIKE '%.txt' THEN 'relation_target_invalid' WHEN f.path IS NULL THEN 'relation_target_missing' END AS code FROM r LEFT JOIN f ON f.path = r.target)
SELECT path, code || ':' || idx || ':' || target AS warning FROM x WHERE code IS NOT NULL"""
)
def broken_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that point nowhere."""
    return concepts.broken_targets(view(spark, sf_dir, _RELATION, "documents"), _files(spark, sf_dir))


@query(
    f"""WITH {_R}, h AS (SELECT * FROM r WHERE path IN (SELECT path FROM f)), v AS (SELECT * FROM h WHERE target IN (SELECT path FROM f)),
d AS (SELECT n, count(*) AS degree FROM (SELECT path AS n FROM v UNION ALL SELECT target FROM v WHERE target <> path) GROUP BY n), b AS (SELECT target AS n, count(*) AS backlinks FROM v GROUP BY target),
i AS (SELECT path AS n, count(*) AS issues FROM h WHERE target NOT IN (SELECT path FROM f) GROUP BY path)
SELECT f.path, f.type, coalesce(degree, 0) AS degree, coalesce(backlinks, 0) AS backlinks, coalesce(issues, 0) AS issues FROM f LEFT JOIN d ON d.n = f.path LEFT JOIN b ON b.n = f.path LEFT JOIN i ON i.n = f.path"""
)
def explorer_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with degree, backlinks and broken edges."""
    edges = view(spark, sf_dir, _RELATION, "documents").select(F.col("path").alias("source"), "target")
    return concepts.explorer_nodes(_files(spark, sf_dir), edges)


@query("""WITH o AS (SELECT DISTINCT doc_id % 200 AS source, doc_id % 70 AS target, 'supports' AS relation FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT DISTINCT doc_id % 200 AS source, doc_id % 70 AS target, 'supports' AS relation FROM documents WHERE doc_id % 4 <> 0)
SELECT coalesce(o.source, n.source) AS source, coalesce(o.target, n.target) AS target, 'supports' AS relation, CASE WHEN n.source IS NULL THEN 'removed' WHEN o.source IS NULL THEN 'added' ELSE 'kept' END AS outcome FROM o FULL JOIN n ON o.source = n.source AND o.target = n.target""")
def discovery_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that a second discovery keeps, removes and adds."""
    docs = table(spark, sf_dir, "documents")
    made = lambda rows: rows.select((F.col("doc_id") % 200).alias("source"), (F.col("doc_id") % 70).alias("target"), F.lit("supports").alias("relation"))
    return concepts.discovery_difference(made(docs.filter("doc_id % 3 <> 0")), made(docs.filter("doc_id % 4 <> 0")))


_DECISION = {
    "doc_id": "doc_id", "run_id": "doc_id % 20", "related": "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE doc_id % 5 <> 0 END", "relation": "CASE WHEN doc_id % 7 = 0 THEN 'invented' WHEN doc_id % 19 = 0 THEN '' ELSE 'supports' END",
    "direction": "CASE WHEN doc_id % 2 = 0 THEN 'reverse' ELSE 'proposed' END", "forced": "CASE WHEN doc_id % 6 = 0 THEN 'proposed' END", "quote": "CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE substr(text, 5, 8) END",
    "rationale": "'because'", "source_text": "text", "target_text": "CASE WHEN doc_id % 4 = 0 THEN text ELSE '' END",
    "status": "CASE WHEN doc_id % 9 = 0 THEN 'accepted' ELSE 'pending' END", "verification": "CASE doc_id % 20 % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'failed' ELSE 'filtered' END",
}
_D = view_sql("d", _DECISION, "documents")


@query(
    f"""WITH {_D} SELECT doc_id, CASE WHEN related IS NULL THEN 'relation_verification_malformed_response' WHEN NOT related THEN NULL WHEN trim(relation) = '' OR trim(quote) = '' THEN 'relation_verification_incomplete_positive'
WHEN relation = 'invented' THEN 'relation_verification_relation_not_allowed' WHEN forced <> direction THEN 'relation_verification_direction_mismatch'
WHEN NOT contains(CASE WHEN direction = 'reverse' THEN target_text ELSE source_text END, quote) THEN 'relation_verification_evidence_not_in_source' END AS code FROM d"""
)
def verifier_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with every verifier decision."""
    return view(spark, sf_dir, _DECISION, "documents").select("doc_id", concepts.decision_code(graph.RELATIONS).alias("code"))


@query(
    f"""WITH {_D}, c AS (SELECT run_id, {", ".join(f"CAST(count_if(status = 'pending' AND verification = '{s}') AS BIGINT) AS {s}" for s in ("confirmed", "failed", "filtered", "queued", "running"))} FROM d GROUP BY run_id)
SELECT *, CASE WHEN queued + running = 0 THEN 'completed' ELSE 'running' END AS state FROM c"""
)
def verification_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and state of every verification run."""
    return concepts.verification_runs(view(spark, sf_dir, _DECISION, "documents"))


@query("SELECT source AS bundle_id, count(*) AS n FROM documents WHERE source NOT IN (SELECT min(source) FROM documents) GROUP BY source")
def bundle_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left in every bundle after the first one is deleted."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("bundle_id"))
    return concepts.without_bundle(docs, docs.agg(F.min("bundle_id").alias("bundle_id"))).groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n"))
