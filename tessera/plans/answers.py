"""Queries over answers and their citations; conversation turns stand for answers, documents for citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import answers
from tessera.plans.base import query, table, view, view_sql

_ANSWER = {
    "answer_id": "doc_id", "outcome": "CASE WHEN doc_id % 7 = 0 THEN 'insufficient_evidence' ELSE 'answered' END", "question": "substr(text, 1, 40)",
    "route": "CASE doc_id % 5 WHEN 0 THEN 'okf_only' WHEN 1 THEN 'rag_only' WHEN 2 THEN 'hybrid' WHEN 3 THEN 'missing_context' ELSE 'unsupported' END",
    "discovery_only": "doc_id % 4 = 0",
}
_CITED = {
    "answer_id": "CAST(floor(doc_id / 3) AS BIGINT)", "position": "doc_id % 3 + 1", "source_type": "CASE WHEN doc_id % 5 < 3 THEN 'okf' ELSE 'rag' END",
    "provenance": "CASE doc_id % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'automated' ELSE NULL END", "mode": "CASE WHEN doc_id % 11 = 0 THEN 'graph' END", "text": "substr(text, 1, 20)",
    "path": "CASE WHEN doc_id % 5 < 3 THEN 'c' || (doc_id % 50) END", "document_id": "CASE WHEN doc_id % 5 >= 3 THEN doc_id END", "bundle_id": "CASE WHEN doc_id % 6 < 3 THEN 'b' || (doc_id % 6) END",
}
_A, _C = view_sql("a", _ANSWER, "documents"), view_sql("c", _CITED, "documents")


@query(
    f"""WITH {_A}, {_C}, n AS (SELECT answer_id, count_if(source_type = 'okf') AS okf, count_if(source_type = 'rag') AS rag, count(*) AS total,
  min(CASE WHEN source_type = 'okf' THEN coalesce(provenance, 'legacy') END) AS lo, max(CASE WHEN source_type = 'okf' THEN coalesce(provenance, 'legacy') END) AS hi, count_if(mode = 'graph') > 0 AS g FROM c GROUP BY answer_id),
k AS (SELECT a.answer_id, CAST(coalesce(okf, 0) AS BIGINT) AS okf, CAST(coalesce(rag, 0) AS BIGINT) AS rag, CAST(coalesce(total, 0) AS BIGINT) AS total, CASE WHEN outcome = 'insufficient_evidence' OR n.answer_id IS NULL THEN 'none' WHEN okf > 0 AND rag > 0 THEN 'mixed'
  WHEN okf > 0 THEN 'approved_okf' ELSE 'raw_rag' END AS kind, CASE WHEN lo = hi THEN lo ELSE 'mixed' END AS p, g FROM a LEFT JOIN n USING (answer_id))
SELECT answer_id, okf, rag, total, kind, CASE WHEN kind IN ('mixed', 'approved_okf') THEN p END AS provenance, CASE WHEN kind IN ('mixed', 'approved_okf') THEN CASE WHEN g THEN 'graph' ELSE 'direct' END END AS mode,
CASE WHEN kind = 'none' THEN 'blocked' WHEN kind = 'approved_okf' AND p IN ('human', 'legacy') THEN 'high' ELSE 'medium' END AS trust, NOT (kind = 'approved_okf' AND p IN ('human', 'legacy')) AS verify FROM k"""
)
def answer_evidence_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence profile of every answer."""
    return answers.evidence_profiles(view(spark, sf_dir, _ANSWER, "documents"), view(spark, sf_dir, _CITED, "documents"))


@query(
    f"""WITH {_C}, g AS (SELECT answer_id, bool_or(coalesce(document_id % 9 = 0, false) OR coalesce(path IN ('c1', 'c7'), false)) AS of_document, bool_or(coalesce(bundle_id = 'b1', false)) AS named, bool_or(bundle_id IS NULL) AS legacy FROM c GROUP BY answer_id)
SELECT answer_id, of_document, named OR (legacy AND answer_id % 2 = 0) AS of_bundle FROM g"""
)
def citation_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which answers cite a deleted document, its concepts, or bundle b1."""
    cited = view(spark, sf_dir, _CITED, "documents").withColumn("document_id", F.when(F.col("document_id") % 9 == 0, 0).otherwise(F.col("document_id")))
    held = cited.groupBy("answer_id").agg(F.collect_list(F.struct("document_id", "path", "bundle_id")).alias("citations"))
    scope = F.when(F.col("answer_id") % 2 == 0, F.array(F.lit("b1"))).otherwise(F.array(F.lit("b1"), F.lit("b2")))
    return held.select(
        "answer_id", answers.references_document(F.col("citations"), F.lit(0), F.array(F.lit("c1"), F.lit("c7"))).alias("of_document"),
        answers.references_bundle(F.col("citations"), scope, F.lit("b1")).alias("of_bundle"),
    )


_STATES = "['active', 'archived', 'deleting', 'deleted', 'retracted', 'odd']"


@query(
    f"""WITH {_C}, k AS (SELECT *, CASE WHEN source_type = 'okf' THEN coalesce(bundle_id, 'b0') ELSE bundle_id END AS b FROM c),
l AS (SELECT DISTINCT 'b' || (doc_id % 3) AS b, 'c' || (doc_id % 50) AS path, {_STATES}[doc_id % 50 % 6 + 1] AS status FROM documents WHERE doc_id % 50 < 40),
f AS (SELECT DISTINCT 'b' || (doc_id % 3) AS b, 'c' || (doc_id % 50) AS path FROM documents WHERE doc_id % 50 % 7 <> 3)
SELECT answer_id, position, b AS bundle_id, CASE
  WHEN source_type = 'rag' THEN CASE WHEN document_id % 10 IN (3, 4) THEN 'This source is no longer available.' END
  WHEN EXISTS (SELECT 1 FROM l WHERE l.b = k.b AND l.path = k.path AND status = 'retracted') THEN 'This source was retracted after this answer was generated.'
  WHEN EXISTS (SELECT 1 FROM l WHERE l.b = k.b AND l.path = k.path AND status = 'archived') THEN 'This source is now archived and may no longer reflect current approved knowledge.'
  WHEN EXISTS (SELECT 1 FROM l WHERE l.b = k.b AND l.path = k.path AND status = 'deleted') OR NOT EXISTS (SELECT 1 FROM f WHERE f.b = k.b AND f.path = k.path) THEN 'This source is no longer available.'
END AS notice FROM k"""
)
def citation_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices of citations whose concept or document is gone."""
    docs = table(spark, sf_dir, "documents")
    n = F.col("doc_id") % 50
    named = docs.select("doc_id", n.alias("n"), F.concat(F.lit("b"), F.col("doc_id") % 3).alias("bundle_id"), F.concat(F.lit("c"), n).alias("path"))
    states = F.get(F.array(*map(F.lit, ("active", "archived", "deleting", "deleted", "retracted", "odd"))), (F.col("n") % 6).cast("int"))
    lifecycle = named.filter("n < 40").select("bundle_id", "path", states.alias("status")).distinct()
    documents = docs.filter("doc_id % 10 <> 3").select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 10 == 4, F.current_date()).alias("deleted_at"))
    noticed = answers.citation_notices(view(spark, sf_dir, _CITED, "documents"), lifecycle, documents, named.filter("n % 7 <> 3"), "b0")
    return noticed.select("answer_id", "position", "bundle_id", "notice")


@query(f"""WITH {_C}, e AS (SELECT answer_id, position, 'e:' || text AS text FROM c WHERE position <> 2)
SELECT c.answer_id, c.position, coalesce(e.text, c.text) AS text FROM c LEFT JOIN e USING (answer_id, position)""")
def citation_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations with the text of their evidence, or their own."""
    cited = view(spark, sf_dir, _CITED, "documents").select("answer_id", "position", "text")
    return answers.with_evidence(cited, cited.filter("position <> 2").withColumn("text", F.concat(F.lit("e:"), "text")))


_CALL = {
    "query_id": "CAST(floor(doc_id / 8) AS BIGINT)", "seq": "doc_id % 8", "tool": "CASE WHEN doc_id % 3 = 0 THEN 'search' ELSE 'graph' END", "status": "CASE WHEN doc_id % 4 = 0 THEN 'failed' ELSE 'done' END",
    "bundles": "ARRAY_OF('b' || (doc_id % 3), 'b' || (doc_id % 2))", "results": "doc_id % 10", "warnings": "CASE WHEN doc_id % 5 = 0 THEN ARRAY_OF('slow') WHEN doc_id % 5 = 1 THEN ARRAY_OF('slow', 'late') ELSE ARRAY_OF() END",
}


@query(
    f"""WITH {view_sql("c", _CALL, "documents")}, g AS (SELECT query_id, tool, status, min(seq) AS first, CAST(sum(results) AS BIGINT) AS results, flatten(list(bundles ORDER BY seq)) AS b, flatten(list(warnings ORDER BY seq)) AS w FROM c GROUP BY query_id, tool, status)
SELECT query_id, tool, status, first, results, array_to_string(list_filter(b, lambda x, i: list_position(b, x) = i), ',') AS bundles, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ',') AS warnings FROM g"""
)
def tool_call_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls of every query by tool and status."""
    rolled = answers.tool_rollup(view(spark, sf_dir, _CALL, "documents"))
    return rolled.withColumns({c: F.array_join(c, ",") for c in ("bundles", "warnings")})


@query("""SELECT CAST(floor(doc_id / 8) AS BIGINT) AS query_id, CAST(sum(CASE WHEN doc_id % 3 = 0 THEN n_chars % 7 ELSE doc_id % 4 END) AS BIGINT) AS approved_matches, count(*) AS bundles_searched, CAST(sum(CASE WHEN doc_id % 3 = 0 THEN n_chars % 11 ELSE 0 END) AS BIGINT) AS documents_searched
FROM documents GROUP BY ALL""")
def search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search totals of every query over its bundles; a bundle without a summary counts its own evidence."""
    summed = F.col("doc_id") % 3 == 0
    docs = table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 8).alias("query_id"), F.when(summed, F.col("n_chars") % 7).alias("said"), (F.col("doc_id") % 4).alias("evidence"), F.when(summed, F.col("n_chars") % 11).alias("searched"),
    )
    return docs.groupBy("query_id").agg(
        F.sum(F.coalesce("said", "evidence")).alias("approved_matches"), F.count(F.lit(1)).alias("bundles_searched"), F.sum(F.coalesce("searched", F.lit(0))).alias("documents_searched"),
    )


@query(
    """WITH b AS (SELECT source AS bundle_id, lower(string_agg(substr(text, 1, 60), ' ' ORDER BY doc_id)) AS s FROM documents GROUP BY source), l AS (SELECT list(bundle_id ORDER BY bundle_id) AS scope FROM b),
q AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' +'), lambda w: length(w) > 2)) AS terms FROM benchmark),
s AS (SELECT query_id, bundle_id, len(list_filter(terms, lambda t: contains(s, t))) AS score FROM q, l, b WHERE list_position(scope, bundle_id) <= 10)
SELECT query_id, bundle_id, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bundle_id) AS INTEGER) AS rank FROM s"""
)
def bundle_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles (sources) ranked for every benchmark question over the first ten of the scope."""
    docs = table(spark, sf_dir, "documents")
    head = F.sort_array(F.collect_list(F.struct("doc_id", F.substring("text", 1, 60).alias("head"))))
    bundles = docs.groupBy(F.col("source").alias("bundle_id")).agg(F.array_join(F.transform(head, lambda x: x["head"]), " ").alias("searchable"))
    scope = bundles.agg(F.sort_array(F.collect_set("bundle_id")).alias("scope"))  # one row
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")).crossJoin(F.broadcast(scope))
    return answers.ranked_bundles(asked, bundles)


_ASKED = {
    "query_id": "item_id", "question": "CASE item_id % 6 WHEN 0 THEN 'What is it about?' WHEN 1 THEN 'please explain the problem' WHEN 2 THEN 'Check pump' WHEN 3 THEN ' ' WHEN 4 THEN 'please explain more about pump failure modes now' ELSE text END",
    "route": "CASE WHEN item_id % 7 = 0 THEN 'missing_context' ELSE 'hybrid' END", "confidence": "CASE WHEN item_id % 11 = 0 THEN 'low' ELSE 'high' END",
}


@query(
    f"""WITH {view_sql("q", _ASKED, "benchmark")}, w AS (SELECT *, trim(regexp_replace(question, '\\s+', ' ', 'g')) AS s FROM q), t AS (SELECT *, list_filter(string_split(s, ' '), lambda x: x <> '') AS words FROM w)
SELECT query_id, confidence = 'low' OR route = 'missing_context' OR regexp_matches(question, '(?i)\\b(it|this|that|these|those|they|them|there)\\b')
  OR (len(words) <= 5 AND len(list_filter(words, lambda x: regexp_replace(lower(x), '[^a-z0-9-]', '', 'g') NOT IN {answers.FILLER})) <= 1) AS understand,
s = '' OR len(list_filter(regexp_split_to_array(lower(s), '[^a-z0-9-]+'), lambda x: x <> '' AND x NOT IN {answers.VAGUE})) = 0 AS vague FROM t"""
)
def question_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which questions must be understood first, and which stay vague."""
    c = F.col
    return view(spark, sf_dir, _ASKED, "benchmark").select(
        "query_id", answers.needs_understanding(c("question"), c("route"), c("confidence")).alias("understand"), answers.is_vague(c("question"), F.lit(0)).alias("vague")
    )


@query(
    f"""WITH {_A}, {_C}, b AS (SELECT answer_id, string_agg(text || ' [' || position || ']', ' ' ORDER BY position) AS body FROM c GROUP BY answer_id)
SELECT answer_id, CASE WHEN discovery_only AND route <> 'rag_only' THEN '{answers.INTROS["discovery"]}' WHEN route = 'okf_only' THEN '{answers.INTROS["okf_only"]}' WHEN route = 'rag_only' THEN '{answers.INTROS["rag_only"]}'
  ELSE '{answers.INTROS["hybrid"]}' END || ' ' || body AS answer FROM a JOIN b USING (answer_id)"""
)
def deterministic_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer that each answer's citations make."""
    cited = view(spark, sf_dir, _CITED, "documents").select("answer_id", F.col("position").alias("index"), "text")
    return answers.deterministic_answers(cited, view(spark, sf_dir, _ANSWER, "documents"))


@query(f"WITH {_A} SELECT answer_id, question, route FROM a WHERE outcome = 'insufficient_evidence' AND route IN ('okf_only', 'rag_only', 'hybrid')")
def knowledge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps that answers without enough evidence leave."""
    return answers.knowledge_gaps(view(spark, sf_dir, _ANSWER, "documents"))
