"""Queries over rewrites, retries and suggestions; benchmark items stand for questions, documents for topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import acceptance, promotion
from tessera.plans.base import query, view, view_sql

_REWRITE = {
    "query_id": "doc_id", "question": "CASE doc_id % 4 WHEN 0 THEN 'What is the official ' || upper(substr(source, 1, 3)) || '-104 procedure?' WHEN 1 THEN 'Find all pages about ABC' ELSE 'Define  the term ' || lang END",
    "origin": "CASE WHEN doc_id % 6 = 0 THEN 'Can we approve this policy?' END", "context": "CASE WHEN doc_id % 5 = 0 THEN ARRAY_OF('the blue pump', 'as said') END",
    "route": "CASE WHEN doc_id % 4 = 1 THEN 'rag_only' WHEN doc_id % 19 = 0 THEN 'hybrid' ELSE 'okf_only' END", "needs_graph": "doc_id % 23 = 0",
    "required": "CASE WHEN doc_id % 2 = 0 THEN ARRAY_OF('subject_or_entity', 'source_authority', 'odd') END", "asked": "doc_id % 3 = 0",
    "rewrite": "CASE doc_id % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'official procedure' WHEN 2 THEN 'Find all pages about ABC now' ELSE 'official ' || upper(substr(source, 1, 3)) || '-104 procedure  define ' || CASE WHEN doc_id % 4 = 1 THEN 'search ABC' ELSE lang END END",
    "entities": "ARRAY_OF('procedure', ' ABC ', 'nowhere')",
    "field": "CASE WHEN doc_id % 4 < 2 THEN 'subject_or_entity' ELSE 'source_authority' END", "basis": "CASE WHEN doc_id % 9 < 6 THEN 'conversation' ELSE 'safe_default' END",
    "value": "CASE doc_id % 5 WHEN 0 THEN 'blue  pump' WHEN 1 THEN 'all subjects represented in the workspace' WHEN 2 THEN '' ELSE 'this policy' END",
}
_HOLDS = "regexp_matches(lower({0}), '(^|[^a-z0-9])' || lower({1}) || '([^a-z0-9]|$)')"
_SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query(
    rf"""WITH {view_sql("r", _REWRITE, "documents")}, s AS (SELECT *, upper(substr(question, 22, 3)) || '-104' AS code, CASE WHEN origin IS NULL THEN {_SQUEEZE.format("question")} ELSE origin || ' ' || {_SQUEEZE.format("question")} END AS seed,
  CASE WHEN query_id % 4 = 0 THEN upper(substr(question, 22, 3)) || '-104' WHEN query_id % 4 = 1 THEN 'ABC' END AS entity, {_SQUEEZE.format("value")} AS v, {_SQUEEZE.format("rewrite")} AS plain FROM r),
t AS (SELECT *, seed || coalesce(' ' || array_to_string(context, ' '), '') AS said, asked AND query_id % 2 = 0 AS given FROM s),
u AS (SELECT *, given AND (v = '' OR (basis = 'conversation' AND NOT {_HOLDS.format("said", "v")}) OR (basis = 'safe_default' AND v <> CASE WHEN field = 'subject_or_entity' THEN 'all subjects represented in the workspace' ELSE 'approved OKF first, with raw documents only as labeled discovery' END)) AS wrong,
  CASE WHEN given AND basis = 'conversation' AND NOT {_HOLDS.format("plain", "v")} THEN {_SQUEEZE.format("plain || ' ' || v")} ELSE plain END AS q FROM t),
w AS (SELECT *, CASE WHEN lower(q) LIKE '%find all%' OR lower(q) LIKE '%search%' THEN 'rag_only' ELSE 'okf_only' END AS new_route FROM u),
x AS (SELECT *, CASE WHEN plain = '' THEN 'query_understanding_malformed_response' WHEN wrong THEN 'query_understanding_invalid_assumptions' WHEN entity IS NOT NULL AND NOT {_HOLDS.format("q", "entity")} THEN 'query_understanding_dropped_protected_entity'
  WHEN new_route <> route OR needs_graph THEN 'optimized_query_route_conflict' END AS warning FROM w)
SELECT query_id, CASE WHEN warning IS NULL THEN 'llm' ELSE 'fallback_original' END AS mode, CASE WHEN warning IS NULL THEN q ELSE seed END AS query, warning,
CASE WHEN warning IS NULL OR warning = 'optimized_query_route_conflict' THEN CASE WHEN given THEN field || '=' || v ELSE '' END
  WHEN asked AND query_id % 2 = 0 THEN 'subject_or_entity=all subjects represented in the workspace|source_authority=approved OKF first, with raw documents only as labeled discovery' ELSE '' END AS assumptions,
array_to_string(list_filter([entity, CASE WHEN warning IS NULL AND {_HOLDS.format("said", "'procedure'")} AND {_HOLDS.format("q", "'procedure'")} THEN 'procedure' END,
  CASE WHEN warning IS NULL AND coalesce(entity, '') <> 'ABC' AND {_HOLDS.format("said", "'abc'")} AND {_HOLDS.format("q", "'abc'")} THEN 'ABC' END], lambda e: e IS NOT NULL), '|') AS entities,
CASE WHEN warning = 'optimized_query_route_conflict' THEN new_route END AS conflicting_route FROM x"""
)
def rewrite_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which proposed rewrites are taken, and what stands in for the others."""
    rows = view(spark, sf_dir, _REWRITE, "documents").withColumn("assumptions", F.array(F.struct("field", "value", "basis")))
    made = acceptance.rewrite_outcomes(rows.withColumns({c: F.col(c).cast("array<string>") for c in ("context", "required", "entities")}))
    listed = F.array_join(F.transform("assumptions", lambda a: F.concat(a["field"], F.lit("="), a["value"])), "|")
    return made.withColumns({"assumptions": listed, "entities": F.array_join("entities", "|")})


_RETRY = {
    "query_id": "doc_id", "question": "'official ' || upper(substr(source, 1, 3)) || '-7 procedure'", "route": "CASE WHEN doc_id % 17 = 0 THEN 'hybrid' ELSE 'okf_only' END", "needs_graph": "doc_id % 29 = 0",
    "sufficiency": "CASE doc_id % 5 WHEN 0 THEN 'strong' WHEN 1 THEN 'partial' ELSE 'weak' END", "enabled": "CASE WHEN doc_id % 13 = 0 THEN ARRAY_OF() ELSE ARRAY_OF('b1') END",
    "call": "CASE doc_id % 11 WHEN 0 THEN 'missing_key' WHEN 1 THEN 'provider_failed' END", "reason": "CASE WHEN doc_id % 12 = 0 THEN ' ' WHEN doc_id % 31 = 0 THEN repeat('x', 501) ELSE 'wider' END",
    "retry": "CASE doc_id % 9 WHEN 0 THEN 'latest weather today' WHEN 1 THEN 'official procedure in general' WHEN 2 THEN 'Official  ' || upper(substr(source, 1, 3)) || '-7   PROCEDURE ' WHEN 3 THEN 'official ' || upper(substr(source, 1, 3)) || '-7 procedure bundle id: b2' WHEN 4 THEN NULL "
    "ELSE 'official ' || upper(substr(source, 1, 3)) || '-7 procedure guidance' END",
}


@query(
    f"""WITH {view_sql("r", _RETRY, "documents")}, q AS (SELECT *, {_SQUEEZE.format("coalesce(retry, '')")} AS q, len(enabled) > 0 AND sufficiency IN ('weak', 'partial') AS eligible FROM r),
o AS (SELECT *, CASE WHEN len(enabled) = 0 THEN 'disabled' WHEN NOT eligible THEN 'not_eligible' WHEN call IS NOT NULL THEN call WHEN q = '' OR length(trim(reason)) NOT BETWEEN 1 AND 500 THEN 'malformed_response'
  WHEN query_id % 9 = 0 OR route <> 'okf_only' OR needs_graph THEN 'rejected_route_change' WHEN query_id % 9 = 3 THEN 'rejected_scope_change' WHEN query_id % 9 = 1 THEN 'rejected_identifier_loss'
  WHEN lower(q) = lower(question) THEN 'rejected_equivalent_query' ELSE 'applied' END AS outcome FROM q)
SELECT query_id, eligible, outcome, CASE WHEN outcome = 'applied' THEN q END AS query FROM o"""
)
def retry_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of every bounded retry."""
    rows = view(spark, sf_dir, _RETRY, "documents")
    return acceptance.retry_outcomes(rows.withColumn("enabled", F.col("enabled").cast("array<string>")))


_NAMED = "'topic:' || "
_SUGGESTION = {
    "position": "doc_id", "source": f"CASE WHEN doc_id % 29 = 0 THEN 'file.md' ELSE {_NAMED}(doc_id % 700) END", "target": f"CASE WHEN doc_id % 31 = 0 THEN 'topic:' ELSE {_NAMED}(doc_id * 7 % 700) END",
    "relation": "CASE doc_id % 6 WHEN 0 THEN 'supports' WHEN 1 THEN 'depends_on' WHEN 2 THEN 'conflicts_with' WHEN 3 THEN 'supersedes' WHEN 4 THEN 'covered_by' ELSE 'invented' END",
    "reason": "CASE WHEN doc_id % 37 = 0 THEN ' ' WHEN doc_id % 41 = 0 THEN NULL ELSE 'r' || doc_id END", "evidence_quote": "CASE WHEN doc_id % 43 = 0 THEN '' ELSE 'said' END",
    "rationale": "CAST(NULL AS {0})", "signals": "ARRAY_OF('shared_tags')",
}
_TOPIC = {"topic_id": "doc_id", "review_status": "CASE WHEN doc_id % 10 = 9 THEN 'needs_review' ELSE 'approved' END", "exported_path": "CASE WHEN doc_id % 23 = 0 THEN NULL ELSE 'concepts/t' || doc_id || '.md' END"}
_KNOWN = {
    "source": "'concepts/t' || (doc_id % 700) || '.md'", "target": "'concepts/t' || (doc_id * 7 % 700) || '.md'", "relation": "CASE doc_id % 6 WHEN 0 THEN 'supports' WHEN 1 THEN 'depends_on' WHEN 2 THEN 'conflicts_with' WHEN 3 THEN 'supersedes' ELSE 'covered_by' END",
    "status": "CASE WHEN doc_id % 2 = 0 THEN 'pending' ELSE 'approved' END", "verification": "'confirmed'", "reason": "'old'", "signals": "ARRAY_OF('old')",
}
_EDGE = {"source": "'concepts/t' || (doc_id * 7 % 700) || '.md'", "target": "'concepts/t' || (doc_id % 700) || '.md'", "relation": "CASE WHEN doc_id % 12 < 6 THEN 'supports' WHEN doc_id % 12 < 9 THEN 'supersedes' ELSE 'conflicts_with' END"}
_AT_KNOWN, _AT_EDGE = "documents WHERE doc_id % 5 = 0", "documents WHERE doc_id % 4 = 1"


def _filtered(spark: SparkSession, sf_dir: str, columns: dict[str, str], source: str) -> DataFrame:
    name, _, where = source.partition(" WHERE ")
    return view(spark, sf_dir, {**columns, "_keep": where}, name).filter("_keep").drop("_keep").distinct()


_SUGGESTED_SQL = f"""{view_sql("s", _SUGGESTION, "documents").replace("{0}", "VARCHAR")}, {view_sql("t", _TOPIC, "documents")},
k AS (SELECT DISTINCT * FROM ({view_sql("x", _KNOWN, _AT_KNOWN).removeprefix("x AS (").removesuffix(")")})), e0 AS (SELECT DISTINCT * FROM ({view_sql("x", _EDGE, _AT_EDGE).removeprefix("x AS (").removesuffix(")")})),
e AS (SELECT * FROM e0 UNION SELECT source, target, relation FROM k WHERE status = 'pending'),
p AS (SELECT 'topic:' || topic_id AS name, exported_path AS path FROM t WHERE review_status = 'approved' AND exported_path IS NOT NULL),
w AS (SELECT * FROM s WHERE reason IS NOT NULL AND evidence_quote <> ''),
c AS (SELECT w.position, w.relation, w.reason, a.path AS source, b.path AS target FROM w LEFT JOIN p a ON a.name = w.source LEFT JOIN p b ON b.name = w.target),
d AS (SELECT c.*, k.status FROM c LEFT JOIN k ON k.source = c.source AND k.target = c.target AND k.relation = c.relation),
reach AS (SELECT relation, source AS a, target AS b FROM e WHERE relation = 'supersedes' OR relation = 'depends_on' UNION SELECT r.relation, r.a, e.target FROM reach r JOIN e ON e.relation = r.relation AND e.source = r.b),
i AS (SELECT d.*, list_filter([CASE WHEN relation = 'invented' THEN 'relation_type_not_allowed' END, CASE WHEN source = target THEN 'relation_self_link' END, CASE WHEN trim(reason) = '' THEN 'relation_reason_required' END,
  CASE WHEN status IS NULL AND EXISTS (SELECT 1 FROM e WHERE e.source = d.source AND e.target = d.target AND e.relation = d.relation) THEN 'relation_exact_duplicate' END,
  CASE WHEN d.relation = 'conflicts_with' AND EXISTS (SELECT 1 FROM e WHERE e.source = d.target AND e.target = d.source AND e.relation = d.relation) THEN 'relation_reverse_duplicate' END,
  CASE WHEN d.relation IN ('covered_by', 'invented') AND EXISTS (SELECT 1 FROM e WHERE e.source = d.target AND e.target = d.source AND e.relation = d.relation) THEN 'relation_reverse_direction_conflict' END,
  CASE WHEN d.relation IN ('depends_on', 'supersedes') AND (source = target OR EXISTS (SELECT 1 FROM reach r WHERE r.relation = d.relation AND r.a = d.target AND r.b = d.source)) THEN 'relation_cycle_detected' END,
  CASE WHEN d.relation = 'supersedes' AND EXISTS (SELECT 1 FROM e WHERE e.relation = 'supersedes' AND e.target = d.target AND e.source <> d.source) THEN 'relation_competing_supersedes' END], lambda x: x IS NOT NULL) AS issues,
  d.relation = 'supports' AND EXISTS (SELECT 1 FROM e WHERE e.source = d.target AND e.target = d.source AND e.relation = d.relation) AS warned FROM d)"""


def _promoted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    suggestion = {c: e.replace("{0}", "STRING") for c, e in _SUGGESTION.items()}
    topics = view(spark, sf_dir, _TOPIC, "documents")
    known = _filtered(spark, sf_dir, _KNOWN, _AT_KNOWN)
    edges = _filtered(spark, sf_dir, _EDGE, _AT_EDGE).unionByName(known.filter("status = 'pending'").select("source", "target", "relation"))
    files = view(spark, sf_dir, {"path": "'concepts/t' || doc_id || '.md'", "type": "lang"}, "documents")
    return promotion.promoted(view(spark, sf_dir, suggestion, "documents"), topics, known, edges, files)


@query(
    f"""WITH RECURSIVE {_SUGGESTED_SQL}
SELECT position, CASE WHEN source IS NULL OR target IS NULL THEN 'unresolved' WHEN status <> 'pending' THEN 'already_decided' WHEN len(issues) > 0 THEN 'refused:' || array_to_string(issues, ',') WHEN status IS NULL THEN 'created' ELSE 'updated' END AS outcome FROM i"""
)
def suggestion_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every complete relation suggestion."""
    return _promoted(spark, sf_dir)[0]


@query(
    f"""WITH RECURSIVE {_SUGGESTED_SQL}, n AS (SELECT source, target, relation, reason, CASE WHEN warned THEN 'shared_tags,{promotion.WARNING}' ELSE 'shared_tags' END AS signals, row_number() OVER (PARTITION BY source, target, relation ORDER BY position DESC) AS nth
  FROM i WHERE source IS NOT NULL AND target IS NOT NULL AND coalesce(status, 'pending') = 'pending' AND len(issues) = 0)
SELECT source, target, relation, 'pending' AS status, 'queued' AS verification, reason, signals FROM n WHERE nth = 1
UNION ALL SELECT source, target, relation, status, verification, reason, array_to_string(signals, ',') FROM k WHERE (source, target, relation) NOT IN (SELECT source, target, relation FROM n)"""
)
def promoted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation candidates after the suggestions are promoted."""
    return _promoted(spark, sf_dir)[1].withColumn("signals", F.array_join("signals", ","))
