"""Queries over processing stages; documents are documents, events their jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import stages
from tessera.plans.base import query, view, view_sql

_DOCUMENT = {"document_id": "doc_id", "stored": "doc_id % 9 <> 0", "n_topics": "doc_id % 3"}
_JOB = {
    "document_id": "event_id % 400", "kind": "CASE WHEN event_id % 7 < 2 THEN 'extraction' WHEN event_id % 7 < 5 THEN 'authoring' ELSE 'approval' END", "job_id": "event_id", "created_at": "CAST(ts AS DATE)",
    "status": """CASE WHEN event_id % 7 < 2 THEN CASE event_id % 11 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' WHEN 2 THEN 'queued' ELSE 'completed' END
  WHEN event_id % 7 < 5 THEN CASE event_id % 13 WHEN 0 THEN 'failed' WHEN 1 THEN 'awaiting_provider' WHEN 2 THEN 'awaiting_cost_confirmation' WHEN 3 THEN 'queued' WHEN 4 THEN 'running' WHEN 5 THEN 'completed' ELSE 'ready_for_review' END
  ELSE CASE event_id % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' WHEN 3 THEN 'completed_with_failures' ELSE 'failed' END END""",
    "current_stage": "CASE event_id % 5 WHEN 0 THEN 'metadata_discovery' WHEN 1 THEN 'concept_discovery' WHEN 2 THEN 'enrichment' WHEN 3 THEN 'validation' ELSE 'review' END",
    "completed_stages": "CASE event_id % 5 WHEN 0 THEN ARRAY_OF() WHEN 1 THEN ARRAY_OF('metadata_discovery') WHEN 2 THEN ARRAY_OF('metadata_discovery', 'concept_discovery') ELSE ARRAY_OF('metadata_discovery', 'concept_discovery', 'enrichment', 'relation_classification') END",
    "error": "CASE WHEN event_id % 4 = 0 THEN 'Stopped.' END", "automatic": "event_id % 2 = 0", "n_done": "CAST(event_id % 4 AS INT)", "n_total": "CAST(event_id % 4 + event_id % 3 AS INT)", "n_failed": "CAST(event_id % 3 % 2 AS INT)",
}
_NAMES = ", ".join(f"'{n}'" for n in stages.STAGES)
_LABELS = ", ".join(f"'{label}'" for label, _ in stages.STAGES.values())
_DETAILS = ", ".join("'" + detail.replace("'", "''") + "'" for _, detail in stages.STAGES.values())
_STATES_SQL = f"""{view_sql("d", _DOCUMENT, "documents")}, {view_sql("j", _JOB, "events")},
k AS (SELECT *, row_number() OVER (PARTITION BY document_id, kind ORDER BY created_at DESC, job_id DESC) AS nth FROM j WHERE created_at <= (SELECT max(created_at) - INTERVAL 3 DAY FROM j)),
x AS (SELECT d.*, coalesce(e.status, 'queued') AS ex, r.job_id AS run, r.status AS rs, r.current_stage AS cur, r.completed_stages AS done_, r.error AS err, r.automatic AS auto, r.n_done AS wd, r.n_total AS wt,
    p.job_id AS app, p.status AS ps, p.n_done AS pd, p.n_total AS pt, p.n_failed AS pf
  FROM d LEFT JOIN k e ON e.document_id = d.document_id AND e.kind = 'extraction' AND e.nth = 1
  LEFT JOIN k r ON r.document_id = d.document_id AND r.kind = 'authoring' AND r.nth = 1 AND coalesce(e.status, 'queued') = 'completed'
  LEFT JOIN k p ON p.document_id = d.document_id AND p.kind = 'approval' AND p.nth = 1),
s AS (SELECT x.*, n.i, [{_NAMES}][i] AS id, [{_LABELS}][i] AS label, CASE
  WHEN i = 1 THEN CASE WHEN stored THEN 'completed' ELSE 'skipped' END WHEN i = 2 THEN ex
  WHEN run IS NULL THEN CASE WHEN i = 3 AND ex = 'completed' THEN 'action_required' ELSE 'waiting' END
  WHEN i < 8 THEN CASE WHEN list_contains(done_, [{_NAMES}][i]) THEN 'completed' WHEN cur <> [{_NAMES}][i] THEN 'waiting' WHEN rs = 'failed' THEN 'failed' WHEN rs LIKE 'awaiting%' THEN 'action_required' WHEN rs = 'queued' THEN 'queued' ELSE 'running' END
  WHEN rs NOT IN ('ready_for_review', 'completed') THEN 'waiting' WHEN NOT auto THEN 'action_required' WHEN app IS NULL THEN 'queued'
  WHEN ps = 'completed_with_failures' THEN 'action_required' ELSE ps END AS status FROM x, (SELECT unnest(range(1, 9)) AS i) n),
t AS (SELECT *, coalesce(CASE
  WHEN i = 2 AND ex = 'failed' THEN 'Text extraction failed. Review the error and retry the stored PDF.' WHEN i = 2 AND ex = 'completed' THEN 'Page-level source records are ready for downstream processing.'
  WHEN i = 3 AND run IS NULL AND ex = 'completed' THEN 'Extraction is complete. Start AI-assisted authoring when you are ready.'
  WHEN i BETWEEN 3 AND 7 AND status = 'failed' THEN coalesce(err, label || ' failed.')
  WHEN i BETWEEN 3 AND 7 AND status = 'action_required' AND rs = 'awaiting_provider' THEN 'Configure an AI provider before this workflow can continue.'
  WHEN i BETWEEN 3 AND 7 AND status = 'action_required' THEN 'Review the estimated authoring cost before enrichment continues.'
  WHEN i = 4 AND status <> 'waiting' AND wt > 0 THEN 'Analyzed ' || wd || ' of ' || wt || ' document windows.'
  WHEN i < 8 OR status = 'waiting' THEN NULL
  WHEN NOT auto THEN n_topics || CASE WHEN n_topics = 1 THEN ' topic is' ELSE ' topics are' END || ' ready for human review.'
  WHEN app IS NULL THEN 'Preparing eligible topics for automatic approval and export.' WHEN ps = 'queued' THEN 'Automatic approval and export are queued.'
  WHEN ps = 'running' THEN pd || ' completed, ' || (pt - pd - pf) || ' still processing, ' || pf || ' failed or skipped.'
  WHEN ps = 'completed' THEN pd || CASE WHEN pd = 1 THEN ' topic was' ELSE ' topics were' END || ' approved and exported automatically.'
  WHEN ps = 'completed_with_failures' THEN pd || ' succeeded; ' || pf || ' require review or retry.'
  WHEN pf > 0 THEN pf || ' automatic approval items failed.' ELSE 'Automatic approval and export failed.' END, [{_DETAILS}][i]) AS detail FROM s)"""


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = view(spark, sf_dir, _JOB, "events").withColumn("completed_stages", F.col("completed_stages").cast("array<string>"))
    last = jobs.agg(F.date_sub(F.max("created_at"), 3).alias("d")).first()["d"]
    return stages.processing_stages(view(spark, sf_dir, _DOCUMENT, "documents"), jobs, F.lit(last))


@query(f"WITH {_STATES_SQL} SELECT document_id, id, status, detail FROM t")
def processing_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight stages of every document, from the jobs up to three days before the last."""
    return _staged(spark, sf_dir).select("document_id", F.explode("stages").alias("s")).select("document_id", "s.id", "s.status", "s.detail")


@query(
    f"""WITH {_STATES_SQL}, o AS (SELECT document_id, coalesce(min(CASE WHEN status IN ('failed', 'action_required', 'running', 'queued') THEN i END), 8) AS i, bool_or(status IN ('running', 'queued')) AS active,
  bool_or(status = 'failed') AS failed, bool_or(status = 'action_required') AS asks, bool_and(status IN ('completed', 'skipped')) AS settled, any_value(run) IS NOT NULL AS authored FROM t GROUP BY document_id)
SELECT document_id, id AS current, label, detail, CASE WHEN failed THEN 'failed' WHEN asks THEN 'attention' WHEN active THEN 'active' ELSE 'success' END AS tone,
  NOT active AND (failed OR asks OR settled) AS terminal, active, active OR failed OR asks OR NOT authored AS shown FROM o JOIN t USING (document_id, i)"""
)
def processing_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document's header shows."""
    made = stages.processing_states(_staged(spark, sf_dir))
    return made.select("document_id", "current", "label", "detail", "tone", "terminal", "active", "shown")
