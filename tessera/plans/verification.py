"""Queries over the verification of relation candidates; users stand for candidates, their events for attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import verification
from tessera.plans.base import query, view, view_sql

_EVENT = {
    "candidate_id": "user_id % 300", "seq": "event_id",
    "event": "CASE WHEN event_id % 13 < 5 THEN 'start' WHEN event_id % 13 = 5 THEN 'confirm' WHEN event_id % 13 = 6 THEN 'filter' WHEN event_id % 13 < 10 THEN 'error' "
    "WHEN event_id % 13 = 10 THEN 'retry' WHEN event_id % 13 = 11 THEN 'reconcile' WHEN event_id % 97 = 3 THEN 'close' ELSE 'odd' END",
    "message": "CASE WHEN event_id % 13 NOT IN (7, 8, 9) THEN NULL WHEN event_id % 5 = 0 THEN 'relation_verification_incomplete_positive' WHEN event_id % 7 = 0 THEN 'relation_verification_requires_api_key' ELSE 'timeout' END",
    "attempt": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 4 AS INT) END",
}
_FOLD_SQL = f"""{view_sql("e", _EVENT, "events")}, n AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY seq) AS i FROM e),
f AS (SELECT candidate_id, 0 AS i, CAST(NULL AS BIGINT) AS seq, 'queued' AS before, 'queued' AS after, false AS refused UNION ALL
  SELECT n.candidate_id, n.i, n.seq, f.after, coalesce(s.after, f.after), s.after IS NULL FROM f JOIN n ON n.candidate_id = f.candidate_id AND n.i = f.i + 1, LATERAL (SELECT CASE
    WHEN f.after = 'closed' THEN NULL WHEN event = 'retry' THEN 'queued' WHEN event = 'close' THEN 'closed'
    WHEN event = 'start' AND f.after IN ('queued', 'running') THEN 'running' WHEN event = 'reconcile' AND f.after IN ('queued', 'running') THEN 'queued'
    WHEN f.after <> 'running' THEN NULL WHEN event = 'confirm' THEN 'confirmed' WHEN event = 'filter' OR (event = 'error' AND message LIKE '%incomplete_positive') THEN 'filtered'
    WHEN event = 'error' AND (message LIKE '%api_key' OR attempt >= 3) THEN 'failed' WHEN event = 'error' THEN 'queued' END AS after) s)"""


def _begin(sql: str) -> str:
    """The recursion starts from one row a candidate."""
    return sql.replace("SELECT candidate_id, 0 AS i,", "SELECT DISTINCT candidate_id, 0::BIGINT AS i,").replace("false AS refused UNION ALL", "false AS refused FROM e UNION ALL")


@query(f"WITH RECURSIVE {_begin(_FOLD_SQL)} SELECT candidate_id, seq, before, after, refused FROM f WHERE i > 0")
def verification_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State before and after every event of every candidate, and which were refused."""
    moved = verification.transitions(view(spark, sf_dir, _EVENT, "events"))
    return moved.select("candidate_id", "seq", "before", "after", "refused")


@query(
    f"""WITH RECURSIVE {_begin(_FOLD_SQL)}, h AS (SELECT f.*, n.event, n.message FROM f JOIN n USING (candidate_id, i)),
s AS (SELECT candidate_id, arg_max(after, seq) AS state, count_if(refused) AS n_refused, count_if(NOT refused AND event IN ('confirm', 'filter', 'error')) AS n_attempts,
  max(CASE WHEN NOT refused THEN seq END) AS last FROM h GROUP BY candidate_id)
SELECT s.candidate_id, state, CASE WHEN h.event = 'error' THEN h.message END AS error, n_attempts, n_refused FROM s LEFT JOIN h ON h.candidate_id = s.candidate_id AND h.seq = s.last"""
)
def verification_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final state, last error, attempts and refused events of every candidate."""
    return verification.final_states(verification.transitions(view(spark, sf_dir, _EVENT, "events")))


@query(
    f"""WITH RECURSIVE {_begin(_FOLD_SQL)}, s AS (SELECT candidate_id, arg_max(after, i) AS state FROM f GROUP BY candidate_id)
SELECT candidate_id % 20 AS run_id, count_if(state = 'queued') AS queued, count_if(state = 'running') AS running, count_if(state = 'confirmed') AS confirmed, count_if(state = 'filtered') AS filtered,
  count_if(state = 'failed') AS failed, CASE WHEN count_if(state IN ('queued', 'running')) = 0 THEN 'completed' ELSE 'running' END AS status FROM s GROUP BY ALL"""
)
def verification_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every discovery run by state."""
    events = view(spark, sf_dir, _EVENT, "events")
    states = verification.final_states(verification.transitions(events))
    candidates = events.select("candidate_id").distinct().withColumn("run_id", F.col("candidate_id") % 20)
    return verification.run_counts(states, candidates)
