"""Queries over profiles, reconciled topics and relation blocks; documents stand for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import profiles
from tessera.plans.base import query, view, view_sql

_PROFILE = {
    "profile_id": "doc_id", "agent_retry": "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE doc_id % 2 = 0 END", "auto_approve": "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE true END",
    "fields": "CASE WHEN doc_id % 5 = 0 THEN ARRAY_OF('title', 'tags', 'type', source) ELSE ARRAY_OF('title', 'description', 'tags', 'updated', 'type', 'revision', source) END",
    "kinds": "CASE WHEN doc_id % 5 = 0 THEN ARRAY_OF('string', 'string_array', 'date', 'object') ELSE ARRAY_OF('string', 'string', 'string_array', 'date', 'string', 'number', 'object') END",
    "required": "CASE WHEN doc_id % 7 = 0 THEN ARRAY_OF('title') ELSE ARRAY_OF('title', 'type') END", "types": "CASE WHEN doc_id % 11 = 0 THEN ARRAY_OF() ELSE ARRAY_OF(lang) END",
    "clarifications": "CASE WHEN doc_id % 3 = 0 THEN ARRAY_OF('title', 'revision', 'title', source, 'none') ELSE ARRAY_OF('tags') END",
    "relations": "CASE WHEN doc_id % 19 = 0 THEN ARRAY_OF('references', 'Bad Name') ELSE ARRAY_OF('references') END",
    "stopwords": "CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN ARRAY_OF('the', substr(text, 1, 9)) ELSE ARRAY_OF('the', 'of-it') END",
}
_UNASKABLE = ", ".join(f"'{x}'" for x in profiles.UNASKABLE)


@query(
    f"""WITH {view_sql('p', _PROFILE, 'documents')}
SELECT profile_id, array_to_string(list_filter(list_concat(list_concat([
  CASE WHEN agent_retry IS NULL THEN 'knowledge_profile_agent_invalid' END, CASE WHEN auto_approve IS NULL THEN 'knowledge_profile_automation_invalid' END,
  CASE WHEN NOT (list_contains(required, 'type') AND kinds[list_position(fields, 'type')] = 'string') THEN 'knowledge_profile_type_field_required' END,
  {', '.join(f"CASE WHEN NOT list_contains(fields, '{b}') THEN 'knowledge_profile_base_field_missing:{b}' END" for b in profiles.BASE_FIELDS)},
  CASE WHEN len(types) = 0 THEN 'knowledge_profile_types_required' END],
  list_transform(clarifications, lambda f, i: CASE WHEN list_contains(clarifications[1:i - 1], f) THEN 'knowledge_profile_clarification_field_duplicate:' || f
    WHEN NOT list_contains(fields, f) THEN 'knowledge_profile_clarification_field_unknown:' || f WHEN f IN ({_UNASKABLE}) THEN 'knowledge_profile_clarification_field_prohibited:' || f
    WHEN kinds[list_position(fields, f)] NOT IN ('date', 'number', 'string', 'string_array') THEN 'knowledge_profile_clarification_field_type_unsupported:' || f END)), [
  CASE WHEN len(list_filter(relations, lambda x: NOT regexp_matches(x, '{profiles.RELATION_NAME}'))) > 0 THEN 'knowledge_profile_relation_invalid' END,
  CASE WHEN stopwords IS NULL THEN 'knowledge_profile_relation_discovery_stopwords_invalid'
    WHEN len(list_filter(stopwords, lambda x: NOT coalesce(regexp_matches(x, '{profiles.STOPWORD}'), false))) > 0 THEN 'knowledge_profile_relation_discovery_stopword_invalid' END]), lambda x: x IS NOT NULL), ',') AS errors FROM p"""
)
def profile_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each profile."""
    found = view(spark, sf_dir, _PROFILE, "documents")
    return found.select("profile_id", F.array_join(profiles.profile_errors(), ",").alias("errors"))


_RESOLVED = {
    "topic_id": "doc_id", "pages": "ARRAY_OF(doc_id % 9 + 1, doc_id % 9 + 2)", "resolved": "CASE WHEN doc_id % 4 = 0 THEN ARRAY_OF(doc_id % 9 + 1, doc_id % 9 + 2) ELSE ARRAY_OF(doc_id % 9 + 2, doc_id % 9 + 1, doc_id % 9 + 3, doc_id % 9 + 4) END",
    "proposed": "CASE WHEN doc_id % 3 = 0 THEN ARRAY_OF(doc_id % 9 + 4, doc_id % 9 + 3, doc_id % 9 + 7) ELSE ARRAY_OF(doc_id % 9 + 3) END",
    "review_status": "CASE WHEN doc_id % 8 = 0 THEN 'approved' WHEN doc_id % 8 = 1 THEN 'needs_cleanup' ELSE 'needs_review' END",
    "enrichment_status": "CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'completed' END", "run_id": "CASE WHEN doc_id % 12 = 0 THEN doc_id END", "resolver_version": "CASE WHEN doc_id % 6 = 0 THEN 2 WHEN doc_id % 7 = 0 THEN 1 END",
}


@query(
    f"""WITH {view_sql('t', _RESOLVED, 'documents')},
o AS (SELECT *, list_filter(resolved, lambda x: NOT list_contains(pages, x)) AS promoted FROM t WHERE review_status IN ('needs_review', 'needs_cleanup') AND run_id IS NULL AND resolver_version IS DISTINCT FROM 2),
i AS (SELECT *, enrichment_status = 'completed' AND len(list_filter(promoted, lambda x: NOT list_contains(proposed, x))) > 0 AS invalidated FROM o)
SELECT topic_id, array_to_string(promoted, ',') AS promoted, invalidated, array_to_string(list_sort(list_distinct(resolved)), ',') AS source_pages,
  array_to_string(list_filter(proposed, lambda x: NOT list_contains(resolved, x)), ',') AS still_proposed, list_min(resolved) AS page_start, list_max(resolved) AS page_end,
  CASE WHEN invalidated THEN 'none' ELSE enrichment_status END AS enrichment_status FROM i"""
)
def topic_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that resolved continuations bring to each topic still open."""
    found = profiles.reconciled(view(spark, sf_dir, _RESOLVED, "documents"), 2)
    joined = (F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("promoted", "source_pages", "still_proposed"))
    return found.select("topic_id", "invalidated", "page_start", "page_end", "enrichment_status", *joined)


_LINES = "chr(10) || 'relations:' || chr(10) || '  - relation: \"references\"' || chr(10) || '    target: \"x.md\"' || chr(10) || '  - relation: \"supports\"'"
_MARKED = {
    "doc_id": "doc_id", "lang": "lang", "source": "source",
    "markdown": f"CASE WHEN doc_id % 10 = 0 THEN text WHEN doc_id % 3 = 0 THEN '---' || chr(10) || 'title: a' || {_LINES} || chr(10) || 'updated: 2001-01-01' || chr(10) || '---' || chr(10) || text ELSE '---' || chr(10) || 'updated: 2002-02-02' || {_LINES} || chr(10) || '---' || chr(10) || text END",
}
_BLOCK = (
    "CASE WHEN doc_id % 4 = 0 THEN '' ELSE chr(10) || 'relations:' || chr(10) || '  - relation: \"' || 'references' || '\"' || chr(10) || '    target: \"' || source || '\"' "
    "|| CASE WHEN lang = 'en' THEN chr(10) || '    target_type: \"en\"' ELSE '' END || chr(10) || '    reason: \"said \\\"so\\\"\"' END"
)


@query(
    f"""WITH {view_sql('d', _MARKED, 'documents')}
SELECT doc_id, CASE WHEN markdown[1:4] = '---' || chr(10) THEN '---' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'title: a' || chr(10) ELSE '' END || 'updated: 2026-01-02' || {_BLOCK}
  || chr(10) || '---' || substr(markdown, length(CASE WHEN doc_id % 3 = 0 THEN '---' || chr(10) || 'title: a' || {_LINES} || chr(10) || 'updated: 2001-01-01' || chr(10) || '---' ELSE '---' || chr(10) || 'updated: 2002-02-02' || {_LINES} || chr(10) || '---' END) + 1) END AS markdown FROM d"""
)
def relations_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its frontmatter's relations replaced by the survivors."""
    found = view(spark, sf_dir, _MARKED, "documents")
    survivor = F.struct(F.lit("references").alias("relation"), F.col("source").alias("target"), F.when(F.col("lang") == "en", F.col("lang")).alias("target_type"), F.lit('said "so"').alias("reason"))
    relations = F.when(F.col("doc_id") % 4 != 0, F.array(survivor)).otherwise(F.array())
    return found.select("doc_id", profiles.with_relations(F.col("markdown"), relations, F.lit("2026-01-02T03:04:05Z")).alias("markdown"))


@query(
    """SELECT doc_id, regexp_matches(lower(coalesce(text, '')), '(^|[^a-z0-9])' || lower(regexp_escape(entity)) || '([^a-z0-9]|$)') AS held
FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'c++ (x)' ELSE lang END AS entity FROM documents) d"""
)
def entity_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each text names its entity."""
    found = view(spark, sf_dir, {"doc_id": "doc_id", "text": "coalesce(text, '')", "entity": "CASE WHEN doc_id % 3 = 0 THEN 'c++ (x)' ELSE lang END"}, "documents")
    return found.select("doc_id", profiles.contains_entity(F.col("text"), F.col("entity")).alias("held"))
