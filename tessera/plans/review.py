"""Queries over topics in review; documents stand for topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import review
from tessera.plans.base import query, table, view, view_sql

_TOPIC = {
    "topic_id": "doc_id", "document_id": "CAST(floor(doc_id / 5) AS BIGINT)",
    "title": "CASE WHEN doc_id % 11 = 0 THEN '  ' WHEN doc_id % 17 = 0 THEN 'Page 3' WHEN doc_id % 4 = 0 THEN '- ' || substr(text, 1, 12) || ':' ELSE substr(text, 1, 30) END",
    "summary": "CASE WHEN doc_id % 13 = 0 THEN '' ELSE substr(text, 31, 40) END", "body": "CASE WHEN doc_id % 19 = 0 THEN NULL ELSE substr(text, 71, 60) END",
    "pages": "CASE WHEN doc_id % 23 = 0 THEN ARRAY_OF() ELSE ARRAY_OF(doc_id % 5 + 1, doc_id % 5 + 2, doc_id % 5 + 1) END",
    "proposed": "CASE WHEN doc_id % 7 = 0 THEN ARRAY_OF(doc_id % 5 + 4, doc_id % 5 + 1, doc_id % 5 + 3) ELSE ARRAY_OF() END",
    "review_status": "CASE WHEN doc_id % 9 = 0 THEN 'approved' WHEN doc_id % 10 = 0 THEN 'rejected' WHEN doc_id % 12 = 0 THEN 'needs_cleanup' ELSE 'needs_review' END",
    "enrichment_status": "CASE WHEN doc_id % 8 = 0 THEN 'failed' WHEN doc_id % 14 = 0 THEN 'none' ELSE 'completed' END",
    "confidence": "CASE WHEN doc_id % 6 = 0 THEN 'low' WHEN doc_id % 16 = 1 THEN 'medium' ELSE 'high' END",
    "type": "CASE WHEN doc_id % 21 = 0 THEN 'odd' ELSE lang END", "family": "CASE WHEN doc_id % 15 = 0 THEN '' ELSE source END", "run_id": "CASE WHEN doc_id % 25 = 0 THEN doc_id END",
}
_TYPES = ("en", "fr", "de", "es")
_T = view_sql("t", _TOPIC, "documents")
_BLANK = "({0} IS NULL OR NOT regexp_matches({0}, '\\S'))"
_COMPACT = "list_filter([{}], lambda x: x IS NOT NULL)"


def _codes(**checks: str) -> str:
    return _COMPACT.format(", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in checks.items()))


_ELIGIBLE = f"""list_concat(list_concat({_codes(
    topic_already_approved="review_status = 'approved'", topic_rejected="review_status = 'rejected'", topic_enrichment_not_completed="enrichment_status <> 'completed'",
    topic_enriched_title_required=_BLANK.format("title"), topic_enriched_summary_required=_BLANK.format("summary"), topic_enriched_body_required=_BLANK.format("body"),
    topic_source_pages_required="len(pages) = 0", topic_proposed_pages_require_review="len(proposed) > 0")},
  {_COMPACT.format("CASE WHEN type NOT IN ('en', 'fr', 'de', 'es') THEN 'knowledge_profile_type_not_allowed:' || type END, CASE WHEN coalesce(family, '') = '' THEN 'knowledge_profile_required_field_missing:family' END")}),
  {_codes(bulk_topic_already_processed="run_id IS NOT NULL")})"""


@query(f"WITH {_T} SELECT topic_id, array_to_string({_ELIGIBLE}, ',') AS errors FROM t")
def topic_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each topic cannot be approved."""
    topics = view(spark, sf_dir, _TOPIC, "documents")
    return topics.select("topic_id", F.array_join(review.eligibility_codes(_TYPES, ("family",)), ",").alias("errors"))


@query(
    f"""WITH {_T}, e AS (SELECT *, list_concat({_ELIGIBLE}, {_codes(automatic_topic_requires_needs_review="review_status <> 'needs_review'", automatic_topic_requires_high_confidence="confidence <> 'high'")}) AS errors FROM t),
able AS (SELECT DISTINCT document_id, topic_id, unnest(pages) AS page FROM e WHERE len(errors) = 0), prior AS (SELECT DISTINCT document_id, topic_id, unnest(pages) AS page FROM t WHERE review_status = 'approved'),
x AS (SELECT DISTINCT a.topic_id, 'bulk_topic_page_overlap:' || a.topic_id || ':' || b.topic_id AS code FROM able a JOIN able b ON a.document_id = b.document_id AND a.page = b.page AND a.topic_id <> b.topic_id
  UNION SELECT a.topic_id, 'bulk_topic_overlaps_approved:' || a.topic_id || ':' || b.topic_id FROM able a JOIN prior b ON a.document_id = b.document_id AND a.page = b.page),
g AS (SELECT topic_id, list(code ORDER BY code) AS codes FROM x GROUP BY topic_id)
SELECT topic_id, array_to_string(list_concat(errors, coalesce(codes, [])), ',') AS blockers FROM e LEFT JOIN g USING (topic_id)"""
)
def automatic_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps each topic from automatic approval."""
    found = review.automatic_blockers(view(spark, sf_dir, _TOPIC, "documents"), _TYPES, ("family",))
    return found.select("topic_id", F.array_join("blockers", ",").alias("blockers"))


@query(
    f"""WITH {_T} SELECT topic_id, array_to_string({_codes(title_required=_BLANK.format("title"), summary_required=_BLANK.format("summary"), source_pages_required="len(pages) = 0",
    enrichment_failed="enrichment_status = 'failed'", proposed_source_pages_require_review="len(proposed) > 0")}, ',') AS errors FROM t"""
)
def authoring_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each authored topic lacks."""
    return view(spark, sf_dir, _TOPIC, "documents").select("topic_id", F.array_join(review.authoring_errors(), ",").alias("errors"))


@query("""SELECT source, count(*) AS concepts, CAST(sum(CAST(ceil(n_chars / 4) AS BIGINT)) AS BIGINT) AS tokens FROM documents
GROUP BY source HAVING count(*) > 25 OR sum(ceil(n_chars / 4)) > 250000""")
def costly_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose authoring needs a confirmation."""
    docs = table(spark, sf_dir, "documents").select("source", F.ceil(F.col("n_chars") / 4).alias("n"))
    return review.costly_runs(docs, "source", "n")


_FAILURE = {
    "doc_id": "doc_id", "code": "CASE doc_id % 4 WHEN 0 THEN 'topic_rejected' WHEN 1 THEN 'timeout' WHEN 2 THEN 'bulk_topic_overlaps_approved' END",
    "message": "CASE doc_id % 6 WHEN 0 THEN 'No PASSWORD given' WHEN 1 THEN 'bad XRef table' WHEN 2 THEN 'document_has_no_stored_pdf' WHEN 3 THEN 'Invalid header' WHEN 4 THEN NULL ELSE 'other' END",
    "class": "CASE doc_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' A-1 ' WHEN 2 THEN repeat('x', 65) WHEN 3 THEN NULL ELSE 'B' END",
    "confidence": "CASE WHEN doc_id % 3 = 0 THEN 'low' ELSE 'high' END", "size": "CASE WHEN doc_id % 7 = 0 THEN 26214401 WHEN doc_id % 8 = 0 THEN 0 ELSE n_chars END",
    "name": "CASE WHEN doc_id % 9 = 0 THEN 'a.txt' ELSE 'a.PDF' END", "kind": "CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 'application/pdf' END", "head": "CASE WHEN doc_id % 11 = 0 THEN 'PK' ELSE '%PDF-' END",
}


@query(
    f"""WITH {view_sql("f", _FAILURE, "documents")} SELECT doc_id, coalesce(code, '') NOT IN ('bulk_topic_already_processed', 'bulk_topic_changed_since_confirmation', 'bulk_topic_overlaps_approved', 'topic_already_approved', 'topic_rejected') AS retryable,
CASE WHEN lower(message) LIKE '%password%' THEN 'password_protected_pdf' WHEN regexp_matches(lower(message), 'malformed|invalid|corrupt|xref|trailer') THEN 'malformed_pdf'
  WHEN lower(message) LIKE '%document_has_no_stored_pdf%' THEN 'missing_stored_pdf' ELSE 'extraction_failed' END AS failure,
CASE WHEN length(trim(class)) BETWEEN 1 AND 64 THEN trim(class) END AS class, CASE WHEN length(trim(class)) > 64 THEN 'classification_code_too_long' END AS class_error,
CASE WHEN confidence = 'low' THEN 'needs_cleanup' ELSE 'needs_review' END AS review_status,
array_to_string({_codes(pdf_name_required="name = 'a.txt'", pdf_type_required="kind IS NULL", pdf_empty="size = 0", pdf_too_large="size > 26214400", pdf_magic_missing="head <> '%PDF-'")}, ',') AS upload FROM f"""
)
def document_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retry, extraction, classification, first review and upload checks of every document."""
    code, error = review.classification_code(F.col("class"))
    c = F.col
    return view(spark, sf_dir, _FAILURE, "documents").select(
        "doc_id", review.retryable(c("code")).alias("retryable"), review.extraction_code(c("message")).alias("failure"), code.alias("class"), error.alias("class_error"),
        review.initial_review(c("confidence")).alias("review_status"), F.array_join(review.upload_errors(c("name"), c("kind"), c("size"), c("head")), ",").alias("upload"),
    )


_PAGE = {"document_id": "CAST(floor(doc_id / 5) AS BIGINT)", "page": "doc_id % 5 + 1", "text": "CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 7 = 0 THEN repeat(' ', 900) || text ELSE text END"}
_CLEAN = r"regexp_replace(trim(regexp_replace(regexp_replace(title, '^[-•*\s]+', ''), '\s+', ' ', 'g')), '[,:;]$', '')"


@query(
    rf"""WITH {_T}, {view_sql("p", _PAGE, "documents")}, k AS (SELECT topic_id, document_id, {_CLEAN} AS title, pages FROM t WHERE NOT {_BLANK.format("summary")}),
j AS (SELECT * FROM k WHERE length(title) BETWEEN 4 AND 140 AND NOT regexp_matches(title, '^\d+([./-]\d+)*$') AND NOT regexp_matches(title, '(?i)^(page|figure|table)\s+\d+')
  AND NOT regexp_matches(title, '(?i)^(warning|caution|note)\s*:') AND NOT regexp_matches(title, '^[a-z]') AND NOT regexp_matches(title, '[.!?]$') AND len(string_split(title, ' ')) <= 18),
u AS (SELECT DISTINCT topic_id, document_id, title, unnest(pages) AS page FROM j), v AS (SELECT u.document_id, u.topic_id, any_value(u.title) AS title, list(page ORDER BY page) AS pages FROM u JOIN p USING (document_id, page) GROUP BY u.document_id, u.topic_id),
w AS (SELECT *, row_number() OVER (PARTITION BY document_id, lower(title) ORDER BY topic_id) AS nth FROM v)
SELECT document_id, topic_id, title, array_to_string(pages, ',') AS pages, CAST(row_number() OVER (PARTITION BY document_id ORDER BY pages[1], title, topic_id) AS INTEGER) AS position FROM w WHERE nth = 1"""
)
def discovered_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid discovered topics of every document in order."""
    found = review.discovered_topics(view(spark, sf_dir, _TOPIC, "documents"), view(spark, sf_dir, _PAGE, "documents"))
    return found.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query(
    rf"""WITH {_T}, {view_sql("p", _PAGE, "documents")}, u AS (SELECT DISTINCT topic_id, document_id, unnest(pages) AS page FROM t),
j AS (SELECT topic_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY page), '\s+', ' ', 'g')) AS s FROM u JOIN p USING (document_id, page) GROUP BY topic_id)
SELECT t.topic_id, CASE WHEN coalesce(s, '') = '' THEN 'No selectable text was available for this topic.' WHEN length(s) <= 180 THEN s ELSE trim(substr(s, 1, 177)) || '...' END AS summary,
array_to_string(list_sort(list_filter(list_distinct(proposed), lambda x: x BETWEEN 1 AND 5 AND NOT list_contains(pages, x))), ',') AS proposed FROM t LEFT JOIN j ON j.topic_id = t.topic_id"""
)
def topic_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of every topic's pages and its cleaned proposed pages."""
    topics = view(spark, sf_dir, _TOPIC, "documents")
    clean = review.proposed_pages(F.col("proposed"), F.array(*(F.lit(i).cast("long") for i in range(1, 6))), F.col("pages"))
    cleaned = topics.select("topic_id", F.array_join(clean.cast("array<string>"), ",").alias("proposed"))
    return review.topic_summaries(topics, view(spark, sf_dir, _PAGE, "documents")).join(cleaned, "topic_id")


_ALONE = {**_TOPIC, "document_id": "doc_id"}


@query(
    rf"""WITH {view_sql("t", _ALONE, "documents")}, k AS (SELECT document_id, {_CLEAN} AS title FROM t WHERE NOT {_BLANK.format("summary")} AND len(pages) > 0),
j AS (SELECT document_id FROM k WHERE length(title) BETWEEN 4 AND 140 AND NOT regexp_matches(title, '^\d+([./-]\d+)*$') AND NOT regexp_matches(title, '(?i)^(page|figure|table)\s+\d+')
  AND NOT regexp_matches(title, '(?i)^(warning|caution|note)\s*:') AND NOT regexp_matches(title, '^[a-z]') AND NOT regexp_matches(title, '[.!?]$') AND len(string_split(title, ' ')) <= 18)
SELECT DISTINCT document_id, 'topic_discovery_no_valid_topics' AS error FROM t WHERE document_id NOT IN (SELECT document_id FROM j)"""
)
def discovery_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one proposed topic each whose topic is not valid."""
    pages = view(spark, sf_dir, {"document_id": "doc_id", "page": _PAGE["page"]}, "documents")
    return review.discovery_errors(view(spark, sf_dir, _ALONE, "documents"), pages)


@query(
    f"""WITH {_T}, n AS (SELECT topic_id + 1000000 AS topic_id, document_id, [topic_id % 5 + 2, topic_id % 5 + 7] AS pages, 'needs_review' AS review_status FROM t WHERE document_id % 3 = 0),
a AS (SELECT topic_id, document_id, review_status, pages FROM t WHERE review_status IN ('approved', 'rejected') OR document_id % 3 <> 0
UNION ALL SELECT topic_id, document_id, review_status, pages FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.document_id = n.document_id AND t.review_status IN ('approved', 'rejected') AND list_has_any(t.pages, n.pages)))
SELECT topic_id, document_id, review_status, array_to_string(pages, ',') AS pages FROM a"""
)
def topic_regeneration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics after every third document is discovered anew."""
    topics = view(spark, sf_dir, _TOPIC, "documents").select("topic_id", "document_id", "review_status", F.col("pages").cast("array<long>").alias("pages"))
    place = F.col("topic_id") % 5
    fresh = topics.filter("document_id % 3 = 0").select((F.col("topic_id") + 1000000).alias("topic_id"), "document_id", F.lit("needs_review").alias("review_status"), F.array(place + 2, place + 7).alias("pages"))
    return review.regenerated(topics, fresh).withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query(
    f"""WITH {_T}, b AS (SELECT topic_id, unnest(pages) AS from_page FROM t), d AS (SELECT DISTINCT topic_id, from_page, from_page + 1 AS to_page FROM b)
SELECT topic_id, from_page, to_page, CASE WHEN topic_id % 2 = 0 THEN 'new' ELSE 'old' END AS evidence FROM d"""
)
def boundary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary records of topics, where later ones replace those of every second topic."""
    topics = view(spark, sf_dir, _TOPIC, "documents").select("topic_id", F.explode("pages").alias("from_page"))
    old = topics.distinct().select("topic_id", "from_page", (F.col("from_page") + 1).alias("to_page"), F.lit("old").alias("evidence"))
    return review.merged_boundaries(old, old.filter("topic_id % 2 = 0").withColumn("evidence", F.lit("new")))


@query("""WITH r AS (SELECT DISTINCT doc_id % 500 AS run_id FROM documents), i AS (SELECT doc_id % 500 AS run_id FROM documents WHERE (doc_id % 500) % 3 <> 0)
SELECT run_id FROM r WHERE run_id NOT IN (SELECT run_id FROM i)""")
def orphan_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose items are all deleted."""
    items = table(spark, sf_dir, "documents").select((F.col("doc_id") % 500).alias("run_id"))
    return review.orphan_runs(items.distinct(), items.filter("run_id % 3 <> 0"))


_CHANGE = {"path": "doc_id % 300", "status": "CASE WHEN doc_id % 3 = 0 THEN 'archived' WHEN doc_id % 3 = 1 THEN 'deleting' ELSE 'active' END", "reason": "CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE 'said' END", "changed_at": "doc_id"}


@query(
    f"""WITH {view_sql("c", _CHANGE, "documents")}, h AS (SELECT DISTINCT doc_id % 400 AS path, 'active' AS status FROM documents),
k AS (SELECT path, arg_max(status, changed_at) AS status FROM c WHERE trim(reason) <> '' GROUP BY path)
SELECT h.path, coalesce(k.status, h.status) AS status, coalesce(k.status, h.status) = 'active' AS embedded FROM h LEFT JOIN k ON k.path = h.path UNION SELECT k.path, k.status, false FROM k WHERE k.path NOT IN (SELECT path FROM h)"""
)
def lifecycle_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle rows after changes that need a reason, and which concepts keep their embedding."""
    docs = table(spark, sf_dir, "documents")
    held = docs.select((F.col("doc_id") % 400).alias("path")).distinct().withColumns({"status": F.lit("active"), "reason": F.lit("new"), "changed_at": F.lit(0).cast("long")})
    rows, embedded, _ = review.lifecycle_upsert(held, view(spark, sf_dir, _CHANGE, "documents"), held.select("path"))
    kept = embedded.withColumn("_kept", F.lit(True))
    return rows.join(kept, "path", "left").select("path", "status", F.coalesce("_kept", F.lit(False)).alias("embedded"))
