"""Queries over articles and their upkeep; documents stand for articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import articles
from tessera.plans.base import query, table, view, view_sql
from tessera.plans.review import _PAGE, _T, _TOPIC

_ARTICLE = {
    "path": "doc_id", "title": "CASE WHEN doc_id % 5 = 0 THEN 'Other' ELSE 'Topic A' END",
    "body": "CASE WHEN doc_id % 3 = 0 THEN chr(10) || '# TOPIC A' || chr(10) || chr(10) || '# Topic A' || chr(10) ELSE '' END || 'Some text' || chr(10) || '## Part' || chr(10) || 'more ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '## Source' || chr(10) || 'a file' || chr(10) ELSE '' END",
}


@query(f"""WITH {view_sql("a", _ARTICLE, "documents")}, b AS (SELECT path, body, 'Some text' || chr(10) || '## Part' || chr(10) || 'more ' || path AS core,
  CASE WHEN path % 3 = 0 AND title = 'Other' THEN '# TOPIC A' || chr(10) || chr(10) || '# Topic A' || chr(10) ELSE '' END AS head FROM a)
SELECT path, sha256(body) AS before, sha256(head || core) AS after, sha256(body) <> sha256(head || core) AS changed FROM b""")
def article_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of every article before and after its body is normalised."""
    return articles.repair_report(view(spark, sf_dir, _ARTICLE, "documents"))


_STAGE = {"doc_id": "doc_id", **{f"s{i}": f"CASE CAST(floor(doc_id / {i + 1}) AS BIGINT) % {5 + i} WHEN 0 THEN 'failed' WHEN 1 THEN 'running' WHEN 2 THEN 'skipped' WHEN 3 THEN 'action_required' ELSE 'completed' END" for i in range(3)}}


@query(
    f"""WITH {view_sql("s", _STAGE, "documents")}, l AS (SELECT doc_id, [s0, s1, s2] AS x FROM s)
SELECT doc_id, coalesce(list_filter(['upload', 'extraction', 'review'], lambda n, i: x[i] IN ('failed', 'action_required', 'running', 'queued'))[1], 'review') AS current,
CASE WHEN list_contains(x, 'failed') THEN 'failed' WHEN list_contains(x, 'action_required') THEN 'attention' WHEN list_contains(x, 'running') THEN 'active' ELSE 'success' END AS tone, NOT list_contains(x, 'running') AS terminal FROM l"""
)
def stage_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current stage, tone and end of every document's processing."""
    names = ("upload", "extraction", "review")
    stages = F.array(*(F.struct(F.lit(n).alias("id"), F.col(f"s{i}").alias("status")) for i, n in enumerate(names)))
    current, tone, terminal = articles.stage_header(F.col("stages"))
    return view(spark, sf_dir, _STAGE, "documents").withColumn("stages", stages).select("doc_id", current.alias("current"), tone.alias("tone"), terminal.alias("terminal"))


_CHOICE = {
    "doc_id": "doc_id", "title": "substr(text, 1, 9)", "summary": "substr(text, 10, 9)", "enriched_title": "CASE WHEN doc_id % 4 <> 0 THEN substr(text, 20, 9) END", "enriched_summary": "CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'E' END",
    "review_status": "CASE WHEN doc_id % 9 = 0 THEN 'approved' ELSE 'needs_review' END", "choice": "CASE WHEN doc_id % 2 = 0 THEN 'raw' ELSE 'enriched' END",
}


@query(
    f"""WITH {view_sql("c", _CHOICE, "documents")}, e AS (SELECT *, CASE WHEN review_status = 'approved' THEN 'topic_already_approved' WHEN choice = 'enriched' AND (coalesce(enriched_title, '') = '' OR enriched_summary = '') THEN 'topic_enrichment_required_for_approval' END AS error FROM c)
SELECT doc_id, CASE WHEN error IS NULL THEN CASE WHEN choice = 'enriched' THEN enriched_title ELSE title END END AS title, CASE WHEN error IS NULL THEN CASE WHEN choice = 'enriched' THEN enriched_summary ELSE summary END END AS summary, error FROM e"""
)
def approved_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every topic is approved with, or why it is not."""
    title, summary, error = articles.approved_content(F.col("choice"))
    return view(spark, sf_dir, _CHOICE, "documents").select("doc_id", title.alias("title"), summary.alias("summary"), error.alias("error"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END || ',' || source AS metadata FROM documents")
def answerable_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata of every document that a clarification may ask for."""
    held = F.create_map(F.lit("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(""), F.lit("source"), "source", F.lit("revision"), F.lit("r1"), F.lit("other"), F.lit("x"))
    kept = articles.answerable(held, ("lang", "source", "revision"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.map_values(kept), ",").alias("metadata"))


@query("""WITH f AS (SELECT CAST(floor(doc_id / 6) AS BIGINT) AS query_id, doc_id % 4 AS key, doc_id % 6 AS rank, CASE WHEN doc_id % 6 < 3 THEN 0 ELSE 1 END AS t FROM documents),
o AS (SELECT query_id, key, min(t * 100 + rank) AS met FROM f GROUP BY query_id, key)
SELECT query_id, key, met >= 100 AS added, CAST(row_number() OVER (PARTITION BY query_id ORDER BY met, key) AS INTEGER) AS rank FROM o QUALIFY rank <= 3""")
def retry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of two tries of every query, merged."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select(F.floor(F.col("doc_id") / 6).alias("query_id"), (F.col("doc_id") % 4).alias("key"), (F.col("doc_id") % 6).alias("rank"))
    return articles.merged_retry(found.filter("rank < 3"), found.filter("rank >= 3"), 3)


@query("""SELECT doc_id FROM documents WHERE doc_id % 3 = 0""")
def changed_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that changed after their revision was confirmed."""
    docs = table(spark, sf_dir, "documents")
    confirmed = docs.select("doc_id", articles.fingerprint("doc_id", "source", "n_chars").alias("fingerprint"))
    now = docs.withColumn("n_chars", F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return articles.changed_since(now, confirmed, "doc_id", ("doc_id", "source", "n_chars"))


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND (contains(lower(substr(text, 1, 40)), 'an') OR contains(lower(source), 'an') OR lang = 'an')")
def document_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready documents whose title or tags hold the asked text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 40).alias("title"), F.array("source", "lang").alias("tags"), F.when(F.col("doc_id") % 2 == 0, "ready").otherwise("new").alias("status"))
    return articles.library(docs, "ready", " AN ").select("doc_id")


@query("""WITH f AS (SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN ' ' WHEN doc_id % 5 = 0 THEN 'odd' ELSE lang END AS type, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS family FROM documents),
e AS (SELECT path, concat_ws(',', CASE WHEN trim(type) = '' THEN 'type_required' END, CASE WHEN trim(type) <> '' AND type NOT IN ('en', 'fr', 'de') THEN 'type_not_allowed' END, CASE WHEN family IS NULL THEN 'missing_family' END) AS errors FROM f)
SELECT path, errors FROM e WHERE errors <> ''""")
def profile_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a new profile would not allow."""
    kind = F.when(F.col("doc_id") % 7 == 0, " ").when(F.col("doc_id") % 5 == 0, "odd").otherwise(F.col("lang"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), kind.alias("type"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("family"))
    return articles.profile_errors(files, ("en", "fr", "de"), ("family",)).select("path", F.array_join("errors", ",").alias("errors"))


@query("""SELECT doc_id AS session_id, CASE WHEN doc_id % 3 = 0 THEN 'b1,b2' ELSE 'b' || (doc_id % 2) END AS bundles, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM documents""")
def scope_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions after every third scope is set anew; one of four is set to what it is."""
    docs = table(spark, sf_dir, "documents")
    held = docs.select(F.col("doc_id").alias("session_id"), F.array(F.concat(F.lit("b"), F.col("doc_id") % 2)).alias("bundles"), F.lit(1).cast("long").alias("version"))
    new = held.filter("session_id % 3 = 0").select("session_id", F.array(F.lit("b1"), F.lit("b2"), F.lit("b1")).alias("bundles"))
    same = held.filter("session_id % 4 = 0 AND session_id % 3 <> 0").select("session_id", "bundles")
    return articles.replaced_scope(held, new.unionByName(same)).withColumn("bundles", F.array_join("bundles", ","))


@query("SELECT doc_id, CASE WHEN doc_id % 50 < 20 THEN 'new/c' || (doc_id % 50) ELSE 'c' || (doc_id % 50) END AS path FROM documents")
def path_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of files that were moved."""
    n = F.col("doc_id") % 50
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("c"), n).alias("path"))
    moves = table(spark, sf_dir, "documents").filter(n < 20).select(F.concat(F.lit("c"), n).alias("old"), F.concat(F.lit("new/c"), n).alias("new")).distinct()
    return articles.moved_paths(rows, moves, "path")


@query(
    f"""WITH {_T}, {view_sql("p", _PAGE, "documents")}, u AS (SELECT DISTINCT topic_id, document_id, unnest(pages) AS page FROM t WHERE confidence <> 'low'),
k AS (SELECT u.document_id, topic_id, CAST(ceil((sum(length(text)) + count(*) - 1) / 4) AS BIGINT) AS tokens FROM u JOIN p USING (document_id, page) GROUP BY u.document_id, topic_id)
SELECT document_id, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS topics FROM k GROUP BY document_id"""
)
def enrichment_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of enriching every document's topics of some confidence."""
    topics = view(spark, sf_dir, _TOPIC, "documents").filter("confidence <> 'low'")
    return articles.page_estimates(topics, view(spark, sf_dir, _PAGE, "documents"))


@query("SELECT source AS bundle_id, max(doc_id % 17) AS version, CAST(sum(CAST(ceil(n_chars / 4) AS BIGINT)) AS BIGINT) AS tokens FROM documents GROUP BY source")
def profile_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest profile version of every bundle and the token estimate of its index jobs."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.col("source").alias("bundle_id")).agg(F.max(F.col("doc_id") % 17).alias("version"), F.sum(F.ceil(F.col("n_chars") / 4)).cast("long").alias("tokens"))
