"""Bundle queries over stand-in tables, and the streaming query."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import slug
from tessera.lineage import shared_dir
from tessera.plans.base import query, table, view, view_sql
from tessera.sources import bundles
from tessera.streaming import jobs


@query(
    """WITH d AS (SELECT doc_id, 'C ' || (doc_id % 50) AS code, trim(regexp_replace(substr(split_part(text, chr(10), 1), 1, 60), '[^A-Za-z0-9 ]', '', 'g')) AS title, lang, source FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(lower(code), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '-' || substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 80)
  || '-' || substr(sha256(doc_id::VARCHAR), 1, 10) || '.md' AS file_name,
 sha256('---' || chr(10) || 'type: ' || lang || chr(10) || 'title: "' || title || '"' || chr(10) || 'classification_code: ' || code || chr(10) || 'source_file: ' || source || chr(10) || 'source_pages:' || chr(10)
 || '  - ' || (doc_id % 9 + 1) || chr(10) || '  - ' || (doc_id % 9 + 2) || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || 'Body.' || chr(10) || chr(10) || '## Source' || chr(10) || chr(10)
 || '- ' || source || ', pages ' || (doc_id % 9 + 1) || ', ' || (doc_id % 9 + 2) || chr(10)) AS markdown_sha256 FROM d"""
)
def concept_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File name and content hash of every document exported as a concept."""
    i = F.col("doc_id")
    title = F.trim(F.regexp_replace(F.left(F.get(F.split("text", "\n"), 0), F.lit(60)), "[^A-Za-z0-9 ]", ""))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("C "), i % 50).alias("code"), title.alias("title"), "lang", "source")
    text = bundles.concept_markdown(F.col("code"), F.col("title"), F.col("lang"), F.lit("Body."), F.col("source"), F.array(i % 9 + 1, i % 9 + 2))
    return d.select("doc_id", bundles.concept_file_name(F.col("code"), F.col("title"), i).alias("file_name"), F.sha2(text, 256).alias("markdown_sha256"))


@query(
    """SELECT event_id, array_to_string(list_slice(list_filter(list_transform(string_split(props, ','), lambda x: trim(x)), lambda x: x <> ''), 1, 12), '|') AS tags FROM events"""
)
def tag_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-separated parts of a property string as tags."""
    return table(spark, sf_dir, "events").select("event_id", F.array_join(bundles.tags_of(F.col("props")), "|").alias("tags"))


@query(
    """WITH c AS (SELECT source AS bundle, doc_id AS path, 'v1 ' || doc_id AS line FROM documents WHERE doc_id % 2 = 0), n AS (SELECT source AS bundle, doc_id AS path, 'v2 ' || doc_id AS line FROM documents WHERE doc_id % 3 = 0),
u AS (SELECT * FROM c WHERE path NOT IN (SELECT path FROM n) UNION ALL SELECT * FROM n) SELECT bundle, sha256(string_agg(line, chr(10) ORDER BY path)) AS text_sha256, count(*) AS n_lines FROM u GROUP BY bundle"""
)
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of every bundle after lines are replaced by key."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("bundle"), F.col("doc_id").alias("path"))
    v1 = docs.filter("path % 2 = 0").withColumn("line", F.concat(F.lit("v1 "), "path"))
    v2 = docs.filter("path % 3 = 0").withColumn("line", F.concat(F.lit("v2 "), "path"))
    made = bundles.index_lines(v1, v2)
    return made.select("bundle", F.sha2("text", 256).alias("text_sha256"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


_META = {
    "doc_id": "doc_id", "path": "CASE WHEN doc_id % 97 = 0 THEN 'log.md' ELSE 'c' || doc_id || '.md' END", "type": "CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'Odd Type' ELSE ' fault_route ' END",
    "title": "CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE lang END", "description": "CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE source END",
    "tags": "CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN ARRAY_OF('a', ' ') ELSE ARRAY_OF('a', 'b') END",
    "updated": "CASE doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '2024-02-30' WHEN 2 THEN '2024-2-3' WHEN 3 THEN '' ELSE '2024-02-29' END",
    "review_status": "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'rejected' ELSE 'approved' END", "source_file": "CASE WHEN doc_id % 13 = 0 THEN ' ' WHEN doc_id % 4 = 0 THEN NULL ELSE source END",
    "source_pages": "CASE doc_id % 12 WHEN 0 THEN NULL WHEN 1 THEN ARRAY_OF('0') WHEN 2 THEN ARRAY_OF('1.5') WHEN 3 THEN ARRAY_OF('x') WHEN 4 THEN ARRAY_OF('3', '4.0') ELSE ARRAY_OF('3', '4') END", "body": "text",
}


@query(
    f"""WITH {view_sql("c", _META, "documents")}, e AS (SELECT *, list_filter([CASE WHEN doc_id % 7 = 1 THEN 'generic_okf_tags_invalid' END, CASE WHEN doc_id % 9 < 2 THEN 'generic_okf_type_required' END, CASE WHEN doc_id % 9 = 2 THEN 'generic_okf_type_invalid' END, CASE WHEN doc_id % 8 = 1 THEN 'generic_okf_title_invalid' END,
  CASE WHEN doc_id % 11 = 0 THEN 'generic_okf_description_invalid' END, CASE WHEN doc_id % 10 IN (1, 2) THEN 'generic_okf_updated_invalid' END], lambda x: x IS NOT NULL) AS errors FROM c),
r AS (SELECT *, len(errors) = 0 AND doc_id % 4 > 1 AND doc_id % 8 > 0 AND coalesce(lang_ok, false) AND trim(coalesce(body, '')) <> '' AND doc_id % 13 > 0 AND doc_id % 12 >= 4 AS ready FROM (SELECT *, coalesce(title, '') <> '' AS lang_ok FROM e))
SELECT doc_id, array_to_string(errors, ',') AS errors, ready AS agent_ready, CASE WHEN doc_id % 97 = 0 THEN 'reserved' WHEN len(errors) > 0 THEN 'invalid_generic' WHEN ready THEN 'agent_ready'
  WHEN review_status IS NOT NULL OR source_file IS NOT NULL OR source_pages IS NOT NULL THEN 'missing_trust_metadata' ELSE 'generic_valid' END AS trust FROM r"""
)
def metadata_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of every concept's metadata, whether an agent may use it, and what trust it has."""
    checked = bundles.validation_errors(view(spark, sf_dir, _META, "documents"), keep=("doc_id",))
    return checked.withColumn("errors", F.array_join("errors", ","))


_HEAD = """okf_version: '0.1'|base:|  name: "The \\\\"@\\\\" \\\\\\\\ set"|  roots:|  - path: .|    exclude_patterns:|    - '**/.DS_Store'|    - '**/README.md'|  reserved_files:|    index: index.md|    log: log.md|  status_field: review_status
|  link_resolution:|    external_refs:|    - source_manifest.md|relations:|  allowed:|  - supports|  - routes_to|profile:|  date_fields:|  - updated|  - approved_at|  - deprecated_at|  types:""".replace("\n", "").replace("'", "''").replace("\\\\", "\\")
_TYPED = """|      required:|      - type|      - title|      - grade|      optional:|      - description|      - tags|      - updated|      - approved_at|      - approved_by|      - review_status|      - source_file|      - source_pages
|      - source_authority|      - knowledge_version|      - relations|      - classification_code|      - coverage_type|      - covered_rag_chunk_ids|      - document_type|      - effectivity|      - revision|      - subject_family|      - site
|      status_values:|      - raw_extracted|      - needs_ai_cleanup|      - needs_human_review|      - approved|      - rejected|      - deprecated""".replace("\n", "")
_TAIL = "|hygiene:|  broken_links: error|  split_candidates: warn|  reserved_files: error|  unknown_fields: error|"


@query(
    f"""WITH t AS (SELECT DISTINCT source, lang AS type FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL UNION SELECT DISTINCT source, 'source_manifest' FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)
SELECT source AS bundle_id, replace(replace('{_HEAD}', '@', source) || string_agg('|    ' || type || ':{_TYPED}', '' ORDER BY type) || '{_TAIL}', '|', chr(10)) AS manifest FROM t GROUP BY source"""
)
def bundle_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of every source's profile, whose types are its languages."""
    field = lambda name, required: F.struct(F.lit(name).alias("name"), F.lit(required).alias("required"))
    held = table(spark, sf_dir, "documents").filter("source is not null and lang is not null").groupBy(F.col("source").alias("bundle_id")).agg(F.collect_set("lang").alias("types"))
    name = F.concat(F.lit('The "'), "bundle_id", F.lit('" \\ set'))
    relations = F.array(F.lit("supports"), F.lit("routes_to"))
    return bundles.manifest_text(held.withColumns({"name": name, "relations": relations, "fields": F.array(field("title", True), field("grade", True), field("site", False))}))


@query("SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 64) AS slug FROM part")
def bundle_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slug of every name."""
    return table(spark, sf_dir, "part").select("p_partkey", slug(F.col("p_name"), 64).alias("slug"))


@query("SELECT count(DISTINCT event_id) AS n_jobs, count(DISTINCT user_id) AS n_users FROM events")
def stream_dedupe_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of the event stream after deduplication, counted from what the stream wrote."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = jobs.distinct_jobs(jobs.read_events(spark, f"{sf_dir}/events.p*"), late="30 days").select("event_id", "user_id")
    jobs.run_to_end(stream, f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").agg(F.count(F.lit(1)).alias("n_jobs"), F.count_distinct("user_id").alias("n_users"))
