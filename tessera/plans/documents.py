"""Document queries: tokens, budgets, identity, chunks, repeated lines and sections.

Where pages are needed, twenty consecutive documents stand in for the pages of
one document: document_id = doc_id div 20, page = doc_id mod 20 + 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import chunking, continuation, lifecycle, topics
from tessera.plans.base import query, table

_WS = "[ \\t\\n\\x0B\\f\\r]+"
_WORDS = f"len(list_filter(string_split_regex(text, '{_WS}'), lambda w: w <> ''))"
_PAGES_SQL = "pages_ AS (SELECT doc_id // 20 AS document_id, doc_id % 20 + 1 AS page, text FROM documents)"
_NORMAL = "lower(trim(regexp_replace({0}, '" + _WS + "', ' ', 'g')))"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.floor(F.col("doc_id") / 20).alias("document_id"), (F.col("doc_id") % 20 + 1).alias("page"), "text")


@query(f"SELECT doc_id, greatest(1, CAST(ceil({_WORDS} * 1.35::DOUBLE) AS BIGINT)) AS n_tokens, CAST(ceil(length(text) / 4.0::DOUBLE) AS BIGINT) AS n_quarter FROM documents")
def heuristic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heuristic and character-based token counts of every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.heuristic_tokens(F.col("text")).alias("n_tokens"), tx.quarter_tokens(F.col("text")).alias("n_quarter"))


@query(
    """WITH t AS (SELECT doc_id, source, CAST(ceil(length(text) * 40 / 4.0::DOUBLE) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL),
u AS (SELECT source, sum(n) AS used FROM t WHERE doc_id % 7 = 0 GROUP BY source), g AS (SELECT sum(n) AS used FROM t WHERE doc_id % 7 = 0)
SELECT doc_id, n AS n_tokens, CASE WHEN n > 250000 THEN 'document_budget_exceeded' WHEN coalesce(u.used, 0) + n > 1000000 THEN 'workspace_budget_exceeded'
       WHEN g.used + n > 5000000 THEN 'global_budget_exceeded' ELSE 'ok' END AS verdict
FROM t LEFT JOIN u ON u.source = t.source, g"""
)
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document of forty times the text may be embedded, after every seventh one was: budgets of document, workspace and all."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "source", tx.quarter_tokens(F.repeat("text", F.lit(40))).alias("n_tokens"))
    done = docs.filter("doc_id % 7 = 0")
    used = done.groupBy("source").agg(F.sum("n_tokens").alias("used"))
    total = used.agg(F.sum("used").alias("total"))  # one row
    verdict = lifecycle.budget_verdict(F.col("n_tokens"), F.coalesce("used", F.lit(0)), F.col("total"))
    return docs.join(used, "source", "left").crossJoin(F.broadcast(total)).select("doc_id", "n_tokens", verdict.alias("verdict"))


@query(
    f"""WITH c AS (SELECT source AS job_id, greatest(1, CAST(ceil({_WORDS} * 1.35::DOUBLE) AS BIGINT)) AS n FROM documents WHERE doc_id % 9 <> 0),
r AS (SELECT CASE WHEN doc_id % 50 = 0 THEN 'other' ELSE source END AS job_id, doc_id % 6 AS k FROM documents)
SELECT coalesce(a.job_id, b.job_id) AS job_id, CAST(coalesce(token_estimate, 0) AS BIGINT) AS token_estimate, coalesce(n_chunks, 0) AS n_chunks, CAST(coalesce(synced, 0) AS BIGINT) AS synced, CAST(coalesce(skipped_unchanged, 0) AS BIGINT) AS skipped_unchanged, CAST(coalesce(failed, 0) AS BIGINT) AS failed
FROM (SELECT job_id, sum(n) AS token_estimate, count(*) AS n_chunks FROM c GROUP BY job_id) a FULL JOIN (SELECT job_id, count_if(k IN (0, 1, 2)) AS synced, count_if(k = 3) AS skipped_unchanged, count_if(k = 4) AS failed FROM r GROUP BY job_id) b ON a.job_id = b.job_id"""
)
def index_job_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens and results of every index job; a job for each source."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.filter("doc_id % 9 <> 0").select(F.col("source").alias("job_id"), tx.heuristic_tokens(F.col("text")).alias("tokens"))
    k = F.col("doc_id") % 6
    status = F.when(k < 3, "synced").when(k == 3, "skipped-unchanged").when(k == 4, "failed").otherwise("odd")
    results = docs.select(F.when(F.col("doc_id") % 50 == 0, "other").otherwise(F.col("source")).alias("job_id"), status.alias("status"))
    return lifecycle.job_totals(chunks, results)


@query(
    """SELECT strftime(ts, '%Y-%m-%d') AS day, coalesce(user_id, -1) AS user_id, CAST(round(sum(value), 4) AS DOUBLE) AS n_tokens, count(*) AS n_jobs
FROM events WHERE value > 0 GROUP BY GROUPING SETS ((strftime(ts, '%Y-%m-%d'), user_id), (strftime(ts, '%Y-%m-%d')))"""
)
def daily_token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage a day by user and overall (user -1), from jobs with a positive estimate."""
    events = table(spark, sf_dir, "events").filter("value > 0").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    per = events.groupingSets([["day", "user_id"], ["day"]], "day", "user_id")
    used = per.agg(F.round(F.sum("value"), 4).alias("n_tokens"), F.count(F.lit(1)).alias("n_jobs"))
    return used.withColumn("user_id", F.coalesce("user_id", F.lit(-1)))


@query(
    """WITH c AS (SELECT doc_id, '[Document: ' || source || ' | Section: ' || trim(substr(trim(regexp_replace(trim(substr(split_part(text, chr(10), 1), 1, 120)), '[ \\t\\n]+', ' ', 'g')), 1, 60))
  || ' | Pages: ' || (doc_id % 20 + 1) || ']' || chr(10) || text AS body FROM documents WHERE trim(split_part(text, chr(10), 1)) <> '')
SELECT doc_id, sha256(body) AS content_hash, 'rag_' || doc_id || '_1_' || (doc_id % 20 + 1) || '_0_' || substr(sha256(body), 1, 12) AS chunk_id FROM c"""
)
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash and chunk id of every document as one chunk."""
    docs = table(spark, sf_dir, "documents")
    first = F.trim(F.get(F.split("text", "\n"), 0))
    page = F.col("doc_id") % 20 + 1
    docs = docs.filter(first != "")
    section = F.rtrim(F.left(tx.collapsed(F.left(first, F.lit(120))), F.lit(60)))
    body = chunking.contextual_text(F.col("source"), section, page, page, F.col("text"))
    made = docs.select("doc_id", page.alias("page"), F.sha2(body, 256).alias("content_hash"))
    return made.select("doc_id", "content_hash", F.concat(F.lit("rag_"), "doc_id", F.lit("_1_"), "page", F.lit("_0_"), F.left("content_hash", F.lit(12))).alias("chunk_id"))


@query(
    """WITH p AS (SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text || 'x' ELSE text END) AS before FROM documents WHERE doc_id % 3 < 2)
SELECT d.doc_id, CASE WHEN p.before IS NULL THEN 'new' WHEN p.before = sha256(d.text) THEN 'skipped_unchanged' ELSE 'synced' END AS outcome
FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id"""
)
def changed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the hashes of an earlier sync, in which a third had other text and a third was missing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    earlier = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    before = docs.filter("doc_id % 3 < 2").select("doc_id", F.sha2(earlier, 256).alias("before"))
    outcome = F.when(F.col("before").isNull(), "new").when(F.col("before") == F.col("now"), "skipped_unchanged").otherwise("synced")
    return docs.select("doc_id", F.sha2("text", 256).alias("now")).join(before, "doc_id", "left").select("doc_id", outcome.alias("outcome"))


@query(
    f"""WITH {_PAGES_SQL}, l AS (
  SELECT document_id, page, unnest(list_distinct(list_slice(list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: {_NORMAL.format("x")}),
         lambda x: x <> '' AND length(x) <= 90), 1, 8))) AS line FROM pages_
), n AS (SELECT document_id, least(3, count(*)) AS least FROM pages_ GROUP BY document_id)
SELECT l.document_id, line, count(*) AS n_pages FROM l JOIN n ON n.document_id = l.document_id
GROUP BY l.document_id, line HAVING count(*) >= min(n.least)"""
)
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the first lines of several pages of a document share."""
    return topics.repeated_lines(_pages(spark, sf_dir))


_BOUNDARY_SQL = f"""{_PAGES_SQL}, s AS (
  SELECT document_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: lower(trim(regexp_replace(x, '\\s+', ' ', 'g')))), lambda x: x <> '') AS ls FROM pages_
), l AS (SELECT document_id, unnest(list_concat(list_slice(ls, 1, 3), list_slice(ls, greatest(1, len(ls) - 2), len(ls)))) AS line FROM s),
n AS (SELECT document_id, greatest(3, CAST(ceil(count(*) * 0.3::DOUBLE) AS BIGINT)) AS least FROM pages_ GROUP BY document_id),
b AS (SELECT l.document_id, line, count(*) AS n FROM l JOIN n ON n.document_id = l.document_id GROUP BY l.document_id, line HAVING count(*) >= min(n.least))"""


@query(f"WITH {_BOUNDARY_SQL} SELECT document_id, line, n FROM b")
def boundary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running headers and footers: lines at the edges of many pages."""
    return topics.boundary_lines(_pages(spark, sf_dir))


@query(
    f"""WITH {_BOUNDARY_SQL}, r AS (SELECT document_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS size FROM pages_),
k AS (SELECT document_id, page, line, i FROM r WHERE NOT ((i <= 3 OR i > size - 3) AND EXISTS (SELECT 1 FROM b WHERE b.document_id = r.document_id AND b.line = lower(trim(regexp_replace(r.line, '\\s+', ' ', 'g'))))))
SELECT document_id, page, length(t) AS n_chars, sha256(t) AS text_sha256 FROM (SELECT document_id, page, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS t FROM k GROUP BY document_id, page) WHERE t <> ''"""
)
def stripped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without its running headers and footers."""
    kept = topics.without_boundaries(_pages(spark, sf_dir))
    return kept.select("document_id", "page", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query()
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections between headings, or coarse page ranges."""
    return topics.heading_sections(_pages(spark, sf_dir))


@query(
    f"""WITH {_PAGES_SQL}, g AS (SELECT document_id, page, (row_number() OVER (PARTITION BY document_id ORDER BY page) - 1) // 5 AS part FROM pages_)
SELECT document_id, part, min(page) AS page_start, max(page) AS page_end, count(*) AS n_pages,
       CASE WHEN min(page) = max(page) THEN 'Page ' || min(page) ELSE 'Pages ' || min(page) || '-' || max(page) END AS title
FROM g GROUP BY document_id, part"""
)
def fixed_page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of five consecutive pages."""
    return topics.fixed_page_groups(_pages(spark, sf_dir))


@query()
def page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping page windows under token and page limits."""
    pages = _pages(spark, sf_dir)
    return topics.page_windows(pages.select("document_id", "page", tx.quarter_tokens(F.col("text")).alias("tokens")), most_tokens=6000)


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents, lines taken as paragraphs."""
    pages = _pages(spark, sf_dir).select(
        F.col("document_id").cast("string").alias("document_id"), F.concat(F.lit("Document "), "document_id").alias("title"),
        F.col("page").cast("int").alias("page_number"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"),
    )
    return chunking.chunk_documents(pages)


@query(
    f"""WITH {_PAGES_SQL}, w AS (SELECT document_id, page, {_WORDS} AS n FROM pages_)
SELECT document_id, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_words FROM w GROUP BY document_id"""
)
def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and words of every document."""
    words = F.size(F.filter(F.split("text", tx.SPACE + "+"), lambda w: w != "")).cast("long")
    return _pages(spark, sf_dir).withColumn("n", words).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n").alias("n_words"))


@query(
    """WITH h AS (SELECT doc_id, sha256(text || ':0') || sha256(text || ':1') AS h FROM documents),
b AS (SELECT doc_id, list_transform(range(0, 64), lambda i: (('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2))::INTEGER) / 127.5::DOUBLE - 1.0::DOUBLE) AS v FROM h)
SELECT doc_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS first, round(list_max(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS largest FROM b"""
)
def deterministic_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash-made vectors of every document: first and largest entry."""
    docs = table(spark, sf_dir, "documents")
    made = docs.select("doc_id", chunking.deterministic_vector(F.col("text")).alias("v"))
    return made.select("doc_id", F.round(F.get("v", 0), 5).alias("first"), F.round(F.array_max("v"), 5).alias("largest"))


@query()
def topic_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections extended over marked page breaks; every seventh page is marked as continued."""
    pages = _pages(spark, sf_dir)
    ends = F.when(F.col("page") % 7 == 0, F.concat("text", F.lit("\nContinued on next page"))).otherwise(F.col("text"))
    starts = F.when(F.col("page") % 7 == 1, F.concat(F.lit("Continued\n"), ends)).otherwise(ends)
    marked = pages.withColumn("text", starts)
    sections = topics.heading_sections(pages).select(
        "document_id", F.col("page_start").alias("topic_id"), F.col("heading").alias("title"), F.array("heading").alias("headings"),
        F.sequence("page_start", "page_end").alias("pages"),
    )
    return continuation.resolve_continuations(marked, sections)
