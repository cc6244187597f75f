"""Relational queries of the ingest and review workflow over the star-schema tables.

An order stands in for a document or a run, its lines for pages or items, an
event for a job or an activity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import lifecycle as lc
from tessera.plans.base import query, table


@query(
    """SELECT event_type, count(*) AS total, count(*) FILTER (value IS NULL OR value < 10) AS processing,
       count(*) FILTER (value >= 10 AND value < 60) AS ready, count(*) FILTER (value >= 60) AS review FROM events GROUP BY event_type"""
)
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by state."""
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(v.isNull() | (v < 10)).alias("processing"),
        F.count_if((v >= 10) & (v < 60)).alias("ready"), F.count_if(v >= 60).alias("review"),
    )


_ITEM = "CASE l_linestatus WHEN 'F' THEN CASE l_returnflag WHEN 'R' THEN 'failed' ELSE 'done' END ELSE CASE l_returnflag WHEN 'N' THEN 'done' ELSE 'queued' END END"


@query(
    f"""WITH i AS (SELECT l_orderkey, {_ITEM} AS status FROM lineitem), c AS (
  SELECT l_orderkey AS run, count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status = 'failed') AS n_failed,
         count(*) FILTER (status NOT IN ('done', 'failed')) AS n_open FROM i GROUP BY l_orderkey)
SELECT *, CASE WHEN n_open > 0 THEN 'running' WHEN n_failed = 0 THEN 'completed' WHEN n_done = 0 THEN 'failed' ELSE 'completed_with_errors' END AS outcome FROM c"""
)
def run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of every run from its items' statuses."""
    returned = F.col("l_returnflag")
    status = F.when(F.col("l_linestatus") == "F", F.when(returned == "R", "failed").otherwise("done")).otherwise(F.when(returned == "N", "done").otherwise("queued"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), status.alias("status"))
    return lc.run_outcome(items, "run", "status")


@query(
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
)
def latest_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest child of every parent."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return lc.latest(orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).drop("o_orderdate")


@query(
    """SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 10"""
)
def latest_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten latest children of every parent."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return lc.latest(orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 10).drop("o_orderdate")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty latest activities."""
    return table(spark, sf_dir, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(20).select("event_id", "user_id", "event_type")


@query(
    """WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey % 5 AS topic, l_linenumber AS page FROM lineitem)
SELECT a.l_orderkey, a.topic AS set_id, b.topic AS other_id, count(*) AS n_shared FROM l a JOIN l b
ON a.l_orderkey = b.l_orderkey AND a.page = b.page AND a.topic < b.topic GROUP BY ALL"""
)
def page_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of topics of a document that share source pages."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("topic"), F.col("l_linenumber").alias("page"))
    return lc.overlapping(rows, rows, "l_orderkey", "topic", "topic", "page").filter("set_id < other_id")


@query(
    """WITH t AS (SELECT DISTINCT l_orderkey, l_suppkey % 5 AS topic, l_linenumber AS page, l_returnflag FROM lineitem),
r AS (SELECT DISTINCT l_orderkey, page FROM t WHERE l_returnflag = 'R')
SELECT DISTINCT l_orderkey, topic FROM t c WHERE NOT EXISTS (SELECT 1 FROM t x JOIN r ON r.l_orderkey = x.l_orderkey AND r.page = x.page
 WHERE x.l_orderkey = c.l_orderkey AND x.topic = c.topic)"""
)
def overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics without a page that a reviewed topic of the document already has."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("topic"), F.col("l_linenumber").alias("page"), "l_returnflag")
    return lc.not_overlapping(rows, rows.filter("l_returnflag = 'R'"), "l_orderkey", "topic", "page")


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber AS span_id, l_linenumber AS "start", l_linenumber + 1 AS "end" FROM lineitem WHERE l_returnflag = 'R')
SELECT s.l_orderkey, span_id, p.l_linenumber AS page, p.l_partkey FROM s JOIN lineitem p
ON p.l_orderkey = s.l_orderkey AND p.l_linenumber BETWEEN greatest(1, s."start" - 2) AND s."end" + 2"""
)
def page_range_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages around each cited span."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page"), "l_partkey", "l_returnflag")
    spans = lines.filter("l_returnflag = 'R'").select("l_orderkey", F.col("page").alias("span_id"), F.col("page").alias("start"), (F.col("page") + 1).alias("end"))
    return lc.page_context(lines.drop("l_returnflag"), spans, "l_orderkey", "page").select("l_orderkey", "span_id", "page", "l_partkey")


@query(
    """WITH k AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS first, max(l_suppkey) AS last FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
SELECT o_orderkey, coalesce(n, 0) AS n_covered, coalesce(first, -1) AS first, coalesce(last, -1) AS last FROM orders LEFT JOIN k ON l_orderkey = o_orderkey"""
)
def coverage_array_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with the concepts that cover it; none gives an empty array."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    links = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    covered = lc.coverage_arrays(orders, links, "o_orderkey", "l_suppkey")
    return covered.select(
        "o_orderkey", F.size("covered_by").cast("long").alias("n_covered"), F.coalesce(F.get("covered_by", 0), F.lit(-1)).alias("first"),
        F.coalesce(F.try_element_at("covered_by", F.lit(-1)), F.lit(-1)).alias("last"),
    )


@query(
    """WITH h AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber <= 3), w AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber >= 3)
SELECT coalesce(h.l_orderkey, w.l_orderkey) AS l_orderkey, coalesce(h.l_suppkey, w.l_suppkey) AS l_suppkey,
       CASE WHEN h.l_orderkey IS NULL THEN 'insert' WHEN w.l_orderkey IS NULL THEN 'delete' ELSE 'keep' END AS action
FROM h FULL JOIN w ON h.l_orderkey = w.l_orderkey AND h.l_suppkey = w.l_suppkey"""
)
def reconcile_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What turns the held links into the wanted ones."""
    lines = table(spark, sf_dir, "lineitem")
    return lc.reconcile(lines.filter("l_linenumber <= 3"), lines.filter("l_linenumber >= 3"), ["l_orderkey", "l_suppkey"])


@query(
    """WITH c AS (SELECT o_orderkey AS k, 'old' AS v FROM orders), n AS (SELECT DISTINCT l_orderkey AS k, 'new' AS v FROM lineitem WHERE l_quantity > 45)
SELECT * FROM c WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT * FROM n"""
)
def embedding_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after an upsert in which the last writer of a key wins."""
    current = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit("old").alias("v"))
    changes = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("k"), F.lit("new").alias("v")).distinct()
    return lc.upsert(current, changes, ["k"])


@query(
    """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice > 200000 THEN 'confirmation_required' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'needs_review' END,
  CASE WHEN o_orderstatus = 'P' THEN 'not_ready' END, CASE WHEN o_orderdate IS NULL THEN 'missing_date' END], lambda x: x IS NOT NULL), ',') AS errors FROM orders"""
)
def eligibility_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered error codes of every candidate."""
    codes = lc.error_codes(
        confirmation_required=F.col("o_totalprice") > 200000, needs_review=F.col("o_orderpriority").startswith("1"),
        not_ready=F.col("o_orderstatus") == "P", missing_date=F.col("o_orderdate").isNull(),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(codes, ",").alias("errors"))


@query(
    """WITH u AS (SELECT user_id, count(*) AS n_calls FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT c_custkey, coalesce(n_calls, 0) AS n_calls, coalesce(n_calls, 0) < 15 AS allowed FROM customer LEFT JOIN u ON user_id = c_custkey"""
)
def rerank_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each workspace may still rerank today."""
    used = table(spark, sf_dir, "events").filter("event_type = 'click'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return table(spark, sf_dir, "customer").select("c_custkey").join(used, "c_custkey", "left").select("c_custkey", n.alias("n_calls"), (n < 15).alias("allowed"))


@query(
    """SELECT l_orderkey, l_linenumber AS page, coalesce(lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = l_linenumber + 1, false) AS continues FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"""
)
def adjacent_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the next page number of the document directly follows."""
    pages = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page")).distinct()
    after = F.lead("page").over(Window.partitionBy("l_orderkey").orderBy("page"))
    return pages.withColumn("continues", F.coalesce(after == F.col("page") + 1, F.lit(False)))


@query(
    """SELECT n_name, count(s_suppkey) AS n_documents, round(coalesce(sum(s_acctbal), 0), 2) AS tokens FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name"""
)
def bundle_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens of every bundle, zero for empty ones."""
    held = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("s_acctbal").alias("t"))
    joined = table(spark, sf_dir, "nation").join(held, "n_nationkey", "left")
    return joined.select("n_name", F.coalesce("n", F.lit(0)).alias("n_documents"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("tokens"))


@query(
    """WITH a AS (SELECT doc_id, ['archived', 'deleting', 'deleted', 'retracted', 'superseded', 'Retracted', 'active'][doc_id % 7 + 1] AS status FROM labels WHERE toxic = 1 OR quality = 0)
SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = d.doc_id AND (a.status LIKE 'archiv%' OR a.status LIKE 'delet%' OR a.status = 'retracted'))"""
)
def active_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lifecycle is active; unknown and missing statuses are."""
    status = F.get(F.array(*map(F.lit, ("archived", "deleting", "deleted", "retracted", "superseded", "Retracted", "active"))), (F.col("doc_id") % 7).cast("int"))
    marks = table(spark, sf_dir, "labels").filter("toxic = 1 or quality = 0").select("doc_id", status.alias("status"))
    return lc.only_active(table(spark, sf_dir, "documents").select("doc_id"), marks, ["doc_id"])


@query(
    """WITH r AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_suppkey % 10 <> 0 GROUP BY 1)
SELECT r.l_orderkey, r.n AS n_before, coalesce(k.n, 0) AS n_after FROM r LEFT JOIN k USING (l_orderkey) WHERE r.n <> coalesce(k.n, 0)"""
)
def deletion_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose relations change when their targets are deleted, with counts before and after."""
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    gone = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    left = edges.join(gone, "l_suppkey", "left_anti").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"))
    counts = edges.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_before")).join(left, "l_orderkey", "left")
    return counts.select("l_orderkey", "n_before", F.coalesce("k", F.lit(0)).alias("n_after")).filter("n_before <> n_after")


@query(
    """WITH a AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS pending_tokens, count(*) FILTER (l_returnflag = 'R') AS n_skipped,
 coalesce(min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END), 0) AS first_skipped FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(pending_tokens AS BIGINT) AS pending_tokens, n_skipped, first_skipped FROM a"""
)
def automatic_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending tokens, skipped items and the first skipped one of every automatic run."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.when(flag == "N", F.col("l_quantity").cast("long")).otherwise(0)).alias("pending_tokens"),
        F.count_if(flag == "R").alias("n_skipped"), F.coalesce(F.min(F.when(flag == "R", F.col("l_linenumber"))), F.lit(0)).alias("first_skipped"),
    )


@query("SELECT n_regionkey, min_by(n_nationkey, n_name) AS next_primary FROM nation WHERE n_nationkey % 3 <> 0 GROUP BY n_regionkey")
def next_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The remaining bundle of the lowest position."""
    return table(spark, sf_dir, "nation").filter("n_nationkey % 3 <> 0").groupBy("n_regionkey").agg(F.min_by("n_nationkey", "n_name").alias("next_primary"))
