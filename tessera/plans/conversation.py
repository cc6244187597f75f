"""Conversation queries: titles, context, routing, evidence and answer checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import excerpt
from tessera.operators import routing
from tessera.plans.base import query, table

QUESTIONS = [
    "What is the approved Thermal Regulation Protocol?",
    "How does the approved Thermal Regulation Protocol affect the downstream subsystem?",
    "Search every document for calibration drift examples.",
    "Should I delete production data?",
    "What is the live weather right now?",
    "Explain the official policy with supporting documents",
    "Describe ISO 9001 section 4.2 and ticket no. A-17 of 2024-05-06",
    'Compare "alpha beta" with v1.2.3 across the documents',
    "engine fire in flight procedure",
    "hello there",
]
_LITERALS = ", ".join(f"({i}, '{q.replace(chr(39), chr(39) * 2)}')" for i, q in enumerate(QUESTIONS))
_ASKED_SQL = f"""asked AS (SELECT * FROM (VALUES {_LITERALS}) v(question_id, question)
UNION ALL SELECT 1000 + conv_id * 1000 + turn, text FROM conversations WHERE role = 'user')"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    literal = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("question_id"), F.lit(q).alias("question")) for i, q in enumerate(QUESTIONS))))
    fixed = spark.range(1).select(literal.alias("q")).select("q.*")
    said = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return fixed.unionByName(said.select((1000 + F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question")))


def _any(patterns: list[str]) -> str:
    return "(" + " OR ".join("regexp_matches(q, '" + p.replace("'", "''") + "')" for p in patterns) + ")"


_ROUTED_SQL = f"""{_ASKED_SQL}, n AS (SELECT question_id, question, lower(trim(regexp_replace(question, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS q FROM asked),
f AS (SELECT question_id, question, {_any(routing.LIVE)} AS live, {_any(routing.MISSING)} AS missing, {_any(routing.HYBRID)} AS hybrid, {_any(routing.DISCOVERY)} AS discovery,
  {_any(routing.CANONICAL)} AS canonical, {_any(routing.HIGH_RISK)} AS risk, {_any(routing.GRAPH)} AS graph, {_any(routing.APPROVED)} AS approved,
  CASE WHEN {_any(routing.LOOKUP)} THEN 'source_lookup' WHEN {_any(routing.PROCESS)} THEN 'policy_or_process' ELSE 'canonical_definition' END AS okf FROM n),
routed AS (SELECT question_id, question, graph AS needs_graph,
  CASE WHEN live AND NOT (approved OR hybrid) THEN 'unsupported' WHEN missing OR risk THEN 'missing_context' WHEN hybrid THEN 'hybrid' WHEN discovery THEN 'rag_only'
       WHEN approved OR canonical THEN 'okf_only' ELSE 'missing_context' END AS route,
  CASE WHEN live AND NOT (approved OR hybrid) THEN 'live_or_fresh_data' WHEN missing OR risk THEN 'missing_context' WHEN hybrid THEN 'comparison' WHEN discovery THEN 'open_ended_discovery'
       WHEN approved OR canonical THEN okf ELSE 'missing_context' END AS category,
  CASE WHEN live AND NOT (approved OR hybrid) THEN 'high' WHEN missing OR risk THEN 'high' WHEN hybrid THEN 'medium' WHEN discovery THEN 'high' WHEN approved THEN 'high'
       WHEN canonical THEN 'medium' ELSE 'low' END AS confidence FROM f)"""


@query(f"WITH {_ROUTED_SQL} SELECT question_id, route, category, confidence, needs_graph FROM routed")
def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route of every asked question."""
    return routing.route_questions(_asked(spark, sf_dir)).select("question_id", "route", "category", "confidence", "needs_graph")


@query()
def protected_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers that a rewrite of each question must keep."""
    return _asked(spark, sf_dir).select("question_id", F.array_join(routing.protected_entities(F.col("question")), "|").alias("entities"))


_CITED_SQL = """c AS (SELECT conv_id AS answer_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + CASE WHEN conv_id % 9 = 0 THEN 1 ELSE 0 END AS index, role AS title,
  CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS text, turn AS page_start, turn + 1 - CASE WHEN conv_id % 7 = 0 THEN 3 ELSE 0 END AS page_end,
  CASE WHEN turn % 3 = 2 THEN 'rag' ELSE 'okf' END AS source_type, conv_id % 2 AS covered FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) WHERE turn >= 1 AND conv_id % 11 <> 0),
a AS (SELECT DISTINCT conv_id AS answer_id, 'see [' || (conv_id % 4) || '] and [1]' AS answer, CASE WHEN conv_id % 2 = 0 THEN 'okf_only' ELSE 'hybrid' END AS route, conv_id % 13 = 0 AS error FROM conversations)"""


def _cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Answers and citations made from the turns of conversations, some with faults."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").distinct()
    conv, turn = F.col("conv_id"), F.col("turn")
    index = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) + F.when(conv % 9 == 0, 1).otherwise(0)
    citations = said.filter("turn >= 1 and conv_id % 11 <> 0").select(
        conv.alias("answer_id"), index.alias("index"), F.col("role").alias("title"), F.when(turn % 5 == 4, "").otherwise(F.col("text")).alias("text"),
        turn.alias("page_start"), (turn + 1 - F.when(conv % 7 == 0, 3).otherwise(0)).alias("page_end"),
        F.when(turn % 3 == 2, "rag").otherwise("okf").alias("source_type"), (conv % 2).alias("covered"),
    )
    answers = said.select(conv.alias("answer_id")).distinct().select(
        "answer_id", F.concat(F.lit("see ["), F.col("answer_id") % 4, F.lit("] and [1]")).alias("answer"),
        F.when(F.col("answer_id") % 2 == 0, "okf_only").otherwise("hybrid").alias("route"), (F.col("answer_id") % 13 == 0).alias("error"),
    )
    return answers, citations


@query(
    f"""WITH {_CITED_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY index) - 1 AS place FROM c),
v AS (SELECT answer_id, place, list_filter([CASE WHEN index <> place + 1 THEN 'citation_index_mismatch:' || place END, CASE WHEN trim(title) = '' OR trim(text) = '' THEN 'citation_missing_source_details:' || place END,
  CASE WHEN page_start < 1 OR page_end < page_start THEN 'citation_invalid_page_range:' || place END], lambda x: x IS NOT NULL) AS codes, (source_type = 'rag' AND covered = 0) AS raw FROM p),
g AS (SELECT answer_id, count(*) AS n, count(*) FILTER (raw) AS n_raw, flatten(list(codes ORDER BY place)) AS codes FROM v GROUP BY answer_id),
r AS (SELECT a.*, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN ['citation_marker_without_source'] ELSE list_concat(list_concat(
  CASE WHEN error THEN ['citations_present_after_retrieval_error'] ELSE []::VARCHAR[] END, codes), CASE WHEN route = 'okf_only' AND n_raw > 0 THEN ['raw_rag_used_without_okf_fallback_label'] ELSE []::VARCHAR[] END) END AS vs
  FROM a LEFT JOIN g ON g.answer_id = a.answer_id)
SELECT answer_id, array_to_string(vs, ',') AS violations, len(vs) = 0 AS passes,
  CASE WHEN n = 0 THEN 'answer_with_missing_evidence' WHEN len(vs) > 0 THEN 'fallback_to_cited_evidence' ELSE 'release_as_written' END AS mode,
  n >= 1 AND answer_id % 4 BETWEEN 1 AND n AS markers_valid FROM r"""
)
def answer_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of every answer against its citations."""
    checked = routing.validate_answers(*_cited(spark, sf_dir))
    return checked.select("answer_id", F.array_join("violations", ",").alias("violations"), "passes", "mode", "markers_valid")


@query(
    f"""WITH {_ROUTED_SQL}, e AS (SELECT question_id, route, needs_graph, question_id % 2 = 0 AS approved, question_id % 4 AS n_citations, question_id % 3 AS n_raw,
  CASE WHEN question_id % 5 = 0 THEN 'graph' ELSE 'lexical' END AS mode, question_id % 17 = 0 AS clarification, question_id % 19 = 0 AS error FROM routed)
SELECT question_id, CASE WHEN error THEN 'none' WHEN clarification THEN 'weak' WHEN approved AND route = 'hybrid' THEN 'partial' WHEN approved AND needs_graph AND mode <> 'graph' THEN 'partial'
  WHEN approved THEN 'strong' WHEN n_citations > 0 THEN 'weak' ELSE 'none' END AS sufficiency,
  CASE WHEN error THEN 'retrieval_error' WHEN clarification THEN 'weak_evidence' WHEN n_citations = 0 THEN 'no_evidence' WHEN approved THEN 'approved_evidence' ELSE 'discovery_evidence' END AS status,
  CASE WHEN n_raw = 0 THEN 'not_invoked' WHEN route = 'rag_only' THEN 'raw_discovery_route' WHEN approved AND route = 'hybrid' THEN 'hybrid_supporting_context'
  WHEN approved AND needs_graph THEN 'graph_evidence_gap' ELSE 'approved_knowledge_miss' END AS raw_reason FROM e"""
)
def evidence_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sufficiency and status of the evidence of every question."""
    routed = routing.route_questions(_asked(spark, sf_dir))
    i = F.col("question_id")
    mode = F.when(i % 5 == 0, "graph").otherwise("lexical")
    columns = routing.evidence_columns(F.col("route"), F.col("needs_graph"), i % 2 == 0, i % 4, i % 3, mode, i % 17 == 0, i % 19 == 0)
    return routed.select("question_id", *(c.alias(n) for n, c in columns.items()))


_COLLAPSED = "trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query(
    f"""SELECT conv_id, CASE WHEN length(t) > 72 THEN rtrim(t[1:69]) || '...' ELSE t END AS title FROM (
SELECT conv_id, {_COLLAPSED} AS t FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) = 1)"""
)
def first_user_message_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title of every conversation: its first user message, cut to 72 characters."""
    said = table(spark, sf_dir, "conversations").filter("role = 'user'")
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    return said.withColumn("at", first).filter("at = 1").select("conv_id", excerpt(F.col("text"), 72).alias("title"))


@query(
    """WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations), w AS (
  SELECT conv_id, turn, role, text, list(role) OVER p AS before, coalesce(sum(length(text)) OVER p, 0) AS chars FROM d
  WINDOW p AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, sha256(text) AS said, coalesce(array_to_string(before, '>'), '') AS context_roles, CAST(chars AS BIGINT) AS context_chars FROM w"""
)
def context_window_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six turns before every turn: their roles and size."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").distinct()
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(-6, -1)
    return said.select(
        "conv_id", "turn", F.sha2("text", 256).alias("said"), F.array_join(F.collect_list("role").over(before), ">").alias("context_roles"),
        F.coalesce(F.sum(F.length("text").cast("long")).over(before), F.lit(0)).alias("context_chars"),
    )


@query(
    """WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations), f AS (SELECT *, role = 'assistant' AND length(text) % 3 = 0 AS clar FROM d),
l AS (SELECT conv_id, max(turn) FILTER (clar) AS last_clar FROM f GROUP BY conv_id)
SELECT l.conv_id, last_clar IS NOT NULL AS asked, coalesce(max(turn) FILTER (role = 'user' AND turn < last_clar), -1) AS origin_turn FROM l JOIN f ON f.conv_id = l.conv_id GROUP BY l.conv_id, last_clar"""
)
def clarification_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a conversation has had a clarification, and the user turn that led to the last one."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").distinct()
    held = said.withColumn("clar", (F.col("role") == "assistant") & (F.length("text") % 3 == 0))
    last = held.withColumn("last", F.max(F.when(F.col("clar"), F.col("turn"))).over(Window.partitionBy("conv_id")))
    origin = F.max(F.when((F.col("role") == "user") & (F.col("turn") < F.col("last")), F.col("turn")))
    return last.groupBy("conv_id").agg(F.max(F.col("last")).isNotNull().alias("asked"), F.coalesce(origin, F.lit(-1)).alias("origin_turn"))


@query(
    """WITH e AS (SELECT doc_id // 50 AS query_id, CASE WHEN (doc_id // 50) % 3 = 0 THEN 'okf_only' WHEN (doc_id // 50) % 3 = 1 THEN 'hybrid' ELSE 'rag_only' END AS route, source AS bundle, doc_id AS index,
  CASE WHEN doc_id % 3 = 0 THEN 'okf' ELSE 'rag' END AS source_type, CASE WHEN doc_id % 6 = 0 THEN 'human' WHEN doc_id % 9 = 0 THEN 'automated' ELSE 'other' END AS provenance, doc_id % 2 AS covered FROM documents),
t AS (SELECT *, CASE WHEN source_type = 'rag' THEN 3 WHEN provenance = 'human' THEN 0 WHEN provenance = 'automated' THEN 1 ELSE 2 END AS trust,
  max((source_type = 'okf')::INT) OVER (PARTITION BY query_id) AS approved FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY trust, bundle, index) AS place FROM t WHERE NOT (route = 'okf_only' AND approved = 1 AND source_type = 'rag' AND covered = 0))
SELECT query_id, bundle, index, trust, CAST(row_number() OVER (PARTITION BY query_id ORDER BY source_type, trust, bundle, index) AS INTEGER) AS new_index FROM k
WHERE place <= CASE WHEN source_type = 'okf' THEN 4 ELSE 6 END AND NOT (route = 'rag_only' AND source_type = 'okf')"""
)
def multi_bundle_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of several bundles merged by trust under caps; fifty documents make a query's evidence."""
    i = F.col("doc_id")
    q = F.floor(i / 50)
    route = F.when(q % 3 == 0, "okf_only").when(q % 3 == 1, "hybrid").otherwise("rag_only")
    evidence = table(spark, sf_dir, "documents").select(
        q.alias("query_id"), route.alias("route"), F.col("source").alias("bundle"), i.alias("index"), F.when(i % 3 == 0, "okf").otherwise("rag").alias("source_type"),
        F.when(i % 6 == 0, "human").when(i % 9 == 0, "automated").otherwise("other").alias("provenance"), (i % 2).alias("covered"),
    )
    return routing.merge_bundles(evidence).select("query_id", "bundle", "index", "trust", "new_index")


@query(
    """WITH c AS (SELECT doc_id AS citation_id, doc_id // 20 AS query_id, source AS bundle, list_distinct(list_filter(string_split_regex(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ('an', 'and', 'for', 'of', 'or', 'the', 'to'))) AS tt,
  list_sort(list_distinct([doc_id % 3 || '%', doc_id % 2 || 'kg'])) AS vs FROM documents),
t AS (SELECT query_id, citation_id, bundle, vs, unnest(tt) AS term FROM c)
SELECT l.query_id, l.citation_id AS l_citation_id, r.citation_id AS r_citation_id, count(*) AS n_terms FROM t l JOIN t r
ON l.query_id = r.query_id AND l.term = r.term AND l.citation_id < r.citation_id AND l.bundle <> r.bundle AND l.vs <> r.vs GROUP BY 1, 2, 3 HAVING count(*) >= 2"""
)
def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of different bundles on the same subject with different values."""
    words = F.filter(F.split(F.lower(F.get(F.split("text", "\n"), 0)), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin("an", "and", "for", "of", "or", "the", "to"))
    i = F.col("doc_id")
    citations = table(spark, sf_dir, "documents").select(
        i.alias("citation_id"), F.floor(i / 20).alias("query_id"), F.col("source").alias("bundle"), words.alias("title_terms"),
        F.array(F.concat(i % 3, F.lit("%")), F.concat(i % 2, F.lit("kg"))).alias("values"),
    )
    return routing.conflicting_values(citations)


@query(
    """WITH f AS (SELECT doc_id // 10 AS query_id, doc_id AS candidate, 'lang' AS field, 0 AS position, lang AS value FROM documents
  UNION ALL SELECT doc_id // 10, doc_id, 'source', 1, source FROM documents WHERE doc_id % 17 <> 0 UNION ALL SELECT doc_id // 10, doc_id, 'size', 2, CASE WHEN n_chars > 1000 THEN 'Long' ELSE 'short' END FROM documents),
n AS (SELECT query_id, count(DISTINCT candidate) AS n FROM f GROUP BY 1), o AS (SELECT query_id, field, position, lower(value) AS o, array_to_string(list_sort(list(DISTINCT candidate::VARCHAR)), '|') AS s FROM f GROUP BY ALL),
g AS (SELECT query_id, field, position, count(*) AS n_options, count(DISTINCT s) AS n_subsets FROM o GROUP BY ALL), w AS (SELECT query_id, field, count(DISTINCT candidate) AS n_with FROM f GROUP BY ALL)
SELECT g.query_id, g.field, n_options, CAST(row_number() OVER (PARTITION BY g.query_id ORDER BY position) AS INTEGER) AS rank FROM g JOIN w ON w.query_id = g.query_id AND w.field = g.field JOIN n ON n.query_id = g.query_id
WHERE n_with = n AND n >= 2 AND n_options BETWEEN 2 AND 8 AND n_subsets >= 2 QUALIFY rank <= 2"""
)
def near_miss_clarification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata fields that would tell each query's ten near misses apart."""
    docs = table(spark, sf_dir, "documents")
    q, c = F.floor(F.col("doc_id") / 10).alias("query_id"), F.col("doc_id").alias("candidate")
    size = F.when(F.col("n_chars") > 1000, "Long").otherwise("short")
    fields = F.array(
        F.struct(F.lit("lang").alias("field"), F.lit(0).alias("position"), F.col("lang").alias("value")),
        F.struct(F.lit("source").alias("field"), F.lit(1).alias("position"), F.when(F.col("doc_id") % 17 != 0, F.col("source")).alias("value")),
        F.struct(F.lit("size").alias("field"), F.lit(2).alias("position"), size.alias("value")),
    )
    rows = docs.select(q, c, F.explode(fields).alias("f")).select("query_id", "candidate", "f.*").filter("value is not null")
    return routing.clarification_fields(rows)


@query(
    """WITH t AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS calls FROM events)
SELECT event_id, CASE WHEN calls >= 8 THEN 'agent_tool_call_limit_exceeded' WHEN calls >= 7 AND event_type <> 'purchase' THEN 'agent_tool_validation_call_reserved'
  WHEN user_id % 5 = 0 THEN 'agent_tool_bundle_not_allowed' ELSE 'allowed' END AS verdict FROM t"""
)
def tool_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy verdict on every tool call; an agent has eight calls and the last is for validation."""
    calls = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    held = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", calls.alias("calls"))
    verdict = (
        F.when(F.col("calls") >= 8, "agent_tool_call_limit_exceeded").when((F.col("calls") >= 7) & (F.col("event_type") != "purchase"), "agent_tool_validation_call_reserved")
        .when(F.col("user_id") % 5 == 0, "agent_tool_bundle_not_allowed").otherwise("allowed")
    )
    return held.select("event_id", verdict.alias("verdict"))
