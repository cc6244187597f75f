"""Answers and their evidence: profiles, citation liveness, tool calls, bundle ranking, vague questions, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import collapsed, normalized

# Words that say nothing about a question's subject, and the texts of answers.
FILLER = ("a", "an", "and", "check", "document", "help", "how", "is", "it", "manual", "of", "procedure", "system", "that", "the", "this", "to", "what")
VAGUE = (
    *FILLER, "about", "can", "could", "do", "does", "explain", "happen", "happened", "issue", "know", "me", "mean", "more", "please", "problem",
    "tell", "there", "thing", "want", "why", "would",
)
POINTERS = r"(?i)\b(it|this|that|these|those|they|them|there)\b"
INTROS = {
    "discovery": "No reviewed answer exists for this yet. From the raw indexed documents (unreviewed):", "okf_only": "Approved knowledge base:",
    "rag_only": "Found in the indexed documents:", "hybrid": "Approved knowledge plus supporting raw evidence:",
}
NOTICES = {
    "gone": "This source is no longer available.", "retracted": "This source was retracted after this answer was generated.",
    "archived": "This source is now archived and may no longer reflect current approved knowledge.",
}
MOST_BUNDLES = 10


def evidence_profiles(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """Each answer (answer_id, outcome) with counts, kind, trust, provenance and whether the user must verify it.

    ``citations`` has answer_id, source_type (okf or rag), provenance (null counts as
    legacy) and mode. Counts are aggregated before the join.
    """
    okf = F.col("source_type") == "okf"
    made = F.when(okf, F.coalesce("provenance", F.lit("legacy")))
    held = citations.groupBy("answer_id").agg(
        F.count_if(okf).alias("okf"), F.count_if(F.col("source_type") == "rag").alias("rag"), F.count(F.lit(1)).alias("total"),
        F.min(made).alias("_low"), F.max(made).alias("_high"), F.coalesce(F.bool_or(F.col("mode") == "graph"), F.lit(False)).alias("_graph"),
    )
    rows = answers.join(held, "answer_id", "left").fillna(0, ["okf", "rag", "total"])
    c = F.col
    lacking = c("outcome").eqNullSafe("insufficient_evidence")
    kind = (
        F.when(lacking | ((c("okf") == 0) & (c("rag") == 0)), "none").when((c("okf") > 0) & (c("rag") > 0), "mixed")
        .when(c("okf") > 0, "approved_okf").otherwise("raw_rag")
    )
    provenance = F.when(c("kind").isin("mixed", "approved_okf"), F.when(c("_low") == c("_high"), c("_low")).otherwise("mixed"))
    reviewed = (c("kind") == "approved_okf") & c("provenance").isin("human", "legacy")
    rows = rows.withColumn("kind", kind).withColumn("provenance", provenance)
    mode = F.when(c("kind").isin("mixed", "approved_okf"), F.when(c("_graph"), "graph").otherwise("direct"))
    return rows.select(
        "answer_id", "okf", "rag", "total", "kind", "provenance", mode.alias("mode"),
        F.when(c("kind") == "none", "blocked").when(reviewed, "high").otherwise("medium").alias("trust"), (~F.coalesce(reviewed, F.lit(False))).alias("verify"),
    )


def references_document(citations: Column, document: Column, paths: Column) -> Column:
    """Whether any citation (document_id, path) is of the document or of one of its exported paths."""
    return F.exists(citations, lambda c: F.coalesce((c["document_id"] == document) | F.array_contains(paths, c["path"]), F.lit(False)))


def references_bundle(citations: Column, scope: Column, bundle: Column) -> Column:
    """Whether citations name the bundle; those without any bundle count if the answer's scope is just that bundle."""
    named = F.exists(citations, lambda c: c["bundle_id"].eqNullSafe(bundle))
    legacy = F.exists(citations, lambda c: c["bundle_id"].isNull())
    return named | (legacy & (F.size(scope) == 1) & F.get(scope, 0).eqNullSafe(bundle))


def citation_notices(citations: DataFrame, lifecycle: DataFrame, documents: DataFrame, files: DataFrame, default_bundle: str | None = None) -> DataFrame:
    """Citations (source_type, document_id, bundle_id, path, ...) with their bundle filled in and a notice where the source is no longer what it was.

    ``lifecycle`` has bundle_id, path and status, ``documents`` document_id and
    deleted_at, ``files`` bundle_id and path of what exists. A raw citation needs its
    document, if it names one. An approved one needs a bundle and a path; then the
    states retracted, archived and deleted tell, in this order, and then whether the
    file is there. Null: nothing to tell.
    """
    okf = F.col("source_type") != "rag"
    bundle = F.when(okf, F.coalesce("bundle_id", F.lit(default_bundle))).otherwise(F.col("bundle_id"))
    held = citations.withColumn("bundle_id", bundle)
    live = documents.filter("deleted_at is null").select(F.col("document_id").alias("_document")).distinct().withColumn("_live", F.lit(True))
    states = lifecycle.select(F.col("bundle_id").alias("_b"), F.col("path").alias("_p"), F.col("status").alias("_status"))
    there = files.select(F.col("bundle_id").alias("_fb"), F.col("path").alias("_fp")).distinct().withColumn("_there", F.lit(True))
    held = held.join(live, F.col("document_id") == F.col("_document"), "left")
    held = held.join(states, (F.col("bundle_id") == F.col("_b")) & (F.col("path") == F.col("_p")), "left")
    held = held.join(there, (F.col("bundle_id") == F.col("_fb")) & (F.col("path") == F.col("_fp")), "left")
    gone, status = F.lit(NOTICES["gone"]), F.col("_status")
    approved = F.when(F.col("bundle_id").isNull() | (F.coalesce("path", F.lit("")) == ""), gone)
    approved = approved.when(status == "retracted", NOTICES["retracted"]).when(status == "archived", NOTICES["archived"])
    approved = approved.when((status == "deleted") | F.col("_there").isNull(), gone)
    raw = F.when((F.coalesce(F.col("document_id").cast("string"), F.lit("")) != "") & F.col("_live").isNull(), gone)
    return held.select(*citations.columns, F.when(okf, approved).otherwise(raw).alias("notice"))


def with_evidence(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations (answer_id, position, text) with the text of the evidence of that position, their own where it is missing."""
    own = evidence.select("answer_id", "position", F.col("text").alias("_text"))
    return citations.join(own, ["answer_id", "position"], "left").withColumn("text", F.coalesce("_text", "text")).drop("_text")


def tool_rollup(calls: DataFrame) -> DataFrame:
    """Calls (query_id, seq, tool, status, bundles, results, warnings) rolled up by tool and status, in order of the first one."""
    order = lambda c: F.sort_array(F.collect_list(F.struct("seq", c)))
    union = lambda held, c: F.array_distinct(F.flatten(F.transform(held, lambda x: x[c])))
    grouped = calls.groupBy("query_id", "tool", "status").agg(
        F.min("seq").alias("first"), F.sum("results").alias("results"), order("bundles").alias("_b"), order("warnings").alias("_w"),
    )
    return grouped.select("query_id", "tool", "status", "first", "results", union(F.col("_b"), "bundles").alias("bundles"), union(F.col("_w"), "warnings").alias("warnings"))


def query_terms(question: Column) -> Column:
    """Distinct words of letters and digits of more than two characters, in normal form."""
    words = F.split(F.regexp_replace(F.lower(normalized(question, "NFKC")), r"[^\p{L}\p{N}]+", " "), " +")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def ranked_bundles(questions: DataFrame, bundles: DataFrame) -> DataFrame:
    """Bundles of each question's scope (query_id, question, scope) by how many of its terms they hold, then by position.

    The scope is made distinct and cut to its first ten, so a question meets ten
    bundles at most.
    """
    scope = F.slice(F.array_distinct(F.filter("scope", lambda b: F.coalesce(b, F.lit("")) != "")), 1, MOST_BUNDLES)
    asked = questions.select("query_id", query_terms(F.col("question")).alias("_terms"), F.posexplode(scope).alias("position", "bundle_id"))
    held = asked.join(bundles.select("bundle_id", F.lower(normalized(F.col("searchable"), "NFKC")).alias("_text")), "bundle_id")
    scored = held.withColumn("score", F.size(F.filter("_terms", lambda t: F.contains(F.col("_text"), t))))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "position")
    return scored.select("query_id", "bundle_id", "score", F.row_number().over(order).alias("rank"))


def needs_understanding(question: Column, route: Column, confidence: Column) -> Column:
    """Whether a question must be understood first: an unsure route, a pointing word, or hardly a meaningful word."""
    words = F.filter(F.split(collapsed(question), " "), lambda w: w != "")
    told = F.filter(words, lambda w: ~F.regexp_replace(F.lower(w), "[^a-z0-9-]", "").isin(*FILLER))
    return (confidence == "low") | (route == "missing_context") | question.rlike(POINTERS) | ((F.size(words) <= 5) & (F.size(told) <= 1))


def is_vague(question: Column, n_entities: Column) -> Column:
    """Whether a question names no entity and no word that means anything."""
    terms = F.filter(F.split(F.lower(collapsed(question)), "[^a-z0-9-]+"), lambda t: (t != "") & ~t.isin(*VAGUE))
    return (collapsed(question) == "") | ((n_entities == 0) & (F.size(terms) == 0))


def deterministic_answers(citations: DataFrame, answers: DataFrame) -> DataFrame:
    """The answer that the citations (answer_id, index, text) make in order, after the intro of the route."""
    said = F.sort_array(F.collect_list(F.struct("index", F.format_string("%s [%d]", F.col("text"), F.col("index")).alias("said"))))
    body = citations.groupBy("answer_id").agg(F.array_join(F.transform(said, lambda x: x["said"]), " ").alias("body"))
    intro = F.when(F.col("discovery_only") & (F.col("route") != "rag_only"), INTROS["discovery"])
    for route in ("okf_only", "rag_only"):
        intro = intro.when(F.col("route") == route, INTROS[route])
    return answers.join(body, "answer_id").select("answer_id", F.concat(intro.otherwise(INTROS["hybrid"]), F.lit(" "), "body").alias("answer"))


def knowledge_gaps(answers: DataFrame) -> DataFrame:
    """Answers without enough evidence on a route that searches."""
    return answers.filter((F.col("outcome") == "insufficient_evidence") & F.col("route").isin("okf_only", "rag_only", "hybrid")).select("answer_id", "question", "route")
