"""Question routing, evidence assessment and answer validation, as Column expressions over tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The router's patterns, over lower-case questions. \b is an ASCII word boundary.
LIVE = [r"\btoday'?s\b", r"\bcurrent\b", r"\bright now\b", r"\blive\b", r"\binventory count\b", r"\bweather\b", r"\bstock price\b"]
MISSING = [
    r"\bshould i\b", r"\bshould we\b",
    r"^can (?:i|we) (?:approve|publish|sign|send|release|delete|change|proceed|act|rely|use|do|dispatch)\b",
    r"^what procedure should i use\??$", r"^which procedure should i use\??$",
]
HYBRID = [
    r"\b(approved|official|authoritative)\b.*\b(example|examples|supporting|raw|manuals|documents)\b",
    r"\b(example|examples|supporting|raw|manuals|documents)\b.*\b(approved|official|authoritative)\b",
]
DISCOVERY = [
    r"\bfind all\b", r"\bsearch\b", r"\bmentions?\b", r"\bsummarize\b", r"\bcompare\b", r"\bsimilar\b", r"\bseen this before\b",
    r"\bevery document\b", r"\bacross (the )?documents\b",
]
CANONICAL = [r"^what (is|are|does)\b", r"^how (do|does|is|are)\b", r"^where (is|are)\b", r"^explain\b", r"^describe\b"]
HIGH_RISK = [
    r"\b(safety|emergency|fire|hazard|injury|medical|clinical|legal|regulatory|compliance|financial|payment|security|privacy|data breach|access control)\b.*\b(action|decision|procedure|response|approval|requirement|advice|treatment|shutdown|report)\b",
    r"\b(action|decision|procedure|response|approval|requirement|advice|treatment|shutdown|report)\b.*\b(safety|emergency|fire|hazard|injury|medical|clinical|legal|regulatory|compliance|financial|payment|security|privacy|data breach|access control)\b",
    r"\b(administer medication|wire transfer|delete production data|sign (?:the |a )?contract|emergency shutdown)\b",
    r"\b(engine|apu|fuel|hydraulic|electrical|flight control|brake|landing gear)\b.*\b(fire|failure|fault|emergency|in flight|in-flight)\b",
    r"\b(fire|failure|fault|emergency|in flight|in-flight)\b.*\b(engine|apu|fuel|hydraulic|electrical|flight control|brake|landing gear)\b",
]
GRAPH = [
    r"\brelated to\b", r"\brelationship between\b", r"\bconnected to\b", r"\bhow does .* affect\b", r"\bimpact of .* on\b",
    r"\bacross (?:the )?(?:systems|concepts|procedures|policies|contracts|reports|records|manuals|documents)\b",
    r"\btrace (?:the )?(?:path|relationship|chain)\b",
]
APPROVED = [
    r"\bofficial\b", r"\bapproved\b", r"\bdefinition\b", r"\bdefine\b", r"\bpolicy\b", r"\bprocess\b", r"\bprocedure\b", r"\bsource authority\b",
    r"\bauthoritative\b", r"\bmanual path\b", r"\bgoverning (?:policy|rule|standard|document)\b", r"\b(policy|contract|standard) requirement\b",
]
LOOKUP = [r"\b(manual path|source|authority|authoritative|citation|reference|origin|where documented)\b"]
PROCESS = [r"\b(policy|process|procedure)\b"]


def ascii_bounds(pattern: str) -> str:
    """The pattern with each boundary spelled out, since the JVM's own takes accented letters for word characters."""
    opened = re.sub(r"\\b(?=[a-z(])", r"(?<![A-Za-z0-9_])", pattern)
    return opened.replace(r"\b", r"(?![A-Za-z0-9_])")


def matches_any(value: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | value.rlike(ascii_bounds(p))
    return found


def route_questions(questions: DataFrame, question: str = "question", asked_before: str | None = None) -> DataFrame:
    """Add route, category, confidence and needs_graph. ``asked_before`` says whether a clarification was asked."""
    q = F.lower(F.trim(F.regexp_replace(F.col(question), r"\s+", " ")))
    before = F.col(asked_before) if asked_before else F.lit(False)
    rules = {"live": LIVE, "missing": MISSING, "hybrid": HYBRID, "discovery": DISCOVERY, "canonical": CANONICAL, "risk": HIGH_RISK, "graph": GRAPH, "approved": APPROVED, "lookup": LOOKUP, "process": PROCESS}
    held = questions.withColumns({f"_{k}": matches_any(q, v) for k, v in rules.items()}).withColumn("_before", before)
    is_ = {k: F.col(f"_{k}") for k in (*rules, "before")}
    okf = F.when(is_["lookup"], "source_lookup").when(is_["process"], "policy_or_process").otherwise("canonical_definition")
    cases = [
        (is_["live"] & ~(is_["approved"] | is_["hybrid"]), "unsupported", F.lit("live_or_fresh_data"), "high"),
        (~is_["before"] & (is_["missing"] | is_["risk"]), "missing_context", F.lit("missing_context"), "high"),
        (is_["risk"], "okf_only", F.lit("high_risk_domain"), "medium"),
        (is_["hybrid"], "hybrid", F.lit("comparison"), "medium"),
        (is_["discovery"], "rag_only", F.lit("open_ended_discovery"), "high"),
        (is_["approved"], "okf_only", okf, "high"),
        (is_["canonical"], "okf_only", okf, "medium"),
        (is_["before"], "okf_only", F.lit("canonical_definition"), "medium"),
    ]
    route, category, confidence = F.lit("missing_context"), F.lit("missing_context"), F.lit("low")
    for condition, r, c, level in reversed(cases):
        route = F.when(condition, r).otherwise(route)
        category = F.when(condition, c).otherwise(category)
        confidence = F.when(condition, level).otherwise(confidence)
    routed = held.withColumns({"route": route, "category": category, "confidence": confidence, "needs_graph": is_["graph"]})
    return routed.drop(*(f"_{k}" for k in is_))


# What counts as an identifier in a question, in order of extraction.
ENTITY_PATTERNS = [
    r'"([^"]+)"', "“([^”]+)”", r"\b(\d{4}-\d{2}-\d{2})\b", r"(?i)\b(v?\d+(?:\.\d+){1,3})\b",
    r"(?i)\b((?:ISO|SOC|NIST|GDPR|HIPAA|PCI(?: DSS)?|CFR)\s*[A-Z0-9.-]*)\b",
    r"(?i)\b((?:article|section|clause|policy|case|ticket|contract)\s+(?:no\.?\s*)?[A-Z0-9][A-Z0-9._/-]*)\b",
    r"\b(\d{2}(?:-\d{2}){1,2})\b", r"\b([A-Z][A-Z0-9]{1,}(?:[/-][A-Z0-9]+)*)\b", r"\b([A-Za-z0-9]+(?:-[A-Za-z0-9]+){1,})\b",
]


def protected_entities(question: Column) -> Column:
    """Identifiers in a question, in order of extraction, the first spelling of each."""
    found = F.concat(*(F.regexp_extract_all(question, F.lit(p), 1) for p in ENTITY_PATTERNS))
    return F.aggregate(
        found, F.array().cast("array<string>"),
        lambda kept, x: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(x)), kept).otherwise(F.array_append(kept, x)),
    )


def citation_markers(answer: Column) -> Column:
    """The numbers of the ``[n]`` markers in an answer."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int"))


def evidence_columns(route: Column, needs_graph: Column, approved: Column, n_citations: Column, n_raw: Column, mode: Column, clarification: Column, error: Column) -> dict[str, Column]:
    """Sufficiency, status and the reason for raw evidence, of one retrieval a row."""
    sufficiency = (
        F.when(error, "none").when(clarification, "weak")
        .when(approved & (route == "hybrid"), "partial").when(approved & needs_graph & (mode != "graph"), "partial").when(approved, "strong")
        .when(n_citations > 0, "weak").otherwise("none")
    )
    status = (
        F.when(error, "retrieval_error").when(clarification, "weak_evidence").when(n_citations == 0, "no_evidence")
        .when(approved, "approved_evidence").otherwise("discovery_evidence")
    )
    reason = (
        F.when(n_raw == 0, "not_invoked").when(route == "rag_only", "raw_discovery_route").when(approved & (route == "hybrid"), "hybrid_supporting_context")
        .when(approved & needs_graph, "graph_evidence_gap").otherwise("approved_knowledge_miss")
    )
    return {"sufficiency": sufficiency, "status": status, "raw_reason": reason}


def validate_answers(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """Violation codes of answers (answer_id, answer, route, error) against their citations.

    ``citations`` has answer_id, index, title, text, page_start, page_end,
    source_type and covered (how many concepts cover a raw chunk). Violations of
    single citations carry their zero-based place.
    """
    at = F.row_number().over(Window.partitionBy("answer_id").orderBy("index")) - 1
    held = citations.withColumn("_at", at)
    place = F.col("_at").cast("string")
    code = lambda cond, name: F.when(cond, F.concat(F.lit(name + ":"), place))
    own = F.array_compact(F.array(
        code(F.col("index") != F.col("_at") + 1, "citation_index_mismatch"),
        code((F.trim("title") == "") | (F.trim("text") == ""), "citation_missing_source_details"),
        code((F.col("page_start") < 1) | (F.col("page_end") < F.col("page_start")), "citation_invalid_page_range"),
        code(~F.col("source_type").isin("okf", "rag"), "citation_unknown_source_type"),
    ))
    raw = (F.col("source_type") == "rag") & (F.col("covered") == 0)
    per = held.groupBy("answer_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(raw).alias("n_raw"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", own.alias("codes")))), lambda x: x["codes"])).alias("codes"),
    )
    joined = answers.join(per, "answer_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    markers = citation_markers(F.col("answer"))
    cited = F.exists(markers, lambda m: (m >= 1) & (m <= F.col("n")))
    all_valid = (F.size(markers) > 0) & F.forall(markers, lambda m: (m >= 1) & (m <= F.col("n")))
    some = F.concat(
        F.array_compact(F.array(F.when(F.col("error"), F.lit("citations_present_after_retrieval_error")))), F.coalesce("codes", F.array().cast("array<string>")),
        F.array_compact(F.array(
            F.when(~cited, F.lit("answer_missing_valid_citation_marker")),
            F.when((F.col("route") == "okf_only") & (F.col("n_raw") > 0), F.lit("raw_rag_used_without_okf_fallback_label")),
        )),
    )
    none = F.array_compact(F.array(F.when(F.size(markers) > 0, F.lit("citation_marker_without_source"))))
    out = joined.withColumn("violations", F.when(F.col("n") == 0, none).otherwise(some)).withColumn("markers_valid", all_valid)
    mode = F.when(F.col("n") == 0, "answer_with_missing_evidence").when(F.size("violations") > 0, "fallback_to_cited_evidence").otherwise("release_as_written")
    return out.select(*answers.columns, "violations", (F.size("violations") == 0).alias("passes"), mode.alias("mode"), "markers_valid")


def merge_bundles(evidence: DataFrame, approved_most: int = 4, raw_most: int = 6) -> DataFrame:
    """Merge evidence of several bundles a query: (query_id, route, bundle, index, source_type, provenance, covered).

    Trust first (human, automated, other, raw), then bundle and place. A query on
    approved knowledge that has some drops raw evidence that no concept covers.
    """
    trust = (
        F.when(F.col("source_type") == "rag", 3).when(F.col("provenance") == "human", 0).when(F.col("provenance") == "automated", 1).otherwise(2)
    )
    approved = F.max(F.when(F.col("source_type") == "okf", 1).otherwise(0)).over(Window.partitionBy("query_id"))
    held = evidence.withColumns({"trust": trust, "_approved": approved})
    held = held.filter(~((F.col("route") == "okf_only") & (F.col("_approved") == 1) & (F.col("source_type") == "rag") & (F.col("covered") == 0)))
    order = [F.col("trust"), F.col("bundle"), F.col("index")]
    place = F.row_number().over(Window.partitionBy("query_id", "source_type").orderBy(*order))
    most = F.when(F.col("source_type") == "okf", approved_most).otherwise(raw_most)
    kept = held.withColumn("_place", place).filter((F.col("_place") <= most) & ~((F.col("route") == "rag_only") & (F.col("source_type") == "okf")))
    new = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("source_type"), *order))
    return kept.withColumn("new_index", new).drop("_place", "_approved")


def conflicting_values(citations: DataFrame) -> DataFrame:
    """Pairs of citations from different bundles that share two title terms but not their values.

    ``citations`` has query_id, bundle, citation_id, title_terms and values; pairs
    meet through a common title term of the same query.
    """
    held = citations.filter(F.size("values") > 0)
    side = lambda p: held.select("query_id", F.explode(F.array_distinct("title_terms")).alias("term"), *(F.col(c).alias(f"{p}_{c}") for c in ("bundle", "citation_id", "values")))
    met = side("l").join(side("r"), ["query_id", "term"]).filter("l_citation_id < r_citation_id and l_bundle <> r_bundle")
    pairs = met.groupBy("query_id", "l_citation_id", "r_citation_id").agg(F.count(F.lit(1)).alias("n_terms"), F.first("l_values").alias("lv"), F.first("r_values").alias("rv"))
    differ = F.array_sort(F.array_distinct("lv")) != F.array_sort(F.array_distinct("rv"))
    return pairs.filter((F.col("n_terms") >= 2) & differ).select("query_id", "l_citation_id", "r_citation_id", "n_terms")


def clarification_fields(candidates: DataFrame, most_options: int = 8, most_fields: int = 2) -> DataFrame:
    """Fields that tell near misses apart: (query_id, candidate, field, position, value) rows in, usable fields out.

    Every candidate must have a value, there are 2 to ``most_options`` values, and they split the candidates.
    """
    n = candidates.groupBy("query_id").agg(F.count_distinct("candidate").alias("n_candidates"))
    value = F.lower("value")
    options = candidates.groupBy("query_id", "field", "position", value.alias("option")).agg(F.array_join(F.array_sort(F.collect_set(F.col("candidate").cast("string"))), "|").alias("subset"))
    split = options.groupBy("query_id", "field", "position").agg(F.count(F.lit(1)).alias("n_options"), F.count_distinct("subset").alias("n_subsets"))
    full = candidates.groupBy("query_id", "field").agg(F.count_distinct("candidate").alias("n_with"))
    usable = split.join(full, ["query_id", "field"]).join(n, "query_id")
    usable = usable.filter((F.col("n_with") == F.col("n_candidates")) & (F.col("n_candidates") >= 2) & F.col("n_options").between(2, most_options) & (F.col("n_subsets") >= 2))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    return usable.withColumn("rank", order).filter(F.col("rank") <= most_fields).select("query_id", "field", "n_options", "rank")
