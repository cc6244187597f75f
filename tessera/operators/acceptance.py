"""Whether a model's rewrite or retry of a question is taken, by ordered reasons; the model's output is a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import collapsed, normalized
from tessera.operators.profiles import contains_entity
from tessera.operators.routing import ascii_bounds, protected_entities, route_questions

# What is assumed where the context stays open, and the limits of a retry.
SAFE_DEFAULTS = {
    "applicable_scope_or_version": "all available scopes and versions", "intended_action": "informational guidance only, not authorization to act",
    "source_authority": "approved OKF first, with raw documents only as labeled discovery", "subject_or_entity": "all subjects represented in the workspace",
}
SCOPE_CHANGE = r"(?i)\b(?:bundle|workspace)\s*(?:id|scope)?\s*[:=]\s*[a-z0-9_-]+"
MOST_REASON, MOST_RETRY = 500, 2000
_ASSUMPTION = "array<struct<field:string,value:string,basis:string>>"


def _without_repeats(values: Column) -> Column:
    """Non-empty values, the first spelling of each."""
    fresh = lambda kept, x: (x != "") & ~F.exists(kept, lambda k: F.lower(k) == F.lower(x))
    return F.aggregate(values, F.array().cast("array<string>"), lambda kept, x: F.when(fresh(kept, x), F.array_append(kept, x)).otherwise(kept))


def _rerouted(rows: DataFrame, query: str, prefix: str) -> DataFrame:
    """``rows`` with the route and the graph flag that the router gives ``query``."""
    routed = route_questions(rows.withColumn("_ask", F.coalesce(query, F.lit(""))), "_ask")
    return routed.drop("_ask", "category").withColumnsRenamed({"route": f"{prefix}_route", "needs_graph": f"{prefix}_graph", "confidence": f"{prefix}_confidence"})


def rewrite_outcomes(rewrites: DataFrame) -> DataFrame:
    """query_id, mode (llm or fallback_original), query, warning, assumptions and entities of each proposed rewrite.

    ``rewrites`` has query_id, question, origin (the question that a clarification
    followed, or null), context (array), route, needs_graph, required (context
    fields), asked (whether a clarification was asked), rewrite, entities and
    assumptions (field, value, basis). A rewrite is refused as malformed, for invalid
    assumptions, for a lost entity, or since the router would send it elsewhere, in
    this order; the question stands in then, with safe defaults if it was asked.
    """
    held = rewrites.withColumnsRenamed({"route": "given_route", "needs_graph": "given_graph"})
    # The origin and the question, once each, and all that was said.
    parts = F.array(collapsed(F.coalesce("origin", F.lit(""))), collapsed(F.coalesce("question", F.lit(""))))
    held = held.withColumn("seed", F.array_join(_without_repeats(parts), " "))
    said = F.concat_ws(" ", F.array("seed"), F.coalesce("context", F.array().cast("array<string>")))
    held = held.withColumns({"said": said, "kept": protected_entities(F.col("seed"))})
    none = F.array().cast(_ASSUMPTION)
    known = F.filter(F.coalesce("required", F.array().cast("array<string>")), lambda f: f.isin(*SAFE_DEFAULTS))
    wanted = F.filter(F.coalesce("assumptions", none), lambda a: F.array_contains(F.col("_known"), a["field"]))
    clean = F.transform(wanted, lambda a: F.struct(a["field"].alias("field"), collapsed(a["value"]).alias("value"), a["basis"].alias("basis")))
    held = held.withColumn("_known", known).withColumn("_given", F.when(F.coalesce("asked", F.lit(False)), clean).otherwise(none))
    default = F.create_map(*(F.lit(x) for pair in SAFE_DEFAULTS.items() for x in pair))
    wrong = F.exists("_given", lambda a: (F.coalesce(a["value"], F.lit("")) == "") | ((a["basis"] == "conversation") & ~contains_entity(F.col("said"), a["value"])) | ((a["basis"] == "safe_default") & (a["value"] != F.element_at(default, a["field"]))))
    repeated = F.size(F.array_distinct(F.transform("_given", lambda a: a["field"]))) < F.size("_given")
    grounded = F.filter("_given", lambda a: (a["basis"] == "conversation") & ~contains_entity(F.col("_plain"), a["value"]))
    held = held.withColumns({"_wrong": F.coalesce(wrong, F.lit(False)) | repeated, "_plain": collapsed(F.coalesce("rewrite", F.lit("")))})
    held = held.withColumn("_query", collapsed(F.concat_ws(" ", F.concat(F.array("_plain"), F.transform(grounded, lambda a: a["value"])))))
    held = _rerouted(held, "_query", "new")
    lost = F.exists("kept", lambda e: ~contains_entity(F.col("_query"), e))
    moved = (F.col("new_route") != F.col("given_route")) | (F.col("new_graph") != F.coalesce("given_graph", F.lit(False)))
    warning = (
        F.when(F.col("_plain") == "", "query_understanding_malformed_response").when(F.col("_wrong"), "query_understanding_invalid_assumptions")
        .when(lost, "query_understanding_dropped_protected_entity").when(moved, "optimized_query_route_conflict")
    )
    held = held.withColumn("warning", warning)
    taken = F.col("warning").isNull()
    safe = F.transform(F.array_distinct("_known"), lambda f: F.struct(f.alias("field"), F.element_at(default, f).alias("value"), F.lit("safe_default").alias("basis")))
    fallback = F.when(F.coalesce("asked", F.lit(False)), safe).otherwise(none)
    own = F.filter(F.transform(F.coalesce("entities", F.array().cast("array<string>")), lambda e: F.trim(e)), lambda e: (e != "") & contains_entity(F.col("said"), e) & contains_entity(F.col("_query"), e))
    return held.select(
        "query_id", F.when(taken, "llm").otherwise("fallback_original").alias("mode"), F.when(taken, F.col("_query")).otherwise(F.col("seed")).alias("query"), "warning",
        F.when(taken | (F.col("warning") == "optimized_query_route_conflict"), F.col("_given")).otherwise(fallback).alias("assumptions"),
        F.when(taken, _without_repeats(F.concat("kept", own))).otherwise(F.col("kept")).alias("entities"),
        F.when(F.col("warning") == "optimized_query_route_conflict", F.col("new_route")).alias("conflicting_route"),
    )


def retry_outcomes(retries: DataFrame) -> DataFrame:
    """query_id, eligible, outcome and the query of each bounded retry, null unless it is applied.

    ``retries`` has query_id, question, route, needs_graph, sufficiency, enabled
    (bundles that allow a retry), call (null, missing_key or provider_failed), retry
    and reason. The first reason that holds is the outcome.
    """
    held = retries.withColumnsRenamed({"route": "given_route", "needs_graph": "given_graph"}).withColumn("_query", collapsed(F.coalesce("retry", F.lit(""))))
    held = _rerouted(held, "_query", "new")
    open_ = F.size(F.coalesce("enabled", F.array().cast("array<string>"))) > 0
    eligible = open_ & F.coalesce(F.col("sufficiency").isin("weak", "partial"), F.lit(False))
    fits = lambda c, most: F.length(F.trim(F.coalesce(c, F.lit("")))).between(1, most)
    moved = (F.col("new_route") != F.col("given_route")) | (F.col("new_graph") != F.coalesce("given_graph", F.lit(False)))
    lost = F.exists(protected_entities(F.col("question")), lambda e: ~contains_entity(F.col("_query"), e))
    compared = lambda c: F.lower(normalized(collapsed(F.coalesce(c, F.lit(""))), "NFKC"))
    outcome = (
        F.when(~open_, "disabled").when(~eligible, "not_eligible").when(F.col("call").isin("missing_key", "provider_failed"), F.col("call"))
        .when(~(fits("reason", MOST_REASON) & fits("retry", MOST_RETRY)), "malformed_response").when(moved, "rejected_route_change")
        .when(F.col("_query").rlike(ascii_bounds(SCOPE_CHANGE)), "rejected_scope_change").when(lost, "rejected_identifier_loss")
        .when(compared("_query") == compared("question"), "rejected_equivalent_query").otherwise("applied")
    )
    held = held.withColumns({"eligible": eligible, "outcome": outcome})
    return held.select("query_id", "eligible", "outcome", F.when(F.col("outcome") == "applied", F.col("_query")).alias("query"))


def suggestions_of(rows: DataFrame) -> DataFrame:
    """Relation suggestions without those that lack a relation, an end, a reason or a quote; a missing rationale is the reason."""
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    whole = said("relation") & said("source") & said("target") & said("reason") & said("evidence_quote")
    signals = F.filter(F.coalesce("signals", F.array().cast("array<string>")), lambda s: s.isNotNull())
    return rows.filter(whole).withColumns({"rationale": F.coalesce("rationale", "reason"), "signals": signals})
