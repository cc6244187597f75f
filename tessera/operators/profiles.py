"""Bundle profiles, topic reconciliation, relation blocks and entity containment, as column expressions and row-wise plans without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
BASE_FIELDS = ("title", "description", "tags", "updated")
UNASKABLE = (
    "coverage_type", "covered_rag_chunk_ids", "approved_at", "approved_by", "knowledge_version", "last_verified",
    "relations", "review_status", "revision", "source_authority", "source_pages",
)
ASKABLE_TYPES = ("date", "number", "string", "string_array")
RELATION_NAME = "^[a-z][a-z0-9_]{0,63}$"
STOPWORD = "^[a-z0-9][a-z0-9_-]{0,63}$"
MOST_STOPWORDS = 256
MUTABLE = ("needs_review", "needs_cleanup")
FRONTMATTER = r"\A---\r?\n([\s\S]*?)\r?\n---"
RELATIONS_BLOCK = r"(?m)\n[ \t]*relations:[ \t]*$(\n[ \t]{2,}-[^\n]*(\n[ \t]{4,}\w[^\n]*)*)*"


def profile_errors() -> Column:
    """The errors of a profile, in order.

    Reads agent_retry, auto_approve (boolean; null is invalid), fields, kinds (names
    and their types, in one order), required, types, clarifications, relations and
    stopwords (arrays; null stopwords are invalid, other nulls are empty).
    """
    held = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    fields, asked = held("fields"), held("clarifications")
    kind = lambda name: F.try_element_at("kinds", F.nullif(F.array_position(fields, name), F.lit(0)).cast("int"))
    code = lambda cond, name: F.when(cond, F.lit(name))
    of = lambda name, field: F.concat(F.lit(f"knowledge_profile_{name}:"), field)

    def clarification(field: Column, at: Column) -> Column:
        wrong = F.when(F.array_contains(F.slice(asked, 1, at), field), of("clarification_field_duplicate", field))
        wrong = wrong.when(~F.array_contains(fields, field), of("clarification_field_unknown", field))
        wrong = wrong.when(field.isin(*UNASKABLE), of("clarification_field_prohibited", field))
        return wrong.when(~F.coalesce(kind(field).isin(*ASKABLE_TYPES), F.lit(False)), of("clarification_field_type_unsupported", field))

    sound = F.array_contains(held("required"), "type") & F.coalesce(kind(F.lit("type")) == "string", F.lit(False))
    stopwords = code(F.col("stopwords").isNull(), "knowledge_profile_relation_discovery_stopwords_invalid")
    stopwords = stopwords.when(F.size("stopwords") > MOST_STOPWORDS, F.lit("knowledge_profile_relation_discovery_stopwords_too_many"))
    stopwords = stopwords.when(F.exists("stopwords", lambda x: ~F.coalesce(x.rlike(STOPWORD), F.lit(False))), F.lit("knowledge_profile_relation_discovery_stopword_invalid"))
    first = F.array(
        code(F.col("agent_retry").isNull(), "knowledge_profile_agent_invalid"),
        code(F.col("auto_approve").isNull(), "knowledge_profile_automation_invalid"),
        code(~sound, "knowledge_profile_type_field_required"),
        *(code(~F.array_contains(fields, name), f"knowledge_profile_base_field_missing:{name}") for name in BASE_FIELDS),
        code(F.size(held("types")) == 0, "knowledge_profile_types_required"),
    )
    last = F.array(code(F.exists(held("relations"), lambda x: ~x.rlike(RELATION_NAME)), "knowledge_profile_relation_invalid"), stopwords)
    return F.array_compact(F.concat(first, F.transform(asked, clarification), last))


def reconciled(topics: DataFrame, version: int) -> DataFrame:
    """Topics that may still change, with the pages that their resolved continuations bring.

    Reads pages, resolved and proposed (arrays of page numbers), review_status,
    enrichment_status, run_id and resolver_version. A finished enrichment falls back
    to ``none`` if a promoted page was not among the proposed ones. Topics in a bulk
    run, reviewed ones and those resolved by this version give no row.
    """
    open_ = F.col("review_status").isin(*MUTABLE) & F.col("run_id").isNull() & ~F.col("resolver_version").eqNullSafe(F.lit(version))
    outside = lambda c, other: F.filter(c, lambda x: ~F.array_contains(other, x))
    found = topics.filter(open_).withColumn("promoted", outside("resolved", F.col("pages")))
    stale = (F.col("enrichment_status") == "completed") & (F.size(outside("promoted", F.col("proposed"))) > 0)
    return found.withColumns({
        "invalidated": F.coalesce(stale, F.lit(False)),
        "source_pages": F.array_sort(F.array_distinct("resolved")),
        "still_proposed": outside("proposed", F.col("resolved")),
        "page_start": F.array_min("resolved"),
        "page_end": F.array_max("resolved"),
        "enrichment_status": F.when(stale, F.lit("none")).otherwise(F.col("enrichment_status")),
        "resolver_version": F.lit(version),
    })


def quoted(value: Column) -> Column:
    """``value`` as a JSON string."""
    for char, name in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        value = F.replace(value, F.lit(char), F.lit(name))
    return F.concat(F.lit('"'), value, F.lit('"'))


def with_relations(markdown: Column, relations: Column, changed_at: Column) -> Column:
    """``markdown`` with its frontmatter's relations replaced and its date of update set; null without frontmatter.

    ``relations`` are structs of relation, target, target_type (null or empty: not written) and reason.
    """
    head = F.concat(F.lit("\n"), F.regexp_replace(F.regexp_extract(markdown, FRONTMATTER, 1), r"\r\n", "\n"))
    head = F.regexp_replace(head, RELATIONS_BLOCK, "")
    head = F.regexp_replace(head, F.lit(r"(?m)^updated:[^\n]*"), F.concat(F.lit("updated: "), F.substring(changed_at, 1, 10)))
    typed = lambda r: F.when(F.coalesce(r["target_type"], F.lit("")) != "", F.concat(F.lit("\n    target_type: "), quoted(r["target_type"]))).otherwise(F.lit(""))
    entry = lambda r: F.concat(F.lit("\n  - relation: "), quoted(r["relation"]), F.lit("\n    target: "), quoted(r["target"]), typed(r), F.lit("\n    reason: "), quoted(r["reason"]))
    block = F.when(F.size(relations) > 0, F.concat(F.lit("\nrelations:"), F.array_join(F.transform(relations, entry), ""))).otherwise(F.lit(""))
    whole = F.concat(head, block)
    rest = F.regexp_replace(markdown, FRONTMATTER, "")
    return F.when(markdown.rlike(FRONTMATTER), F.concat(F.lit("---"), F.when(whole == "", F.lit("\n")).otherwise(whole), F.lit("\n---"), rest))


def contains_entity(value: Column, entity: Column) -> Column:
    """Whether ``value`` holds ``entity`` in any case, with neither letter nor digit beside it."""
    literal = F.regexp_replace(entity, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.regexp_like(value, F.concat(F.lit("(?i)(^|[^a-z0-9])"), literal, F.lit("([^a-z0-9]|$)")))
