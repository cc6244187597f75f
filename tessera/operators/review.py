"""Review of topics and documents: eligibility, blockers, authoring checks, failure codes, drafts, deletion and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import collapsed
from tessera.operators.lifecycle import error_codes

# Codes that another try cannot change, and the limits of an unconfirmed authoring run.
FINAL_CODES = ("bulk_topic_already_processed", "bulk_topic_changed_since_confirmation", "bulk_topic_overlaps_approved", "topic_already_approved", "topic_rejected")
MOST_CONCEPTS, MOST_TOKENS, MOST_CODE = 25, 250_000, 64
NO_TEXT = "No selectable text was available for this topic."


def blank(value: Column) -> Column:
    """Null, empty or white space only."""
    return value.isNull() | ~value.rlike(r"\S")


def eligibility_codes(types: tuple[str, ...], required: tuple[str, ...]) -> Column:
    """Why a topic row cannot be approved, in order; ``types`` and ``required`` fields are the bundle profile's."""
    c = F.col
    checks = error_codes(
        topic_already_approved=c("review_status") == "approved", topic_rejected=c("review_status") == "rejected",
        topic_enrichment_not_completed=~c("enrichment_status").eqNullSafe("completed"), topic_enriched_title_required=blank(c("title")),
        topic_enriched_summary_required=blank(c("summary")), topic_enriched_body_required=blank(c("body")),
        topic_source_pages_required=F.size("pages") == 0, topic_proposed_pages_require_review=F.size("proposed") > 0,
    )
    profile = [F.when(~c("type").isin(*types), F.concat(F.lit("knowledge_profile_type_not_allowed:"), "type"))]
    profile += [F.when(F.coalesce(c(f).cast("string"), F.lit("")) == "", F.lit(f"knowledge_profile_required_field_missing:{f}")) for f in required]
    return F.concat(checks, F.array_compact(F.array(*profile)), error_codes(bulk_topic_already_processed=c("run_id").isNotNull()))


def automatic_blockers(topics: DataFrame, types: tuple[str, ...], required: tuple[str, ...]) -> DataFrame:
    """topic_id and what keeps each topic from automatic approval.

    Topics that are eligible so far also block each other where they share a page of
    a document, and an approved topic blocks those on its pages.
    """
    automatic = error_codes(
        automatic_topic_requires_needs_review=~F.col("review_status").eqNullSafe("needs_review"),
        automatic_topic_requires_high_confidence=~F.col("confidence").eqNullSafe("high"),
    )
    checked = topics.withColumn("errors", F.array_distinct(F.concat(eligibility_codes(types, required), automatic)))
    paged = lambda rows, name: rows.select("document_id", F.col("topic_id").alias(name), F.explode("pages").alias("page"))
    able = paged(checked.filter(F.size("errors") == 0), "topic_id")
    named = lambda code: F.concat(F.lit(f"{code}:"), "topic_id", F.lit(":"), "other")
    rivals = able.join(able.withColumnRenamed("topic_id", "other"), ["document_id", "page"]).filter("topic_id <> other").select("topic_id", "other").distinct()
    prior = able.join(paged(topics.filter("review_status = 'approved'"), "other"), ["document_id", "page"]).select("topic_id", "other").distinct()
    found = rivals.select("topic_id", named("bulk_topic_page_overlap").alias("code")).unionByName(prior.select("topic_id", named("bulk_topic_overlaps_approved").alias("code")))
    found = found.groupBy("topic_id").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    none = F.array().cast("array<string>")
    return checked.join(found, "topic_id", "left").select("topic_id", F.concat("errors", F.coalesce("codes", none)).alias("blockers"))


def authoring_errors() -> Column:
    """What an authored topic row lacks."""
    c = F.col
    return error_codes(
        title_required=blank(c("title")), summary_required=blank(c("summary")), source_pages_required=F.size("pages") == 0,
        enrichment_failed=c("enrichment_status") == "failed", proposed_source_pages_require_review=F.size("proposed") > 0,
    )


def costly_runs(topics: DataFrame, run: str, tokens: str, most_concepts: int = MOST_CONCEPTS, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """Runs that need a confirmation: too many concepts or too many input tokens."""
    sums = topics.groupBy(run).agg(F.count(F.lit(1)).alias("concepts"), F.sum(tokens).cast("long").alias("tokens"))
    return sums.filter((F.col("concepts") > most_concepts) | (F.col("tokens") > most_tokens))


def retryable(code: Column) -> Column:
    """Whether a failed item may be tried again; an unknown code may."""
    return ~F.coalesce(code, F.lit("")).isin(*FINAL_CODES)


def extraction_code(message: Column) -> Column:
    """The code of an extraction failure, by the first phrase that its message holds."""
    said = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *words: said.rlike("|".join(words))
    return (
        F.when(has("password"), "password_protected_pdf").when(has("malformed", "invalid", "corrupt", "xref", "trailer"), "malformed_pdf")
        .when(has("document_has_no_stored_pdf"), "missing_stored_pdf").otherwise("extraction_failed")
    )


def classification_code(value: Column, most: int = MOST_CODE) -> tuple[Column, Column]:
    """The trimmed code, null if blank or too long, and an error code for the latter."""
    code = F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", "")
    long = F.length(code) > most
    return F.when(~long & (code != ""), code), F.when(long, "classification_code_too_long")


def initial_review(confidence: Column) -> Column:
    """The first review status of a discovered topic."""
    return F.when(confidence == "low", "needs_cleanup").otherwise("needs_review")


def upload_errors(name: Column, kind: Column, size: Column, head: Column, most: int = 25 << 20) -> Column:
    """What speaks against an uploaded file: name, type, size and leading bytes."""
    return error_codes(
        pdf_name_required=~F.lower(F.coalesce(name, F.lit(""))).endswith(".pdf"), pdf_type_required=~kind.eqNullSafe("application/pdf"),
        pdf_empty=F.coalesce(size, F.lit(0)) == 0, pdf_too_large=size > most, pdf_magic_missing=~head.eqNullSafe("%PDF-"),
    )


def discovered_topics(topics: DataFrame, pages: DataFrame) -> DataFrame:
    """Valid topics (document_id, topic_id, title, summary, pages) of each document, the first of each title.

    Titles are stripped of bullets and a closing mark; junk titles, topics without a
    summary and topics without a page of the document go. ``position`` follows the
    first page, then the title.
    """
    title = F.regexp_replace(F.col("title"), r"^[-•*\s]+", "")
    topics = topics.withColumn("title", F.regexp_replace(F.trim(F.regexp_replace(title, r"\s+", " ")), r"[,:;]$", ""))
    title = F.col("title")
    junk = (
        (F.length(title) < 4) | (F.length(title) > 140) | title.rlike(r"^\d+([./-]\d+)*$") | title.rlike(r"(?i)^(page|figure|table)\s+\d+")
        | title.rlike(r"(?i)^(warning|caution|note)\s*:") | title.rlike(r"^[a-z]") | title.rlike(r"[.!?]$") | (F.size(F.split(title, " ")) > 18)
    )
    kept = topics.filter(~junk & ~blank(F.col("summary")))
    paged = kept.select("document_id", "topic_id", F.explode(F.array_distinct("pages")).alias("page")).join(pages.select("document_id", "page").distinct(), ["document_id", "page"])
    held = paged.groupBy("topic_id").agg(F.sort_array(F.collect_list("page")).alias("pages"))
    first = Window.partitionBy("document_id", F.lower("title")).orderBy("topic_id")
    rows = kept.drop("pages").join(held, "topic_id").withColumn("_nth", F.row_number().over(first)).filter("_nth = 1")
    order = Window.partitionBy("document_id").orderBy(F.get("pages", 0), "title", "topic_id")
    return rows.select("document_id", "topic_id", "title", "pages", F.row_number().over(order).alias("position"))


def proposed_pages(proposed: Column, window: Column, sourced: Column) -> Column:
    """Proposed pages that lie in the source window and are no source yet, once each, ascending."""
    return F.sort_array(F.array_except(F.array_intersect(proposed, window), sourced))


def topic_summaries(topics: DataFrame, pages: DataFrame, most: int = 180) -> DataFrame:
    """topic_id and the joined text of its pages in order, collapsed and cut to ``most`` characters.

    Pages are collapsed whole before the join, and then no more of each is carried
    than the cut could show.
    """
    paged = topics.select("topic_id", "document_id", F.explode_outer(F.array_distinct("pages")).alias("page"))
    shown = pages.select("document_id", "page", F.left(collapsed(F.col("text")), F.lit(most + 2)).alias("text"))
    texts = paged.join(shown, ["document_id", "page"], "left")
    joined = texts.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("page", "text")))).alias("held"))
    text = collapsed(F.array_join(F.transform("held", lambda x: x["text"]), " "))
    short = F.when(F.length(text) <= most, text).otherwise(F.concat(F.trim(F.left(text, F.lit(most - 3))), F.lit("...")))
    return joined.select("topic_id", F.coalesce(F.nullif(short, F.lit("")), F.lit(NO_TEXT)).alias("summary"))


def discovery_errors(topics: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id and error of every document of which topics were proposed but none is valid."""
    valid = discovered_topics(topics, pages).select("document_id").distinct()
    none = topics.select("document_id").distinct().join(valid, "document_id", "left_anti")
    return none.withColumn("error", F.lit("topic_discovery_no_valid_topics"))


def regenerated(drafts: DataFrame, fresh: DataFrame, document: str = "document_id", topic: str = "topic_id") -> DataFrame:
    """Topics (document, topic, pages, review_status, ...) after a document is discovered anew.

    Its old drafts are replaced, what a reviewer decided stays, and fresh topics that
    share a page with a decided one of their document are left out.
    """
    settled = F.col("review_status").isin("approved", "rejected")
    decided = drafts.filter(settled)
    untouched = drafts.filter(~settled).join(fresh.select(document).distinct(), document, "left_anti")
    paged = lambda rows, *c: rows.select(*c, F.explode("pages").alias("_page"))
    hit = paged(fresh, document, topic).join(paged(decided, document).distinct(), [document, "_page"], "left_semi").select(document, topic).distinct()
    return decided.unionByName(untouched).unionByName(fresh.join(hit, [document, topic], "left_anti").select(drafts.columns))


def merged_boundaries(old: DataFrame, new: DataFrame, key: tuple[str, ...] = ("topic_id", "from_page", "to_page")) -> DataFrame:
    """Boundary records of both, the later of each key."""
    both = old.withColumn("_late", F.lit(0)).unionByName(new.withColumn("_late", F.lit(1)))
    last = Window.partitionBy(*key).orderBy(F.col("_late").desc())
    return both.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth", "_late")


def orphan_runs(runs: DataFrame, items: DataFrame, run: str = "run_id") -> DataFrame:
    """Runs that no remaining item belongs to."""
    return runs.join(items.select(run).distinct(), run, "left_anti")


def lifecycle_upsert(held: DataFrame, changes: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lifecycle rows and embeddings after changes (path, status, reason, changed_at), and the changes that were refused.

    A change without a reason is refused; of several the latest counts; embeddings
    of concepts that are no longer active go.
    """
    refused = changes.filter(blank(F.col("reason"))).withColumn("error", F.lit("okf_lifecycle_reason_required"))
    last = Window.partitionBy("path").orderBy(F.col("changed_at").desc(), "status", "reason")
    taken = changes.filter(~blank(F.col("reason"))).withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth")
    rows = held.join(taken.select("path"), "path", "left_anti").unionByName(taken.select(held.columns))
    return rows, embeddings.join(rows.filter("status <> 'active'").select("path"), "path", "left_anti"), refused
