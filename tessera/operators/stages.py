"""Processing stages of documents, as of a date, from the latest job of each kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.articles import stage_header

# The stages in order, with the label and detail that each shows by itself.
STAGES = {
    "upload": ("PDF uploaded", "The source PDF is stored securely in its assigned knowledge bundle."),
    "extraction": ("Text extraction", "Reading the PDF and creating page-level source records."),
    "metadata_discovery": ("Metadata discovery", "Identifying useful document metadata from the extracted source."),
    "concept_discovery": ("Concept discovery", "Finding and consolidating the concepts discussed in the document."),
    "enrichment": ("Topic enrichment", "Preparing grounded titles, summaries, and article content for review."),
    "relation_classification": ("Relation classification", "Identifying possible relationships between concepts for later review."),
    "validation": ("Validation", "Checking source coverage, metadata readiness, and review requirements."),
    "review_export": ("Review and export", "Preparing reviewed knowledge for approval and bundle export."),
}
EXTRACTED = {"failed": "Text extraction failed. Review the error and retry the stored PDF.", "completed": "Page-level source records are ready for downstream processing."}
NEXT_ACTION = "Extraction is complete. Start AI-assisted authoring when you are ready."
NEEDED = {
    "awaiting_provider": "Configure an AI provider before this workflow can continue.",
    "awaiting_cost_confirmation": "Review the estimated authoring cost before enrichment continues.",
}
AUTHORING = tuple(STAGES)[2:7]
KINDS = ("extraction", "authoring", "approval")


def latest_jobs(jobs: DataFrame, as_of: Column) -> DataFrame:
    """One row a document with the latest job of each kind up to a date, as structs; one pass, combined before the shuffle.

    ``jobs`` has document_id, kind, job_id, created_at, status, current_stage,
    completed_stages, error, automatic, n_done, n_total, n_failed. Of jobs of one
    moment the larger id counts.
    """
    held = jobs.filter(F.col("created_at") <= as_of)
    whole = F.struct(*(c for c in jobs.columns if c not in ("document_id", "kind")))
    pick = lambda k: F.max_by(F.when(F.col("kind") == k, whole), F.when(F.col("kind") == k, F.struct("created_at", "job_id"))).alias(k)
    return held.groupBy("document_id").agg(*(pick(k) for k in KINDS))


def _stage(name: str, status: Column, detail: Column | None = None) -> Column:
    label, own = STAGES[name]
    return F.struct(F.lit(name).alias("id"), F.lit(label).alias("label"), status.alias("status"), F.coalesce(detail, F.lit(own)).alias("detail") if detail is not None else F.lit(own).alias("detail"))


def _authored(name: str, run: Column) -> Column:
    """An authoring stage: done, waiting for its turn, or what the run's status makes of it."""
    state, done = run["status"], F.coalesce(F.array_contains(run["completed_stages"], name), F.lit(False))
    current = run["current_stage"].eqNullSafe(F.lit(name))
    acting = F.when(state == "failed", "failed").when(state.isin(*NEEDED), "action_required").when(state == "queued", "queued").otherwise("running")
    status = F.when(run.isNull(), "waiting").when(done, "completed").when(~current, "waiting").otherwise(acting)
    progress = F.when((name == "concept_discovery") & (run["n_total"] > 0), F.format_string("Analyzed %d of %d document windows.", run["n_done"], run["n_total"]))
    stuck = F.when(state == "failed", F.coalesce(run["error"], F.lit(f"{STAGES[name][0]} failed.")))
    for needed, text in NEEDED.items():
        stuck = stuck.when(state == needed, text)
    detail = F.when(run.isNull(), F.lit(None)).when(done, progress).when(current, F.coalesce(stuck, progress))
    return _stage(name, status, detail)


def _review(run: Column, approval: Column, topics: Column) -> Column:
    """The last stage: manual review, or the state of the automatic approval."""
    ready = run["status"].isin("ready_for_review", "completed")
    manual = ~F.coalesce(run["automatic"], F.lit(False))
    state = approval["status"]
    known = {"queued": "queued", "running": "running", "completed": "completed", "completed_with_failures": "action_required"}
    automatic = F.when(approval.isNull(), "queued")
    for given, shown in known.items():
        automatic = automatic.when(state == given, shown)
    status = F.when(F.coalesce(~ready, F.lit(True)), "waiting").when(manual, "action_required").otherwise(automatic.otherwise("failed"))
    done, failed = approval["n_done"], approval["n_failed"]
    active = approval["n_total"] - done - failed
    is_are = F.when(topics == 1, "topic is").otherwise("topics are")
    was_were = F.when(done == 1, "topic was").otherwise("topics were")
    told = (
        F.when(approval.isNull(), "Preparing eligible topics for automatic approval and export.").when(state == "queued", "Automatic approval and export are queued.")
        .when(state == "running", F.format_string("%d completed, %d still processing, %d failed or skipped.", done, active, failed))
        .when(state == "completed", F.format_string("%d %s approved and exported automatically.", done, was_were))
        .when(state == "completed_with_failures", F.format_string("%d succeeded; %d require review or retry.", done, failed))
        .when(failed > 0, F.format_string("%d automatic approval items failed.", failed)).otherwise("Automatic approval and export failed.")
    )
    detail = F.when(F.coalesce(~ready, F.lit(True)), F.lit(None)).when(manual, F.format_string("%d %s ready for human review.", topics, is_are)).otherwise(told)
    return _stage("review_export", status, detail)


def processing_stages(documents: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """Documents (document_id, stored, n_topics) with their eight stages, in order, and whether authoring began.

    Nothing after the extraction is told before it is completed; then authoring asks
    to be started, or its stages follow the latest run.
    """
    held = documents.join(latest_jobs(jobs, as_of), "document_id", "left")
    extracted = F.coalesce(F.col("extraction.status"), F.lit("queued"))
    over = extracted == "completed"
    run, approval = F.when(over, F.col("authoring")), F.col("approval")
    held = held.withColumns({"_run": run, "_approval": approval})
    run, approval = F.col("_run"), F.col("_approval")
    first = _stage("upload", F.when(F.coalesce("stored", F.lit(False)), "completed").otherwise("skipped"))
    texts = F.when(extracted == "failed", EXTRACTED["failed"]).when(over, EXTRACTED["completed"])
    begin = F.when(over & run.isNull(), F.struct(F.lit(AUTHORING[0]).alias("id"), F.lit(STAGES[AUTHORING[0]][0]).alias("label"), F.lit("action_required").alias("status"), F.lit(NEXT_ACTION).alias("detail")))
    authored = [_authored(n, run) for n in AUTHORING]
    stages = F.array(first, _stage("extraction", extracted, texts), F.coalesce(begin, authored[0]), *authored[1:], _review(run, approval, F.col("n_topics")))
    return held.select(*documents.columns, stages.alias("stages"), run.isNotNull().alias("authored"))


def processing_states(staged: DataFrame) -> DataFrame:
    """``processing_stages`` with current stage, label and detail, tone, and whether the document is active, ended, and shown in the header."""
    current, tone, terminal = stage_header(F.col("stages"))
    rows = staged.withColumns({"current": current, "tone": tone, "terminal": terminal})
    own = F.get(F.filter("stages", lambda s: s["id"] == F.col("current")), 0)
    active = F.exists("stages", lambda s: s["status"].isin("running", "queued"))
    troubled = F.exists("stages", lambda s: s["status"].isin("failed", "action_required"))
    return rows.withColumns({"label": own["label"], "detail": own["detail"], "active": active, "shown": active | troubled | ~F.col("authored")})
