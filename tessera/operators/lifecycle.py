"""Lifecycle, approval, coverage and upkeep of keyed tables, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The states of a concept.
LIFECYCLE = ("active", "archived", "deleting", "deleted", "retracted")


def lifecycle_status(status: Column) -> Column:
    """The status, where a missing or unknown one means active; letters count as they are written."""
    return F.when(status.isin(*LIFECYCLE), status).otherwise("active")


def only_active(rows: DataFrame, lifecycle: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a lifecycle row that says otherwise."""
    gone = lifecycle.filter(lifecycle_status(F.col("status")) != "active").select(*keys)
    return rows.join(gone, keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_at", at).filter(F.col("_at") <= n).drop("_at")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows, those of changed keys replaced by the changes (the last writer's, one a key)."""
    return current.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def reconcile(held: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """What a link table needs to become the wanted one: each key with insert, delete or keep."""
    both = held.select(*keys).distinct().withColumn("_held", F.lit(1)).join(wanted.select(*keys).distinct().withColumn("_wanted", F.lit(1)), keys, "full")
    action = F.when(F.col("_held").isNull(), "insert").when(F.col("_wanted").isNull(), "delete").otherwise("keep")
    return both.select(*keys, action.alias("action"))


def overlapping(left: DataFrame, right: DataFrame, group: str, left_id: str, right_id: str, element: str) -> DataFrame:
    """Pairs of sets within a group that share an element, with how many.

    Both sides hold one row an element, so the pairs come from an equi-join on
    group and element and no set is compared with all others.
    """
    b = right.select(group, F.col(right_id).alias("other_id"), element).distinct()
    pairs = left.select(group, F.col(left_id).alias("set_id"), element).distinct().join(b, [group, element])
    return pairs.groupBy(group, "set_id", "other_id").agg(F.count(F.lit(1)).alias("n_shared"))


def not_overlapping(rows: DataFrame, taken: DataFrame, group: str, set_id: str, element: str) -> DataFrame:
    """Ids of the sets that share no element with the taken ones of their group."""
    hit = rows.join(taken.select(group, element).distinct(), [group, element], "left_semi").select(group, set_id).distinct()
    return rows.select(group, set_id).distinct().join(hit, [group, set_id], "left_anti")


def coverage_arrays(rows: DataFrame, links: DataFrame, key: str, linked: str) -> DataFrame:
    """``rows`` with the sorted array of what is linked to each, empty where nothing is."""
    held = links.groupBy(key).agg(F.array_sort(F.collect_set(linked)).alias("covered_by"))
    kind = dict(links.dtypes)[linked]
    return rows.join(held, key, "left").withColumn("covered_by", F.coalesce("covered_by", F.array().cast(f"array<{kind}>")))


def run_outcome(items: DataFrame, run: str, status: str) -> DataFrame:
    """Counts of each run's items and what they make of the run."""
    counts = items.groupBy(run).agg(
        F.count_if(F.col(status) == "done").alias("n_done"), F.count_if(F.col(status) == "failed").alias("n_failed"),
        F.count_if(~F.col(status).isin("done", "failed")).alias("n_open"),
    )
    outcome = (
        F.when(F.col("n_open") > 0, "running").when(F.col("n_failed") == 0, "completed")
        .when(F.col("n_done") == 0, "failed").otherwise("completed_with_errors")
    )
    return counts.withColumn("outcome", outcome)


def error_codes(**failed: Column) -> Column:
    """The names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in failed.items())))


def page_context(pages: DataFrame, spans: DataFrame, document: str, page: str, margin: int = 2) -> DataFrame:
    """Pages within ``margin`` of each span (span_id, start, end) of the same document.

    The span is unfolded into page numbers, so the range condition is an equi-join.
    """
    wanted = spans.withColumn(page, F.explode(F.sequence(F.greatest(F.lit(1), F.col("start") - margin), F.col("end") + margin)))
    return wanted.join(pages, [document, page])


# Tokens that may be embedded of a document, of a workspace a day, and overall a day.
BUDGETS = {"document": 250_000, "workspace": 1_000_000, "global": 5_000_000}


def budget_verdict(tokens: Column, workspace_used: Column, global_used: Column, **most: int) -> Column:
    """The first budget that embedding ``tokens`` more would exceed, else ok."""
    caps = {**BUDGETS, **most}
    return (
        F.when(tokens > caps["document"], "document_budget_exceeded").when(workspace_used + tokens > caps["workspace"], "workspace_budget_exceeded")
        .when(global_used + tokens > caps["global"], "global_budget_exceeded").otherwise("ok")
    )


def job_totals(chunks: DataFrame, results: DataFrame, job: str = "job_id") -> DataFrame:
    """Each job's estimated tokens over its chunks (job, tokens), and how its results (job, status) came out; zeros where it has none."""
    tokens = chunks.groupBy(job).agg(F.sum("tokens").alias("token_estimate"), F.count(F.lit(1)).alias("n_chunks"))
    count = lambda s: F.count_if(F.col("status") == s)
    synced = results.groupBy(job).agg(count("synced").alias("synced"), count("skipped-unchanged").alias("skipped_unchanged"), count("failed").alias("failed"))
    return tokens.join(synced, job, "full").fillna(0)
