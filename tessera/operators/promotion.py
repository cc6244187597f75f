"""Promotion of relation suggestions to candidates that wait for their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.acceptance import suggestions_of
from tessera.operators.graph import RELATIONS, preflight
from tessera.operators.lifecycle import latest

WARNING = "preflight_warning:relation_reverse_direction_warning"
_KEY = ["source", "target", "relation"]


def topic_reference(value: Column) -> Column:
    """The topic id of ``topic:<id>``, null for anything else."""
    return F.when(value.startswith("topic:") & (F.length(value) > 6), F.substring(value, 7, F.length(value)))


def promoted(suggestions: DataFrame, topics: DataFrame, candidates: DataFrame, edges: DataFrame, files: DataFrame, allowed: tuple[str, ...] = RELATIONS) -> tuple[DataFrame, DataFrame]:
    """What becomes of each suggestion of one bundle, and the candidates afterwards.

    ``suggestions`` has position, source, target (``topic:<id>``), relation, reason,
    evidence_quote, rationale and signals; incomplete ones are not counted at all.
    ``topics`` has topic_id, review_status and exported_path; ``candidates`` source,
    target, relation, status, verification, reason and signals; ``edges`` are the
    bundle's relations and confirmed candidates, ``files`` its active files.

    Ends are resolved to the exported paths of approved topics. A suggestion is
    skipped if an end has none, if its candidate was decided, or if the preflight
    refuses it. All are held against the relations as they were, not against each
    other; a pending candidate is no duplicate of itself. Of suggestions of one
    relation all count, and the last one's reason stays.
    """
    whole = suggestions_of(suggestions)
    path = topics.filter((F.col("review_status") == "approved") & (F.coalesce("exported_path", F.lit("")) != "")).select(F.col("topic_id").cast("string").alias("_id"), "exported_path")
    end = lambda c: path.select(F.col("_id").alias(f"_{c}_id"), F.col("exported_path").alias(f"_{c}"))
    held = whole.withColumns({f"_{c}_id": topic_reference(F.col(c)) for c in ("source", "target")})
    held = held.join(end("source"), "_source_id", "left").join(end("target"), "_target_id", "left")
    unresolved = held.filter("_source is null or _target is null").select("position", F.lit("unresolved").alias("outcome"))
    named = held.filter("_source is not null and _target is not null").select("position", F.col("_source").alias("source"), F.col("_target").alias("target"), "relation", "reason", "signals")
    known = candidates.select(*_KEY, F.col("status").alias("_status"))
    met = named.join(known, _KEY, "left")
    decided = met.filter("_status <> 'pending'").select("position", F.lit("already_decided").alias("outcome"))
    asked = met.filter("_status is null or _status = 'pending'").withColumns({"target_type": F.lit(None).cast("string"), "_own": F.col("_status").isNotNull()})
    checked = preflight(asked.drop("_status"), edges, files, allowed)
    issues = F.when(F.col("_own"), F.array_remove("issues", "relation_exact_duplicate")).otherwise(F.col("issues"))
    checked = checked.withColumn("issues", issues)
    passed = checked.filter(F.size("issues") == 0)
    refused = checked.filter(F.size("issues") > 0).select("position", F.concat(F.lit("refused:"), F.array_join("issues", ",")).alias("outcome"))
    outcomes = passed.select("position", F.when(F.col("_own"), "updated").otherwise("created").alias("outcome"))
    for part in (unresolved, decided, refused):
        outcomes = outcomes.unionByName(part)
    signals = F.when(F.col("warned"), F.array_append("signals", F.lit(WARNING))).otherwise(F.col("signals"))
    last = latest(passed.withColumn("signals", signals), _KEY, [F.col("position").desc()])
    fresh = last.select(*_KEY, F.lit("pending").alias("status"), F.lit("queued").alias("verification"), "reason", "signals")
    after = candidates.join(fresh.select(*_KEY), _KEY, "left_anti").select(candidates.columns).unionByName(fresh.select(candidates.columns))
    return outcomes, after
