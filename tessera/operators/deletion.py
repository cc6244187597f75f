"""Permanent deletion of documents: the request, and the change set over all tables that know the document.

Both steps take and return a dict of tables, so that they can be applied again:
a document that has a job is not requested anew, and a job that ran is gone, so a
second run changes nothing. Everything is a keyed join; the number of jobs in one
run is not limited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.lifecycle import upsert

# What stands in place of an answer, and files of a bundle that are no concepts.
DELETED_ANSWER = "This answer was removed because its supporting source was permanently deleted."
RESERVED = ("index.md", "log.md", "source_manifest.md")
REASONS = {"document": "Permanent deletion requested", "concept": "Permanent source-document deletion in progress"}


def plain_path(path: Column) -> Column:
    """A bundle path with forward slashes and without a leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def normal_path(path: Column) -> Column:
    """A relative path without ``.`` and with ``..`` resolved; what climbs above the root keeps its ``..``."""
    parts = F.filter(F.split(plain_path(path), "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    up = lambda kept, p: (p == "..") & (F.size(kept) > 0) & ~F.coalesce(F.element_at(kept, -1) == "..", F.lit(False))
    step = lambda kept, p: F.when(up(kept, p), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, p))
    return F.array_join(F.aggregate(parts, none, step), "/")


def resolved_target(source: Column, target: Column) -> Column:
    """A relation's target from the folder of its source."""
    return normal_path(F.concat(F.regexp_extract(source, "^(.*/)?[^/]*$", 1), target))


def exported_paths(topics: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (document_id, bundle_id, path): what topics (document_id, bundle_id, topic_id, exported_path) name, and files that end in a topic's fragment.

    A fragment is ten hexadecimal digits of the topic id's hash, so files meet topics
    by equality.
    """
    named = topics.filter(F.col("exported_path").isNotNull() & F.col("bundle_id").isNotNull()).select("document_id", "bundle_id", plain_path(F.col("exported_path")).alias("path"))
    by_topic = topics.select("document_id", "bundle_id", F.left(F.sha2(F.col("topic_id").cast("string"), 256), F.lit(10)).alias("_fragment"))
    ended = files.select("bundle_id", "path", F.regexp_extract("path", r"-([0-9a-f]{10})\.md$", 1).alias("_fragment")).filter("_fragment <> ''")
    found = by_topic.join(ended, ["bundle_id", "_fragment"]).select("document_id", "bundle_id", "path")
    return named.unionByName(found).distinct()


def requested(tables: dict[str, DataFrame], asked: DataFrame, at: Column) -> dict[str, DataFrame]:
    """The tables after the deletion of the ``asked`` documents (document_id) is requested.

    ``tables`` has documents (document_id, title, bundle_id, status, deleted_at,
    delete_reason), topics, files, chunks (document_id, active, ...), lifecycle
    (bundle_id, path, status, reason, changed_at) and jobs (document_id, title,
    bundle_id, status, requested_at, paths, topic_ids). The document is marked, its
    chunks are switched off, its concepts are marked, and a job keeps what the run
    needs. Unknown documents and those that have a job are left out.
    """
    fresh = asked.select("document_id").distinct().join(tables["jobs"].select("document_id"), "document_id", "left_anti")
    fresh = tables["documents"].select("document_id", "title", "bundle_id").join(fresh, "document_id", "left_semi")
    mark = fresh.select("document_id", F.lit(True).alias("_asked"))
    documents = tables["documents"].join(mark, "document_id", "left").withColumns({
        "status": F.when(F.col("_asked"), "deleting").otherwise(F.col("status")), "deleted_at": F.when(F.col("_asked"), at).otherwise(F.col("deleted_at")),
        "delete_reason": F.when(F.col("_asked"), REASONS["document"]).otherwise(F.col("delete_reason")),
    }).select(tables["documents"].columns)
    chunks = tables["chunks"].join(mark, "document_id", "left").withColumn("active", F.col("active") & F.col("_asked").isNull()).select(tables["chunks"].columns)
    topics = tables["topics"].join(fresh.select("document_id"), "document_id", "left_semi")
    paths = exported_paths(topics, tables["files"])
    marked = paths.select("bundle_id", "path").distinct().select("bundle_id", "path", F.lit("deleting").alias("status"), F.lit(REASONS["concept"]).alias("reason"), at.alias("changed_at"))
    lifecycle = upsert(tables["lifecycle"], marked.select(tables["lifecycle"].columns), ["bundle_id", "path"])
    held = paths.groupBy("document_id").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    own = topics.groupBy("document_id").agg(F.sort_array(F.collect_list("topic_id")).alias("topic_ids"))
    none = lambda c, df: F.coalesce(c, F.array().cast(dict(df.dtypes)[c]))
    jobs = fresh.join(held, "document_id", "left").join(own, "document_id", "left").select(
        "document_id", "title", "bundle_id", F.lit("queued").alias("status"), at.alias("requested_at"), none("paths", held).alias("paths"), none("topic_ids", own).alias("topic_ids"),
    )
    return {**tables, "documents": documents, "chunks": chunks, "lifecycle": lifecycle, "jobs": tables["jobs"].unionByName(jobs)}


def _cited_answers(citations: DataFrame, jobs: DataFrame, paths: DataFrame) -> DataFrame:
    """Distinct (document_id, answer_id): answers that cite the document of a job or a path that it exported."""
    by_document = citations.join(jobs.select("document_id"), "document_id").select("document_id", "answer_id")
    cited = citations.select("answer_id", plain_path(F.col("path")).alias("path")).filter("path is not null")
    by_path = paths.select("document_id", "path").join(cited, "path").select("document_id", "answer_id")
    return by_document.unionByName(by_path).distinct()


def deleted(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after all queued jobs ran, and one row of counts a job.

    Beside ``requested``'s tables there are answers (answer_id, content), citations
    (answer_id, document_id, path), gaps (answer_id), candidates (bundle_id, source,
    target), concept rows (bundle_id, path), links (bundle_id, topic_id), relations
    (bundle_id, source, idx, target) and run_items (run_id, document_id) with runs
    (run_id). Answers that cite what goes keep a note and no citations. Surviving
    files lose the relations whose resolved target goes and get the date of the
    request. A run goes if its last item does. The manifest entry of a title goes
    unless a live document of the same bundle and title has an exported topic.
    """
    jobs = tables["jobs"].filter("status in ('queued', 'running')")
    paths = jobs.select("document_id", "bundle_id", "requested_at", F.explode("paths").alias("path"))
    gone_files = paths.filter("bundle_id is not null").select("bundle_id", "path", "requested_at").groupBy("bundle_id", "path").agg(F.max("requested_at").alias("requested_at"))
    gone_documents, keys = jobs.select("document_id"), ["bundle_id", "path"]
    cited = _cited_answers(tables["citations"], jobs, paths)
    hit = cited.select("answer_id").distinct()
    out = dict(tables)
    out["citations"] = tables["citations"].join(hit, "answer_id", "left_anti")
    out["gaps"] = tables["gaps"].join(hit, "answer_id", "left_anti")
    noted = tables["answers"].join(hit.withColumn("_hit", F.lit(True)), "answer_id", "left")
    out["answers"] = noted.withColumn("content", F.when(F.col("_hit"), DELETED_ANSWER).otherwise(F.col("content"))).select(tables["answers"].columns)
    for end in ("source", "target"):
        out["candidates"] = out["candidates"].join(gone_files.select("bundle_id", F.col("path").alias(end)), ["bundle_id", end], "left_anti").select(tables["candidates"].columns)
    for name in ("embeddings", "lifecycle", "files"):
        out[name] = tables[name].join(gone_files, keys, "left_anti")
    own_topics = jobs.select("bundle_id", F.explode("topic_ids").alias("topic_id"))
    out["links"] = tables["links"].join(own_topics, ["bundle_id", "topic_id"], "left_anti")
    for name in ("documents", "topics", "chunks"):
        out[name] = tables[name].join(gone_documents, "document_id", "left_anti")
    out["run_items"] = tables["run_items"].join(gone_documents, "document_id", "left_anti")
    touched = tables["run_items"].join(gone_documents, "document_id", "left_semi").select("run_id").distinct()
    empty = touched.join(out["run_items"].select("run_id").distinct(), "run_id", "left_anti")
    out["runs"] = tables["runs"].join(empty, "run_id", "left_anti")
    out["jobs"] = tables["jobs"].filter("status not in ('queued', 'running')")

    # Relations: those of deleted files go with them; of survivors, those that point at deleted ones.
    away = gone_files.select("bundle_id", F.col("path").alias("source"))
    kept = tables["relations"].join(away, ["bundle_id", "source"], "left_anti")
    pointed = kept.filter(~F.col("source").isin(*RESERVED)).withColumn("_path", resolved_target(F.col("source"), F.col("target")))
    lost = pointed.join(gone_files.select("bundle_id", F.col("path").alias("_path"), "requested_at"), ["bundle_id", "_path"]).select("bundle_id", "source", "idx", "requested_at")
    out["relations"] = kept.join(lost, ["bundle_id", "source", "idx"], "left_anti").select(tables["relations"].columns)
    changed = lost.groupBy("bundle_id", F.col("source").alias("path")).agg(F.max("requested_at").alias("_at"))
    renewed = out["files"].join(changed, keys, "left")
    out["files"] = renewed.withColumn("updated", F.coalesce(F.to_date("_at"), "updated")).select(tables["files"].columns)
    out["changed_files"] = changed.select(*keys)

    survivors = out["documents"].filter("deleted_at is null").join(tables["topics"].filter("exported_path is not null").select("document_id").distinct(), "document_id", "left_semi")
    titled = survivors.groupBy("bundle_id", "title").agg(F.count(F.lit(1)).alias("same_title"))
    one = lambda df, name: df.groupBy("document_id").agg(F.count(F.lit(1)).alias(name))
    counts = jobs.select("document_id", "title", "bundle_id", F.size("topic_ids").cast("long").alias("topics"))
    counts = counts.join(one(cited, "chat_answers"), "document_id", "left").join(one(paths.join(tables["files"].select(*keys), keys), "concept_files"), "document_id", "left")
    counts = counts.join(one(tables["chunks"].join(gone_documents, "document_id", "left_semi"), "rag_chunks"), "document_id", "left")
    counts = counts.join(titled, ["bundle_id", "title"], "left").fillna(0, ["chat_answers", "concept_files", "rag_chunks", "same_title"])
    counts = counts.withColumn("drops_manifest_entry", F.col("bundle_id").isNotNull() & (F.col("same_title") == 0))
    return out, counts.select("document_id", "topics", "chat_answers", "concept_files", "rag_chunks", "same_title", "drops_manifest_entry")
