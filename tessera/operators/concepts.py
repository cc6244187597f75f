"""Concepts: evidence and near misses for questions, texts to embed, relation checks, verification and the explorer graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import collapsed, field_tokens, query_tokens, safe_path
from tessera.lineage import written
from tessera.operators.graph import degrees
from tessera.operators.retrieval import lexical_scores, vector_search

# What counts as evidence or as a near miss.
TOP_EVIDENCE, TOP_NEAR, LEAST_SIMILARITY, STRONG_SIMILARITY, NEAR_MARGIN = 4, 8, 0.5, 0.7, 0.15
HEADER_MOST = 120


def current_embeddings(concepts: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts (path, content_hash) with an embedding of just that content, and those that lack one."""
    keys = embeddings.select("path", "content_hash").distinct()
    return concepts.join(keys, ["path", "content_hash"], "left_semi"), concepts.join(keys, ["path", "content_hash"], "left_anti")


def concept_evidence(
    questions: DataFrame, concepts: DataFrame, embeddings: DataFrame, least: float = LEAST_SIMILARITY, k: int = TOP_EVIDENCE, near: int = TOP_NEAR
) -> DataFrame:
    """Evidence for each question, or its near misses: query_id, path, kind, mode, score, strength, rank.

    ``questions`` (query_id, question, vector) is a stated, small set; ``concepts`` has
    path, title, description, metadata, body, provenance and content_hash,
    ``embeddings`` path, content_hash and vector. Questions and concepts meet on common
    words; path is a key. Only questions without lexical evidence are searched by vector, over
    embeddings of the current content. A question without evidence of either kind gets
    its weak lexical and close vector matches, merged by path.
    """
    # A concept is read once: its words are cut, compared with the few wanted ones, and only what meets is scored and kept.
    asked = questions.select("query_id", "question").filter(F.size(query_tokens(F.col("question"))) > 0)
    wanted = asked.agg(F.array_distinct(F.flatten(F.collect_list(query_tokens(F.col("question"))))).alias("_wanted"))  # one row
    words = F.array_distinct(F.concat(*(field_tokens(F.col(f)) for f in ("title", "description", "metadata", "body"))))
    near_any = concepts.crossJoin(F.broadcast(wanted)).withColumn("_met", F.array_intersect(words, "_wanted")).filter(F.size("_met") > 0)
    pairs = near_any.drop("_wanted").crossJoin(F.broadcast(asked)).filter(F.arrays_overlap("_met", query_tokens(F.col("question")))).drop("_met")
    scored = written(lexical_scores(pairs, F.col("question")).select("query_id", "path", "title", "provenance", "score", "qualifies", "strength"), "scored")
    rank = lambda *by: F.row_number().over(Window.partitionBy("query_id").orderBy(*by))
    approval = F.when(F.col("provenance") == "human", 0).when(F.col("provenance") == "automated", 1).otherwise(2)
    best = (F.col("score").desc(), approval, "title", "path")
    lexical = scored.filter("qualifies").withColumn("rank", rank(*best)).filter(F.col("rank") <= k)
    lexical = lexical.select("query_id", "path", F.lit("evidence").alias("kind"), F.lit("lexical").alias("mode"), F.col("score").cast("double").alias("score"), "strength", "rank")
    open_ = questions.filter(F.size(query_tokens(F.col("question"))) > 0).join(lexical.select("query_id"), "query_id", "left_anti")
    able, _ = current_embeddings(concepts.select("path", "content_hash"), embeddings)
    current = embeddings.join(able, ["path", "content_hash"], "left_semi").select("path", F.col("vector").alias("_own"))
    found = vector_search(current, open_.withColumnRenamed("vector", "_asked"), "query_id", "_asked", "_own", "path", k=max(k, near))
    met = found.drop("rank").join(concepts.select("path", "title", "provenance"), "path")
    strong = F.when(F.col("score") >= STRONG_SIMILARITY, "strong").otherwise("medium")
    vector = met.filter(F.col("score") >= least).withColumn("rank", rank(*best)).filter(F.col("rank") <= k)
    vector = vector.select("query_id", "path", F.lit("evidence").alias("kind"), F.lit("vector").alias("mode"), "score", strong.alias("strength"), "rank")
    rest = open_.select("query_id").join(vector.select("query_id"), "query_id", "left_anti")
    weak = scored.filter(~F.col("qualifies")).select("query_id", "path", F.col("score").cast("double").alias("_lexical"))
    close = met.filter((F.col("score") < least) & (F.col("score") >= max(-1.0, least - NEAR_MARGIN))).select("query_id", "path", F.col("score").alias("_vector"))
    both = weak.join(close, ["query_id", "path"], "full").join(rest, "query_id", "left_semi").join(concepts.select("path", "title"), "path")
    order = (F.coalesce("_vector", F.lit(-2.0)).desc(), F.coalesce("_lexical", F.lit(-1.0)).desc(), "title", "path")
    missed = both.withColumn("rank", rank(*order)).filter(F.col("rank") <= near)
    mode = F.when(F.col("_vector").isNotNull(), "vector").otherwise("lexical")
    missed = missed.select("query_id", "path", F.lit("near_miss").alias("kind"), mode.alias("mode"), F.coalesce("_vector", "_lexical").alias("score"), F.lit("weak").alias("strength"), "rank")
    return lexical.unionByName(vector).unionByName(missed)


def embedding_text(bundle: Column, kind: Column, title: Column, description: Column, body: Column) -> Column:
    """The text of a concept that is embedded: a header line and its non-empty parts."""
    head = lambda c: F.coalesce(F.nullif(F.left(collapsed(F.coalesce(c, F.lit(""))), F.lit(HEADER_MOST)), F.lit("")), F.lit("Unknown"))
    header = F.concat(F.lit("[Bundle: "), head(bundle), F.lit(" | Type: "), head(F.coalesce(kind, F.lit("unknown"))), F.lit("]"))
    return F.concat_ws("\n", header, *(F.nullif(c, F.lit("")) for c in (title, description, F.trim(body))))


def topic_chunk(topic_id: Column, title: Column, summary: Column) -> tuple[Column, Column]:
    """Text and id of an approved topic's chunk."""
    text = F.concat_ws("\n\n", F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(summary), F.lit("")))
    return text, F.concat(F.lit("okf_"), topic_id, F.lit("_"), F.left(F.sha2(text, 256), F.lit(16)))


def replaced_chunks(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks (document_id, source_type, version, active, ...) after fresh ones of some documents arrive.

    Active chunks of the same document and source type are switched off; the fresh
    ones take the next version of their document.
    """
    keys = ["document_id", "source_type"]
    renewed = fresh.select(*keys).distinct().withColumn("_renewed", F.lit(True))
    old = held.join(renewed, keys, "left").withColumn("active", F.col("active") & F.col("_renewed").isNull()).drop("_renewed")
    last = held.groupBy("document_id").agg(F.max("version").alias("_last"))
    new = fresh.join(last, "document_id", "left").withColumn("version", F.coalesce("_last", F.lit(0)) + 1).withColumn("active", F.lit(True))
    return old.unionByName(new.select(held.columns))


def fetched(chunks: DataFrame, ids: DataFrame, documents: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` active chunks with the wanted ids, of documents that are not deleted, by id; score 1."""
    live = documents.filter("deleted_at is null").select("document_id")
    kept = chunks.filter("active").join(ids, "chunk_id", "left_semi").join(live, "document_id", "left_semi")
    return kept.orderBy("chunk_id").limit(k).withColumn("score", F.lit(1.0))


def relation_violations(relations: DataFrame, files: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """The first violation of each concept (path) among its relations (idx, relation, target, target_type, reason)."""
    known = files.select(F.col("path").alias("target"), F.col("type").alias("_type"), F.lit(True).alias("_found"))
    held = relations.join(known, "target", "left")
    code = (
        F.when(~F.col("relation").isin(*allowed), "relation_type_not_allowed").when(safe_path(F.col("target")).isNull(), "relation_target_invalid")
        .when(F.col("_found").isNull(), "relation_target_missing").when(~F.coalesce(F.col("target_type") == F.col("_type"), F.lit(False)), "relation_target_type_mismatch")
        .when(F.trim("reason") == "", "relation_reason_required")
    )
    first = held.withColumn("code", code).filter("code is not null").groupBy("path").agg(F.min(F.struct("idx", "code")).alias("_first"))
    return first.select("path", "_first.idx", "_first.code")


def broken_targets(relations: DataFrame, files: DataFrame) -> DataFrame:
    """path and warning of every relation whose target is no safe Markdown path or does not exist."""
    known = files.select(F.col("path").alias("target"), F.lit(True).alias("_found"))
    wrong = F.coalesce(safe_path(F.col("target")).isNull() | F.contains("target", F.lit("\\")), F.lit(True))
    code = F.when(wrong, "relation_target_invalid").when(F.col("_found").isNull(), "relation_target_missing")
    held = relations.join(known, "target", "left").withColumn("code", code).filter("code is not null")
    return held.select("path", F.concat_ws(":", "code", "idx", "target").alias("warning"))


def discovery_difference(legacy: DataFrame, fresh: DataFrame) -> DataFrame:
    """Relations (source, target, relation) of either discovery and whether they were kept, removed or added."""
    keys = ["source", "target", "relation"]
    both = legacy.select(keys).distinct().withColumn("_old", F.lit(True)).join(fresh.select(keys).distinct().withColumn("_new", F.lit(True)), keys, "full")
    return both.select(*keys, F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").otherwise("kept").alias("outcome"))


def decision_code(allowed: tuple[str, ...]) -> Column:
    """What is wrong with a verifier's decision row, null if nothing.

    The row has related, relation, direction, forced, quote, rationale and the texts of
    the proposed source and target; the quote must stand in the text of the source.
    """
    c = F.col
    empty = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    text = F.when(c("direction") == "reverse", c("target_text")).otherwise(c("source_text"))
    return (
        F.when(c("related").isNull(), "relation_verification_malformed_response").when(~c("related"), F.lit(None))
        .when(empty("relation") | empty("direction") | empty("quote") | empty("rationale"), "relation_verification_incomplete_positive")
        .when(~c("relation").isin(*allowed), "relation_verification_relation_not_allowed")
        .when(c("forced").isNotNull() & (c("forced") != c("direction")), "relation_verification_direction_mismatch")
        .when(~F.coalesce(F.contains(text, c("quote")), F.lit(False)), "relation_verification_evidence_not_in_source")
    )


def verification_runs(candidates: DataFrame) -> DataFrame:
    """Counts of each run's pending candidates by verification state, and whether the run is done."""
    states = ("confirmed", "failed", "filtered", "queued", "running")
    pending = candidates.groupBy("run_id").agg(*(F.count_if((F.col("status") == "pending") & (F.col("verification") == s)).alias(s) for s in states))
    return pending.withColumn("state", F.when(F.col("queued") + F.col("running") == 0, "completed").otherwise("running"))


def explorer_nodes(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files (path, type) with the degree over valid edges, backlinks, and how many of their edges point nowhere."""
    paths = files.select(F.col("path").alias("target"))
    source = files.select(F.col("path").alias("source"))
    held = edges.join(source, "source", "left_semi")
    valid = held.join(paths, "target", "left_semi")
    broken = held.join(paths, "target", "left_anti").groupBy(F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("issues"))
    back = valid.groupBy(F.col("target").alias("path")).agg(F.count(F.lit(1)).alias("backlinks"))
    rows = files.join(degrees(valid).withColumnRenamed("node", "path"), "path", "left").join(back, "path", "left").join(broken, "path", "left")
    return rows.fillna(0, ["degree", "backlinks", "issues"])


def without_bundle(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of any table with a bundle_id after the ``deleted`` bundles are gone."""
    return rows.join(deleted.select("bundle_id").distinct(), "bundle_id", "left_anti")
