"""Routed retrieval for a table of questions: three routes, several bundles, raw evidence only where it is due.

The routes are a plan over tables, without a loop over questions or bundles. A first
phase reads approved evidence for every bundle of a question. What still needs raw
evidence is then a table of (question, bundle) that joins and anti joins make, and
only for these is raw evidence fetched: for the routes that ask for it, for graph
questions whose relations lead nowhere, and, once a question on approved knowledge
has none in any of its bundles, for all of its bundles, labelled as discovery.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.retrieval import rerank
from tessera.operators.routing import merge_bundles

# How much evidence a question keeps, how many candidates are reranked, and the names of the tools.
MOST_APPROVED, MOST_RAW, MOST_CANDIDATES = 4, 6, 10
ROUTES = ("okf_only", "rag_only", "hybrid")
APPROVED_TOOL, GRAPH_TOOL, RAW_TOOL = "okf_retrieval", "okf_relation_traversal", "rag_retrieval"
_KEY = ["query_id", "bundle_id"]


def fused_candidates(keyword: DataFrame, vector: DataFrame, keys: list[str], k: int = MOST_CANDIDATES, fusion: int = 60) -> DataFrame:
    """The first ``k`` of two ranked lists (keys, chunk_id, rank) fused by reciprocal ranks, for every group of ``keys``."""
    both = keyword.select(*keys, "chunk_id", "rank").unionByName(vector.select(*keys, "chunk_id", "rank"))
    scored = both.groupBy(*keys, "chunk_id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(float(fusion)) + F.col("rank"))), 12).alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def answer_candidates(found: DataFrame, chunks: DataFrame, scores: DataFrame, source_type: str = "raw_extraction", approved_only: bool = False) -> DataFrame:
    """Raw evidence for answers: fused results (query_id, bundle_id, chunk_id, rank) filtered again, reranked, and the first six of each bundle.

    ``chunks`` has chunk_id, source_type and review_status; ``scores`` the relevance
    0 to 3 that a model gave (query_id, bundle_id, chunk_id, relevance). A question
    whose scores do not cover its candidates keeps their order. Gives query_id,
    bundle_id, chunk_id and place.
    """
    fits = chunks.filter(F.col("source_type") == source_type)
    if approved_only:
        fits = fits.filter("review_status = 'approved'")
    kept = found.join(fits.select("chunk_id"), "chunk_id", "left_semi")
    order = Window.partitionBy(*_KEY).orderBy("rank")
    kept = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MOST_CANDIDATES)
    one = lambda df: df.withColumn("query_id", F.struct(*_KEY)).drop("bundle_id")  # noqa: E731  the reranker's unit is a question in a bundle
    best = rerank(one(kept.select(*_KEY, "chunk_id", "rank")), one(scores), "chunk_id", MOST_RAW)
    return best.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.bundle_id").alias("bundle_id"), "chunk_id", F.col("new_rank").alias("place"))


def _searched(questions: DataFrame, approved: DataFrame, clarifications: DataFrame, graph: DataFrame) -> DataFrame:
    """One row a question and bundle of its scope, with what its first phase found."""
    scope = questions.filter(F.col("route").isin(*ROUTES))
    rows = scope.select("query_id", "route", F.coalesce("needs_graph", F.lit(False)).alias("needs_graph"), F.coalesce("clarified", F.lit(False)).alias("clarified"), F.explode("bundles").alias("_b"))
    rows = rows.select("query_id", "route", "needs_graph", "clarified", F.col("_b.bundle_id").alias("bundle_id"), F.col("_b.rank").alias("rank"))
    has = lambda df, name: df.select(*_KEY).distinct().withColumn(name, F.lit(True))
    rows = rows.join(has(approved, "ok"), _KEY, "left").join(has(clarifications, "asks"), _KEY, "left").join(has(graph, "led"), _KEY, "left")
    rows = rows.fillna(False, ["ok", "asks", "led"])
    okf, hybrid = F.col("route") == "okf_only", F.col("route") == "hybrid"
    rows = rows.withColumn("asks", F.col("asks") & ~F.col("clarified") & (hybrid | (okf & ~F.col("ok"))))
    rows = rows.withColumn("ok", F.col("ok") & ~F.col("asks") & (okf | hybrid))
    return rows.withColumn("led", F.col("led") & okf & F.col("ok") & F.col("needs_graph"))


def needs_raw(searched: DataFrame) -> DataFrame:
    """query_id, bundle_id and phase of what raw evidence is fetched for."""
    route = F.col("route")
    first = (route == "rag_only") | ((route == "hybrid") & ~F.col("asks")) | ((route == "okf_only") & F.col("ok") & F.col("needs_graph") & ~F.col("led"))
    answered = searched.filter("ok or asks").select("query_id").distinct()
    missed = searched.filter(route == "okf_only").join(answered, "query_id", "left_anti")
    return searched.filter(first).select(*_KEY, F.lit("first").alias("phase")).unionByName(missed.select(*_KEY, F.lit("fallback").alias("phase")))


def routed_retrieval(
    questions: DataFrame, approved: DataFrame, clarifications: DataFrame, graph: DataFrame, fetch_raw: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """Evidence and outcome of every question.

    ``questions`` has query_id, route, needs_graph, clarified (a clarification was
    asked before) and bundles (array of bundle_id and rank); ``approved`` query_id,
    bundle_id, path, place and provenance; ``clarifications`` query_id and bundle_id;
    ``graph`` query_id, bundle_id, path and place of what the relations of the
    approved evidence lead to; ``fetch_raw`` gives query_id, bundle_id, chunk_id,
    place and covered (how many concepts cover it) for a table of query_id and
    bundle_id.

    Evidence: query_id, new_index, bundle_id, source_type, key, mode. Outcomes:
    query_id, route, tools, approved_available, discovery_only, asks (the first
    bundle that asks for a clarification, if there is no evidence), n_bundles and
    whether the fallback ran. Routes that don't retrieve have neither tools nor
    evidence.
    """
    approved = approved.filter(F.col("place") <= MOST_APPROVED)
    graph = graph.join(approved.select(*_KEY, "path"), [*_KEY, "path"], "left_anti")
    searched = _searched(questions, approved, clarifications, graph)
    asked = needs_raw(searched)
    raw = fetch_raw(asked.select(*_KEY)).join(asked, _KEY).join(searched.select(*_KEY, "route", "rank"), _KEY)
    found = searched.filter("ok").select(*_KEY, "route", "rank", "led")
    direct = approved.join(found, _KEY)
    direct = direct.select(*_KEY, "route", "rank", "led", F.lit(0).alias("step"), "place", F.col("path").alias("key"), "provenance")
    # What the graph leads to follows the approved evidence, in what room is left.
    further = graph.join(found.filter("led"), _KEY)
    further = further.select(*_KEY, "route", "rank", "led", F.lit(1).alias("step"), "place", F.col("path").alias("key"), F.lit(None).cast("string").alias("provenance"))
    okf = direct.unionByName(further)
    in_bundle = Window.partitionBy(*_KEY).orderBy("step", "place")
    okf = okf.withColumn("index", F.row_number().over(in_bundle)).filter(F.col("index") <= MOST_APPROVED)
    okf = okf.select(*_KEY, "route", "rank", "index", F.lit("okf").alias("source_type"), "key", "provenance", F.lit(0).alias("covered"), F.when(F.col("led"), "graph").otherwise("direct").alias("mode"))
    # Within a bundle raw evidence is numbered after the approved; only the order of the numbers counts.
    from_raw = raw.filter(F.col("place") <= MOST_RAW).select(
        *_KEY, "route", "rank", (F.col("place") + MOST_APPROVED).alias("index"), F.lit("rag").alias("source_type"), F.col("chunk_id").cast("string").alias("key"), F.lit(None).cast("string").alias("provenance"),
        "covered", F.lit(None).cast("string").alias("mode"),
    )
    evidence = okf.withColumn("key", F.col("key").cast("string")).unionByName(from_raw)
    several = questions.select("query_id", (F.size("bundles") > 1).alias("_several"))
    held = evidence.join(several, "query_id")
    merged = merge_bundles(held.filter("_several").withColumnRenamed("bundle_id", "_name").withColumnRenamed("rank", "bundle").drop("_several"), MOST_APPROVED, MOST_RAW)
    alone = held.filter("not _several").withColumn("new_index", F.row_number().over(Window.partitionBy("query_id").orderBy("index")))
    columns = ["query_id", "new_index", "bundle_id", "source_type", "key", "mode"]
    chosen = merged.withColumnRenamed("_name", "bundle_id").select(columns).unionByName(alone.select(columns))

    tools = searched.join(asked, _KEY, "left")
    used = F.array_compact(F.array(
        F.when(F.col("route") != "rag_only", APPROVED_TOOL), F.when((F.col("route") == "okf_only") & F.col("ok") & F.col("needs_graph"), GRAPH_TOOL), F.when(F.col("phase").isNotNull(), RAW_TOOL),
    ))
    per = tools.groupBy("query_id").agg(
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", used.alias("tools")))), lambda x: x["tools"]))).alias("tools"),
        F.count(F.lit(1)).alias("n_bundles"), F.min_by(F.when(F.col("asks"), F.col("bundle_id")), F.when(F.col("asks"), F.col("rank"))).alias("_asks"),
        F.bool_or("ok").alias("_any_ok"), F.coalesce(F.bool_or(F.col("phase") == "fallback"), F.lit(False)).alias("fallback"),
    )
    kinds = chosen.groupBy("query_id").agg(F.count_if(F.col("source_type") == "okf").alias("n_okf"), F.count_if(F.col("source_type") == "rag").alias("n_rag"))
    rows = questions.select("query_id", "route").join(per, "query_id", "left").join(kinds, "query_id", "left").fillna(0, ["n_okf", "n_rag", "n_bundles"]).fillna(False, ["_any_ok", "fallback"])
    outcomes = rows.select(
        "query_id", "route", F.coalesce("tools", F.array().cast("array<string>")).alias("tools"), (F.col("n_okf") > 0).alias("approved_available"),
        (~F.col("_any_ok") & (F.col("n_rag") > 0)).alias("discovery_only"), F.when(F.col("n_okf") + F.col("n_rag") == 0, F.col("_asks")).alias("asks"), "n_okf", "n_rag", "n_bundles", "fallback",
    )
    return chosen, outcomes


def merged_attempts(original: DataFrame, retry: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citations of a first retrieval and its retry merged, and what the retry added.

    Both have query_id, index, source_type and identity; ``routes`` query_id and
    route. Of one identity the first citation counts; four approved and six raw ones
    stay, on the raw route only raw ones. Gives (query_id, new_index, source_type,
    identity) and (query_id, citations, approved, raw) of what is new.
    """
    both = original.withColumn("_try", F.lit(0)).unionByName(retry.withColumn("_try", F.lit(1)))
    first = Window.partitionBy("query_id", "identity").orderBy("_try", "index")
    kept = both.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").join(routes, "query_id")
    kept = kept.filter(~((F.col("route") == "rag_only") & (F.col("source_type") == "okf")))
    place = Window.partitionBy("query_id", "source_type").orderBy("_try", "index")
    most = F.when(F.col("source_type") == "okf", MOST_APPROVED).otherwise(MOST_RAW)
    kept = kept.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= most)
    order: list[Column | str] = ["source_type", "_place"]  # okf stands before rag
    merged = kept.withColumn("new_index", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    added = merged.join(original.select("query_id", "identity").distinct(), ["query_id", "identity"], "left_anti")
    counts = added.groupBy("query_id").agg(F.count(F.lit(1)).alias("citations"), F.count_if(F.col("source_type") == "okf").alias("approved"), F.count_if(F.col("source_type") == "rag").alias("raw"))
    deltas = routes.select("query_id").join(counts, "query_id", "left").fillna(0)
    return merged.select("query_id", "new_index", "source_type", "identity"), deltas
