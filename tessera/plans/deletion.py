"""Queries over the permanent deletion of documents; a document row stands for a topic, a chunk, an answer and a citation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import deletion
from tessera.plans.base import query, table

_OF = "CAST(floor(doc_id / 5) AS BIGINT)"
_BUNDLE = f"CASE WHEN floor(doc_id / 5) % 17 = 0 THEN NULL ELSE 'b' || ({_OF} % 3) END"
_PATH = "'concepts/t' || doc_id || '.md'"
_VIEWS = {
    "documents_": ({
        "document_id": _OF, "title": f"'T' || ({_OF} % 40)", "bundle_id": _BUNDLE, "status": "'ready'",
        "deleted_at": f"CASE WHEN {_OF} % 13 = 0 THEN DATE '2024-01-01' END", "delete_reason": "CAST(NULL AS STRING)",
    }, "documents WHERE doc_id % 5 = 0"),
    "topics_": ({"document_id": _OF, "bundle_id": _BUNDLE, "topic_id": "doc_id", "exported_path": f"CASE WHEN doc_id % 3 = 0 THEN './' || {_PATH} END"}, "documents"),
    "chunks_": ({"chunk_id": "doc_id", "document_id": "CAST(floor(doc_id / 11) AS BIGINT)", "active": "doc_id % 4 <> 0"}, "documents"),
    "lifecycle_": ({"bundle_id": f"'b' || ({_OF} % 3)", "path": _PATH, "status": "'active'", "reason": "'new'", "changed_at": "DATE '2023-01-01'"}, "documents WHERE doc_id % 6 = 0"),
    "answers_": ({"answer_id": "doc_id", "content": "text"}, "documents"),
    "citations_": ({
        "answer_id": "CAST(floor(doc_id / 2) AS BIGINT)", "document_id": "CASE WHEN doc_id % 4 = 1 THEN CAST(floor(doc_id / 9) AS BIGINT) END",
        "path": "CASE WHEN doc_id % 4 <> 1 THEN 'concepts' || chr(92) || 't' || (doc_id * 3 % 900) || '.md' END",
    }, "documents"),
    "candidates_": ({"bundle_id": f"'b' || ({_OF} % 3)", "source": _PATH, "target": "'concepts/t' || (doc_id + 6) || '.md'"}, "documents"),
    "relations_": ({"bundle_id": f"'b' || ({_OF} % 3)", "source": _PATH, "idx": "1", "target": "'../concepts/./t' || (doc_id + 3) || '.md'"}, "documents WHERE doc_id % 2 = 0"),
    "items_": ({"run_id": "doc_id % 300", "document_id": _OF}, "documents"),
}
#: Files: what topics export, and of every seventh topic one that is known by its fragment only.
_FILES = f"""SELECT 'b' || ({_OF} % 3) AS bundle_id, {_PATH} AS path, DATE '2023-05-05' AS updated FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0
UNION ALL SELECT 'b' || ({_OF} % 3), 'concepts/x-' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 10) || '.md', DATE '2023-05-05' FROM documents WHERE doc_id % 7 = 0"""


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    columns, source = _VIEWS[name]
    source, _, where = source.partition(" WHERE ")
    rows = table(spark, sf_dir, source)
    return (rows.filter(where) if where else rows).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    bundle = F.concat(F.lit("b"), F.floor(F.col("doc_id") / 5) % 3)
    own = docs.filter("doc_id % 3 = 0 or doc_id % 2 = 0").select(bundle.alias("bundle_id"), F.concat(F.lit("concepts/t"), "doc_id", F.lit(".md")).alias("path"))
    known = docs.filter("doc_id % 7 = 0").select(bundle.alias("bundle_id"), F.concat(F.lit("concepts/x-"), F.left(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(10)), F.lit(".md")).alias("path"))
    get = lambda name: _view(spark, sf_dir, f"{name}_")
    topics, items, candidates = get("topics"), get("items"), get("candidates")
    jobs = "document_id long, title string, bundle_id string, status string, requested_at date, paths array<string>, topic_ids array<long>"
    return {
        "documents": get("documents"), "topics": topics, "chunks": get("chunks"), "lifecycle": get("lifecycle"), "answers": get("answers"),
        "citations": get("citations"), "gaps": get("answers").select("answer_id"), "candidates": candidates, "relations": get("relations"),
        "files": own.unionByName(known).withColumn("updated", F.to_date(F.lit("2023-05-05"))), "embeddings": candidates.select("bundle_id", F.col("source").alias("path")),
        "links": topics.select("bundle_id", "topic_id"), "run_items": items, "runs": items.select("run_id").distinct(),
        "jobs": spark.createDataFrame([], jobs),
    }


def _asked(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    tables = _tables(spark, sf_dir)
    return tables, tables["documents"].filter("document_id % 7 = 0").select("document_id")


_BASE_SQL = ", ".join(
    f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items()).replace('STRING', 'VARCHAR')} FROM {source})" for name, (columns, source) in _VIEWS.items()
) + f""", files_ AS ({_FILES}), j AS (SELECT * FROM documents_ WHERE document_id % 7 = 0),
paths AS (SELECT document_id, bundle_id, replace(exported_path, './', '') AS path FROM topics_ WHERE document_id % 7 = 0 AND exported_path IS NOT NULL AND bundle_id IS NOT NULL
  UNION SELECT t.document_id, t.bundle_id, f.path FROM topics_ t JOIN files_ f ON f.bundle_id = t.bundle_id AND f.path = 'concepts/x-' || substr(sha256(CAST(t.topic_id AS VARCHAR)), 1, 10) || '.md' WHERE t.document_id % 7 = 0),
cited AS (SELECT document_id, answer_id FROM citations_ WHERE document_id IN (SELECT document_id FROM j)
  UNION SELECT p.document_id, c.answer_id FROM paths p JOIN citations_ c ON replace(c.path, chr(92), '/') = p.path)"""


@query(f"""WITH {_BASE_SQL}
SELECT 'document' AS kind, CAST(document_id AS VARCHAR) AS name, CASE WHEN document_id % 7 = 0 THEN 'deleting' ELSE 'ready' END AS state FROM documents_
UNION ALL SELECT 'chunk', CAST(chunk_id AS VARCHAR), CASE WHEN active AND document_id NOT IN (SELECT document_id FROM j) THEN 'on' ELSE 'off' END FROM chunks_
UNION ALL SELECT 'concept', l.bundle_id || ':' || l.path, 'active' FROM lifecycle_ l WHERE (bundle_id, path) NOT IN (SELECT bundle_id, path FROM paths)
UNION ALL SELECT DISTINCT 'concept', bundle_id || ':' || path, 'deleting' FROM paths
UNION ALL SELECT 'job', CAST(document_id AS VARCHAR), 'queued:' || (SELECT count(*) FROM paths p WHERE p.document_id = j.document_id) || ':' || (SELECT count(*) FROM topics_ t WHERE t.document_id = j.document_id) FROM j""")
def deletion_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, chunks, concepts and jobs after the deletion of every seventh document is requested, twice."""
    tables, asked = _asked(spark, sf_dir)
    once = deletion.requested(tables, asked, F.to_date(F.lit("2024-06-01")))
    twice = deletion.requested(once, asked, F.to_date(F.lit("2025-01-01")))
    row = lambda df, kind, name, state: df.select(F.lit(kind).alias("kind"), name.cast("string").alias("name"), state.alias("state"))
    c = F.col
    return (
        row(twice["documents"], "document", c("document_id"), c("status")).unionByName(row(twice["chunks"], "chunk", c("chunk_id"), F.when(c("active"), "on").otherwise("off")))
        .unionByName(row(twice["lifecycle"], "concept", F.concat_ws(":", "bundle_id", "path"), c("status")))
        .unionByName(row(twice["jobs"], "job", c("document_id"), F.concat_ws(":", "status", F.size("paths"), F.size("topic_ids"))))
    )


@query(f"""WITH {_BASE_SQL}, o AS (SELECT bundle_id, title, count(*) AS n FROM documents_ d WHERE deleted_at IS NULL AND document_id % 7 <> 0
  AND EXISTS (SELECT 1 FROM topics_ t WHERE t.document_id = d.document_id AND exported_path IS NOT NULL) GROUP BY bundle_id, title)
SELECT document_id, (SELECT count(*) FROM topics_ t WHERE t.document_id = j.document_id) AS topics, (SELECT count(*) FROM cited c WHERE c.document_id = j.document_id) AS chat_answers,
(SELECT count(*) FROM paths p JOIN files_ f USING (bundle_id, path) WHERE p.document_id = j.document_id) AS concept_files, (SELECT count(*) FROM chunks_ c WHERE c.document_id = j.document_id) AS rag_chunks,
coalesce(o.n, 0) AS same_title, j.bundle_id IS NOT NULL AND o.n IS NULL AS drops_manifest_entry FROM j LEFT JOIN o ON o.bundle_id = j.bundle_id AND o.title = j.title""")
def document_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the deletion of every seventh document removes, and whether its title leaves the manifest."""
    tables, asked = _asked(spark, sf_dir)
    return deletion.deleted(deletion.requested(tables, asked, F.to_date(F.lit("2024-06-01"))))[1]


@query(f"""WITH {_BASE_SQL}, g AS (SELECT DISTINCT bundle_id, path FROM paths), h AS (SELECT DISTINCT answer_id FROM cited),
lost AS (SELECT r.bundle_id, r.source FROM relations_ r WHERE (bundle_id, source) NOT IN (SELECT bundle_id, path FROM g) AND (bundle_id, replace(replace(target, '../', ''), './', '')) IN (SELECT bundle_id, path FROM g)),
i AS (SELECT * FROM items_ WHERE document_id % 7 <> 0)
SELECT 'answer' AS kind, CAST(answer_id AS VARCHAR) AS name, CASE WHEN answer_id IN (SELECT answer_id FROM h) THEN 'This answer was removed because its supporting source was permanently deleted.' ELSE sha256(coalesce(content, '')) END AS state FROM answers_
UNION ALL SELECT 'citations', CAST(answer_id AS VARCHAR), CAST(count(*) AS VARCHAR) FROM citations_ WHERE answer_id NOT IN (SELECT answer_id FROM h) GROUP BY answer_id
UNION ALL SELECT 'gap', CAST(answer_id AS VARCHAR), '' FROM answers_ WHERE answer_id NOT IN (SELECT answer_id FROM h)
UNION ALL SELECT 'candidate', bundle_id || ':' || source, target FROM candidates_ WHERE (bundle_id, source) NOT IN (SELECT bundle_id, path FROM g) AND (bundle_id, target) NOT IN (SELECT bundle_id, path FROM g)
UNION ALL SELECT 'file', bundle_id || ':' || path, CASE WHEN (bundle_id, path) IN (SELECT bundle_id, source FROM lost) THEN '2024-06-01' ELSE '2023-05-05' END FROM files_ WHERE (bundle_id, path) NOT IN (SELECT bundle_id, path FROM g)
UNION ALL SELECT 'relation', bundle_id || ':' || source, target FROM relations_ WHERE (bundle_id, source) NOT IN (SELECT bundle_id, path FROM g) AND (bundle_id, source) NOT IN (SELECT bundle_id, source FROM lost)
UNION ALL SELECT 'concept', bundle_id || ':' || path, status FROM lifecycle_ WHERE (bundle_id, path) NOT IN (SELECT bundle_id, path FROM g)
UNION ALL SELECT 'link', CAST(topic_id AS VARCHAR), coalesce(bundle_id, '') FROM topics_ WHERE document_id % 7 <> 0 OR bundle_id IS NULL
UNION ALL SELECT 'run', CAST(run_id AS VARCHAR), '' FROM (SELECT DISTINCT run_id FROM items_) WHERE run_id IN (SELECT run_id FROM i)
UNION ALL SELECT 'left', 'documents', CAST(count(*) AS VARCHAR) FROM documents_ WHERE document_id % 7 <> 0
UNION ALL SELECT 'left', 'chunks', CAST(count(*) AS VARCHAR) FROM chunks_ WHERE document_id NOT IN (SELECT document_id FROM j)
UNION ALL SELECT 'left', 'jobs', '0'""")
def deletion_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table after the deletion of every seventh document ran, twice."""
    tables, asked = _asked(spark, sf_dir)
    done, _ = deletion.deleted(deletion.requested(tables, asked, F.to_date(F.lit("2024-06-01"))))
    done, _ = deletion.deleted(done)
    c = F.col
    row = lambda df, kind, name, state: df.select(F.lit(kind).alias("kind"), name.cast("string").alias("name"), state.cast("string").alias("state"))
    named = F.concat_ws(":", "bundle_id", "path")
    noted = F.when(c("content") == deletion.DELETED_ANSWER, c("content")).otherwise(F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))
    parts = [
        row(done["answers"], "answer", c("answer_id"), noted), row(done["citations"].groupBy("answer_id").count(), "citations", c("answer_id"), c("count")),
        row(done["gaps"], "gap", c("answer_id"), F.lit("")), row(done["candidates"], "candidate", F.concat_ws(":", "bundle_id", "source"), c("target")),
        row(done["files"], "file", named, c("updated")), row(done["relations"], "relation", F.concat_ws(":", "bundle_id", "source"), c("target")),
        row(done["lifecycle"], "concept", named, c("status")), row(done["links"], "link", c("topic_id"), F.coalesce("bundle_id", F.lit(""))), row(done["runs"], "run", c("run_id"), F.lit("")),
        *(row(done[name].agg(F.count(F.lit(1)).alias("n")), "left", F.lit(name), c("n")) for name in ("documents", "chunks", "jobs")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
