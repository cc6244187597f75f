"""The lint query; a knowledge file is made of every document, with a relation that the document's number chooses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import lint
from tessera.plans.base import query, table

#: Lines of the frontmatter by the document's number modulo their count, ``@`` for the next document's file, and the rules that they break.
_CASES = [
    ("relations:\n  - relation: supports\n    target: ../d1/@\n    target_type: en", None),
    ("relations:\n- relation: 'routes_to'\n  target: \"./../d2/@\"\n  target_type: en", None),
    ("relations: none", ["relations_not_list"]),
    ("relations:\n  relation: supports\n  target: a.md", ["relations_not_list"]),
    ("relations:\n  - supports\n  - relation: invented\n    target_type: fr", ["relation_not_object", "invalid_relation", "missing_target"]),
    ("relations:\n  - relation: supports\n    target: 'a\\b.md'\n    target_type: ''", ["missing_target_type", "backslash_target"]),
    ("relations:\n  - relation: supports\n    target: https://x.org/a.md\n    target_type: 7", ["missing_target_type", "url_target"]),
    ("relations:\n  - relation: 3\n    target: /a.md\n    target_type: en", ["invalid_relation", "absolute_target"]),
    ("relations:\n  - relation: supports\n    target: a.md?x=1\n    target_type: en", ["query_string_target"]),
    ("relations:\n  - relation: supports\n    target: a.txt#b.md\n    target_type: en", ["non_markdown_target"]),
    ("relations:\n  - relation: supports\n    target: ../../other/a.md\n    target_type: en", ["target_escapes_root"]),
    ("relations:\n  - relation: supports\n    target: nowhere.md\n    target_type: en", ["missing_target_file"]),
    ("relations:\n  - relation: supports\n    target: ../folder.md\n    target_type: en", ["target_not_file"]),
    ("title: plain\ntags: [a, b]", []),
    ("relations: []", []),
    ("relations:\n  - relation: supports\n    target: ../%641/@#part\n    target_type: none", ["target_type_mismatch"]),
]
_MANIFEST = "# rules\nbase:\n  name: 'A'\n  roots:\n  - path: ./knowledge\n    exclude_patterns: []\nrelations:\n  allowed:\n  - supports\n  - routes_to\n"
_EMPTY = "base:\n  roots: []\nrelations:\n  allowed: []\n"


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Manifests and files of three bundles, of which the last has empty lists."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    case = F.get(F.array(*(F.lit(c) for c, _ in _CASES)), (F.floor(F.col("doc_id") / 3) % len(_CASES)).cast("int"))
    lines = F.replace(case, F.lit("@"), F.concat(F.lit("f"), F.col("doc_id"), F.lit(".md")))
    bundle, named = F.col("doc_id") % 3, F.concat(F.lit("f"), F.col("doc_id"), F.lit(".md"))
    markdown = F.concat(F.lit("---\ntype: a\n"), lines, F.lit("\n---\n\n"), F.coalesce("text", F.lit("")))
    target = F.concat(F.lit("---\ntype: "), F.coalesce("lang", F.lit("null")), F.lit("\n---\n"))
    files = docs.select(bundle.alias("bundle_id"), F.concat(F.lit("knowledge/d0/"), named).alias("path"), markdown.alias("markdown"))
    for folder in ("d1", "d2"):
        files = files.unionByName(docs.select(bundle.alias("bundle_id"), F.concat(F.lit(f"knowledge/{folder}/"), named).alias("path"), target.alias("markdown")))
    more = docs.select(bundle.alias("bundle_id")).distinct()
    files = files.unionByName(more.select("bundle_id", F.lit("knowledge/folder.md/in.txt").alias("path"), F.lit(None).cast("string").alias("markdown")))
    files = files.unionByName(more.select("bundle_id", F.lit("other/a.md").alias("path"), F.lit("---\nrelations: odd\n---\n").alias("markdown")))
    manifests = more.select("bundle_id", F.when(F.col("bundle_id") == 2, _EMPTY).otherwise(_MANIFEST).alias("manifest"))
    return manifests, files


_RULES_SQL = "[" + ", ".join("[" + ", ".join(f"'{r}'" for r in (rules or [])) + "]" for _, rules in _CASES) + "]"


@query(
    f"""WITH d AS (SELECT doc_id, doc_id % 3 AS bundle_id, lang, CAST(floor(doc_id / 3) AS BIGINT) % {len(_CASES)} AS n FROM documents),
v AS (SELECT doc_id, bundle_id, n, unnest(CASE WHEN n < 2 AND coalesce(lang, '') <> 'en' THEN ['target_type_mismatch'] ELSE {_RULES_SQL}[n + 1] END) AS rule FROM d WHERE bundle_id < 2)
SELECT bundle_id, 'knowledge/d0/f' || doc_id || '.md' AS file, CASE WHEN rule = 'relations_not_list' THEN NULL WHEN n = 4 AND rule <> 'relation_not_object' THEN 1 ELSE 0 END AS relation_index, rule FROM v
UNION ALL SELECT DISTINCT bundle_id, NULL, NULL, unnest(['missing_allowed_relations', 'missing_knowledge_roots']) FROM d WHERE bundle_id = 2"""
)
def relation_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every violation in the relations of the files that the documents make."""
    return lint.relation_lint(*_texts(spark, sf_dir))
