"""Lint of the relations in knowledge files against their bundle's manifest: sixteen rules, several violations a row.

Files and manifests are read once, row by row; which roots a file lies in, where a
target leads and what stands there are joins and expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.lineage import written
from tessera.operators.deletion import normal_path
from tessera.sources import plain_yaml

# The rules, in the order in which they are asked.
RULES = (
    "missing_allowed_relations", "missing_knowledge_roots", "relations_not_list", "relation_not_object", "invalid_relation", "missing_target_type",
    "missing_target", "backslash_target", "url_target", "absolute_target", "query_string_target", "non_markdown_target", "target_escapes_root",
    "missing_target_file", "target_not_file", "target_type_mismatch",
)
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


def _told(value: object) -> tuple[str | None, bool]:
    """A value as text, and whether it is text."""
    return (None if value is None else value if isinstance(value, str) else str(value)), isinstance(value, str)


_VALUE = pa.struct([("value", pa.string()), ("is_text", pa.bool_())])
_ENTRY = pa.struct([("is_object", pa.bool_()), ("relation", _VALUE), ("target", _VALUE), ("target_type", _VALUE)])


def parsed_files(files: DataFrame) -> DataFrame:
    """bundle_id, path, type (value, is_text), listed (whether relations are a list; null if there are none) and relations of ``files`` (bundle_id, path, markdown)."""
    kind = files.schema["bundle_id"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_value = lambda v: dict(zip(("value", "is_text"), _told(v), strict=True))
        for batch in batches:
            kinds, listed, relations = [], [], []
            for markdown in batch.column(2).to_pylist():
                held = plain_yaml.frontmatter(markdown)
                given = held.get("relations")
                kinds.append(as_value(held.get("type")))
                listed.append(None if given is None else isinstance(given, list))
                rows = given if isinstance(given, list) else []
                relations.append([{"is_object": isinstance(r, dict), **{c: as_value(r.get(c) if isinstance(r, dict) else None) for c in ("relation", "target", "target_type")}} for r in rows])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(kinds, _VALUE), pa.array(listed, pa.bool_()), pa.array(relations, pa.list_(_ENTRY))],
                names=["bundle_id", "path", "type", "listed", "relations"],
            )

    value = "struct<value:string,is_text:boolean>"
    entry = f"struct<is_object:boolean,relation:{value},target:{value},target_type:{value}>"
    return files.select("bundle_id", "path", "markdown").mapInArrow(parse, f"bundle_id {kind}, path string, type {value}, listed boolean, relations array<{entry}>")


def parsed_manifests(manifests: DataFrame) -> DataFrame:
    """bundle_id, allowed relations (null unless a non-empty list) and roots, as they are given, of ``manifests`` (bundle_id, manifest)."""
    kind = manifests.schema["bundle_id"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            allowed, roots = [], []
            for text in batch.column(1).to_pylist():
                held = plain_yaml.load(text or "")
                part = lambda name, of=held: of.get(name) if isinstance(of, dict) and isinstance(of.get(name), dict) else {}
                given, entries = part("relations").get("allowed"), part("base").get("roots")
                allowed.append([str(a) for a in given] if isinstance(given, list) and given else None)
                roots.append([str(r["path"]) for r in entries if isinstance(r, dict) and r.get("path")] if isinstance(entries, list) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(allowed, pa.list_(pa.string())), pa.array(roots, pa.list_(pa.string()))], names=["bundle_id", "allowed", "roots"])

    return manifests.select("bundle_id", "manifest").mapInArrow(parse, f"bundle_id {kind}, allowed array<string>, roots array<string>")


def _within(path: Column, root: Column) -> Column:
    """Whether a normal path lies below a normal root; the empty root holds all that doesn't climb out."""
    return F.when(root == "", (path != "..") & ~path.startswith("../")).otherwise((path == root) | path.startswith(F.concat(root, F.lit("/"))))


def _decoded(path: Column) -> Column:
    """Percent signs resolved; what is malformed stays."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def relation_lint(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """bundle_id, file, relation_index and rule of every violation; a manifest's own have no file.

    ``files`` are all files of the bundle (bundle_id, path, markdown; null for what is
    not Markdown). Those that end in ``.md`` and lie below a root are read, once for
    each such root; targets must stay within the first root that holds their file. An
    entry can break several rules; the first that speaks against its target ends the
    look at the target.
    """
    rules = parsed_manifests(manifests)
    own = rules.select("bundle_id", F.explode(F.array_compact(F.array(F.when(F.col("allowed").isNull(), RULES[0]), F.when(F.size("roots") == 0, RULES[1])))).alias("rule"))
    own = own.select("bundle_id", F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("relation_index"), "rule")
    read = written(parsed_files(files), "parsed")  # both ends of a relation come from it
    there = read.select(F.col("bundle_id").alias("_tb"), F.col("path").alias("_there"), F.col("type").alias("_type"))
    folders = files.select("bundle_id", F.explode(F.expr("transform(sequence(1, size(split(path, '/')) - 1), i -> array_join(slice(split(path, '/'), 1, i), '/'))")).alias("_folder"))
    folders = folders.filter(F.col("_folder").endswith(".md")).distinct()

    plain = rules.select("bundle_id", F.coalesce("allowed", F.array().cast("array<string>")).alias("allowed"), F.transform("roots", normal_path).alias("roots"))
    held = read.filter(F.col("path").endswith(".md") & F.col("listed").isNotNull()).join(plain, "bundle_id")
    held = held.withColumn("_roots", F.filter("roots", lambda r: _within(F.col("path"), r))).filter(F.size("_roots") > 0)
    held = held.withColumn("_root", F.get("_roots", 0)).withColumn("_copy", F.explode("_roots"))
    unlisted = held.filter("not listed").select("bundle_id", F.col("path").alias("file"), F.lit(None).cast("int").alias("relation_index"), F.lit("relations_not_list").alias("rule"))

    rows = held.filter("listed").select("bundle_id", "path", "allowed", "_root", F.posexplode("relations").alias("relation_index", "r"))
    target, typed = F.col("r.target"), F.col("r.target_type")
    asked = F.trim(target["value"])
    before = F.regexp_extract(asked, r"^([^?#]*)", 1)
    way = _decoded(before)
    wrong = (
        F.when(~target["is_text"] | (asked == ""), "missing_target").when(F.contains(asked, F.lit("\\")), "backslash_target").when(asked.rlike(_SCHEME), "url_target")
        .when(asked.startswith("/"), "absolute_target").when(asked.rlike(r"^[^?#]*\?[^#]"), "query_string_target").when(~way.endswith(".md"), "non_markdown_target")
        .when(way.startswith("/"), "absolute_target")
    )
    rows = rows.withColumns({"_wrong": wrong, "_path": normal_path(F.concat(F.regexp_extract("path", "^(.*/)?[^/]*$", 1), way))})
    rows = rows.withColumn("_wrong", F.coalesce("_wrong", F.when(~_within(F.col("_path"), F.col("_root")), "target_escapes_root")))
    met = rows.join(there, (F.col("bundle_id") == F.col("_tb")) & (F.col("_path") == F.col("_there")), "left")
    met = met.join(folders.withColumnRenamed("bundle_id", "_b"), (F.col("bundle_id") == F.col("_b")) & (F.col("_path") == F.col("_folder")), "left")
    at = F.coalesce("_wrong", F.when(F.col("_there").isNull(), F.when(F.col("_folder").isNull(), "missing_target_file").otherwise("target_not_file")))
    declared = F.coalesce(typed["value"], F.lit("")) != ""
    differs = declared & ~(F.col("_type.value").eqNullSafe(typed["value"]) & F.col("_type.is_text").eqNullSafe(typed["is_text"]))
    known = F.coalesce(F.array_contains("allowed", F.col("r.relation.value")) & F.col("r.relation.is_text"), F.lit(False))
    unnamed = ~typed["is_text"] | (F.trim(F.coalesce(typed["value"], F.lit(""))) == "")
    found = F.when(~F.col("r.is_object"), F.array(F.lit("relation_not_object"))).otherwise(
        F.array_compact(F.array(F.when(~known, "invalid_relation"), F.when(unnamed, "missing_target_type"), F.coalesce(at, F.when(differs, "target_type_mismatch"))))
    )
    broken = met.select("bundle_id", F.col("path").alias("file"), "relation_index", F.explode(found).alias("rule"))
    return own.unionByName(unlisted).unionByName(broken)
