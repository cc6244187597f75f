"""Knowledge bundles as files: scanning, frontmatter, summaries, export and registries.

A bundle is a tree of Markdown files with a frontmatter block of scalars, lists
and typed relations.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import slug

RELATION = T.StructType([T.StructField(n, T.StringType()) for n in ("relation", "target", "target_type", "reason")])
PARSED = T.StructType([
    T.StructField("scalars", T.MapType(T.StringType(), T.StringType())),
    T.StructField("lists", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("relations", T.ArrayType(RELATION)),
    T.StructField("body", T.StringType()),
])


def scan_bundle(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to ``root``) and markdown of every ``*.md`` file below ``root``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    full = F.col("_metadata.file_path")
    tail = root.rstrip("/").rsplit("/", 1)[-1]
    relative = F.element_at(F.split(full, f"/{tail}/", 2), -1)
    return files.select(F.url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("markdown"))


def _unquoted(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def parse_markdown(markdown: str | None) -> dict:
    """Scalars, lists, relations and body of one file; lines that fit no form are skipped."""
    lines = (markdown or "").replace("\r\n", "\n").split("\n")
    out: dict = {"scalars": {}, "lists": {}, "relations": [], "body": markdown or ""}
    if lines[0] != "---" or "---" not in lines[1:]:
        return out
    end = lines.index("---", 1)
    out["body"] = "\n".join(lines[end + 1 :]).strip("\n")
    key, relation = None, None
    for line in lines[1:end]:
        inner = line.strip()
        if line.startswith("  ") and key:
            item = inner[2:].strip() if inner.startswith("- ") else inner
            name, colon, value = item.partition(":")
            if key == "relations" and colon:
                if inner.startswith("- "):
                    relation = dict.fromkeys(("relation", "target", "target_type", "reason"))
                    out["relations"].append(relation)
                if relation is not None and name.strip() in relation:
                    relation[name.strip()] = _unquoted(value)
            elif inner.startswith("- ") and key != "relations":
                out["lists"].setdefault(key, []).append(_unquoted(item))
        elif not line.startswith(" ") and ":" in line:
            key, _, value = line.partition(":")
            key = key.strip()
            if value.strip() and value.strip() != "[]":
                out["scalars"][key] = _unquoted(value)
                key = None
            elif key != "relations":
                out["lists"].setdefault(key, [])
    return out


def parse_bundle(files: DataFrame) -> DataFrame:
    """``files`` (path, markdown) as path, scalars, lists, relations and body."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [
            pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.list_(pa.string())),
            pa.list_(pa.struct([(f.name, pa.string()) for f in RELATION.fields])), pa.string(),
        ]
        for batch in batches:
            made = [parse_markdown(m) for m in batch.column(1).to_pylist()]
            columns = [pa.array([list(m[n].items()) if isinstance(m[n], dict) else m[n] for m in made], k) for n, k in zip(PARSED.names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["path", *PARSED.names])

    return files.select("path", "markdown").mapInArrow(parse, T.StructType([T.StructField("path", T.StringType()), *PARSED.fields]))


def concept_columns(parsed: DataFrame) -> DataFrame:
    """The fields of a concept as columns."""
    scalar = lambda n: F.element_at("scalars", F.lit(n))
    listed = lambda n: F.coalesce(F.element_at("lists", F.lit(n)), F.array().cast("array<string>"))
    pages = F.element_at("lists", F.lit("source_pages"))
    return parsed.select(
        "path", scalar("type").alias("type"), scalar("title").alias("title"), scalar("description").alias("description"),
        scalar("review_status").alias("review_status"), scalar("source_file").alias("source_file"), pages.alias("source_pages"),
        F.array_compact(F.transform(F.coalesce(pages, F.array().cast("array<string>")), lambda p: p.try_cast("int"))).alias("page_numbers"), listed("tags").alias("tags"), scalar("updated").alias("updated"), "relations", "body",
    )


# The pattern of a type, and files that are no concepts.
TYPE_PATTERN = "^[a-z][a-z0-9_-]{0,63}$"
RESERVED = ("index.md", "log.md", "source_manifest.md")


def validation_errors(concepts: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """``keep``, errors, agent_ready and trust of concepts (path, type, title, description, tags, updated, review_status, source_file, source_pages, body).

    A null column was not given; a blank one was. A date must be a real one in ISO
    form. An agent may use a valid concept that is approved and has a title, a body,
    a source file and source pages, all positive whole numbers. Trust says which of
    these a file falls short of; reserved files are not judged.
    """
    given = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    blank = lambda c: F.col(c).isNotNull() & ~given(c)
    day = F.trim("updated")
    real = F.coalesce(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)) & (F.date_format(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")), "yyyy-MM-dd") == day)
    checks = [
        (F.exists("tags", lambda t: ~given(t)), "tags_invalid"), (~given("type"), "type_required"), (given("type") & ~F.trim("type").rlike(TYPE_PATTERN), "type_invalid"),
        (blank("title"), "title_invalid"), (blank("description"), "description_invalid"), (given("updated") & ~F.coalesce(real, F.lit(False)), "updated_invalid"),
    ]
    errors = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(f"generic_okf_{n}")) for c, n in checks)))
    pages = F.transform(F.col("source_pages").cast("array<string>"), lambda p: p.try_cast("double"))
    whole = F.forall(pages, lambda p: F.coalesce((p > 0) & (p == F.floor(p)), F.lit(False)))
    ready = (F.col("review_status") == "approved") & given("title") & given("body") & given("source_file") & (F.size(pages) > 0) & whole
    some = F.col("review_status").isNotNull() | F.col("source_file").isNotNull() | F.col("source_pages").isNotNull()
    held = concepts.withColumn("errors", errors).withColumn("agent_ready", (F.size("errors") == 0) & F.coalesce(ready, F.lit(False)))
    trust = (
        F.when(F.col("path").isin(*RESERVED), "reserved").when(F.size("errors") > 0, "invalid_generic").when(F.col("agent_ready"), "agent_ready")
        .when(some, "missing_trust_metadata").otherwise("generic_valid")
    )
    return held.select(*keep, "errors", "agent_ready", trust.alias("trust"))


# The fields of every profile (the first is required), its own type, and the states of a concept.
BASE_FIELDS = (
    "type", "title", "description", "tags", "updated", "approved_at", "approved_by", "review_status", "source_file", "source_pages", "source_authority",
    "knowledge_version", "relations", "classification_code", "coverage_type", "covered_rag_chunk_ids", "document_type", "effectivity", "revision", "subject_family",
)
OWN_TYPE = "source_manifest"
STATUS_VALUES = ("raw_extracted", "needs_ai_cleanup", "needs_human_review", "approved", "rejected", "deprecated")


def manifest_text(profiles: DataFrame) -> DataFrame:
    """bundle_id and manifest of profiles (bundle_id, name, types, relations, fields: array of name and required).

    Fields are the base ones in their order, a profile's own word on one of them
    taking its place, then the others; types come in order of their names.
    """
    none = F.array().cast("array<struct<name:string,required:boolean>>")
    own = F.coalesce("fields", none)
    base = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(n == BASE_FIELDS[0]).alias("required")) for n in BASE_FIELDS))
    said = lambda f: F.get(F.filter(own, lambda o: o["name"] == f["name"]), 0)["required"]
    first = F.transform(base, lambda f: F.struct(f["name"].alias("name"), F.coalesce(said(f), F.when(F.exists(own, lambda o: o["name"] == f["name"]), F.lit(False)), f["required"]).alias("required")))
    rest = F.filter(own, lambda o: ~o["name"].isin(*BASE_FIELDS))
    fields = F.concat(first, F.transform(rest, lambda o: F.struct(o["name"].alias("name"), F.coalesce(o["required"], F.lit(False)).alias("required"))))
    listed = lambda need: F.transform(F.filter(F.col("_fields"), lambda f: f["required"] == need), lambda f: F.concat(F.lit("      - "), f["name"]))
    line = lambda *texts: F.array(*map(F.lit, texts))
    held = profiles.withColumn("_fields", fields)
    held = held.withColumn("_body", F.concat(line("      required:"), listed(True), line("      optional:"), listed(False), line("      status_values:", *(f"      - {s}" for s in STATUS_VALUES))))
    types = F.array_sort(F.array_distinct(F.array_append(F.coalesce("types", F.array().cast("array<string>")), F.lit(OWN_TYPE))))
    typed = F.flatten(F.transform(types, lambda t: F.concat(F.array(F.concat(F.lit("    "), t, F.lit(":"))), F.col("_body"))))
    quoted = F.col("name")
    for sign, written_as in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(sign), F.lit(written_as))
    quoted = F.concat(F.lit('"'), quoted, F.lit('"'))
    text = F.concat(
        line("okf_version: '0.1'", "base:"), F.array(F.concat(F.lit("  name: "), quoted)),
        line(
            "  roots:", "  - path: .", "    exclude_patterns:", "    - '**/.DS_Store'", "    - '**/README.md'", "  reserved_files:", "    index: index.md", "    log: log.md",
            "  status_field: review_status", "  link_resolution:", "    external_refs:", "    - source_manifest.md", "relations:", "  allowed:",
        ),
        F.transform(F.coalesce("relations", F.array().cast("array<string>")), lambda r: F.concat(F.lit("  - "), r)),
        line("profile:", "  date_fields:", "  - updated", "  - approved_at", "  - deprecated_at", "  types:"), typed,
        line("hygiene:", "  broken_links: error", "  split_candidates: warn", "  reserved_files: error", "  unknown_fields: error", ""),
    )
    return held.select("bundle_id", F.array_join(text, "\n").alias("manifest"))


def edges_of(parsed: DataFrame) -> DataFrame:
    """One row a relation: source, idx, relation, target, target_type, reason; targets are resolved from the source's folder."""
    from tessera.functions.text import safe_path

    rows = parsed.select(F.col("path").alias("source"), F.posexplode("relations").alias("idx", "r")).select("source", "idx", "r.*")
    folder = F.regexp_extract("source", "^(.*/)?[^/]*$", 1)
    return rows.withColumn("target", safe_path(F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat(folder, "target"))))


def summary(files: DataFrame, group: Column) -> DataFrame:
    """Files a group and the first file in order of path."""
    return files.groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_path"))


def tags_of(value: Column, most: int = 12) -> Column:
    """Comma-separated tags, trimmed, empty ones dropped, the first twelve."""
    return F.slice(F.filter(F.transform(F.split(value, ","), lambda t: F.trim(t)), lambda t: t != ""), 1, most)


def properties_of(value: Column, most: int = 16) -> Column:
    """``key: value`` lines as a map of the first sixteen with both parts; of repeated keys the last."""
    pairs = F.transform(F.split(value, "\n"), lambda x: F.split(x, ":", 2))
    pairs = F.filter(pairs, lambda p: (F.size(p) == 2) & (F.trim(p[0]) != "") & (F.trim(F.get(p, 1)) != ""))
    named = F.transform(F.slice(pairs, 1, most), lambda p: F.struct(F.trim(p[0]).alias("key"), F.trim(F.get(p, 1)).alias("value")))
    return F.map_from_entries(F.filter(named, lambda p: p.isNotNull()))


def concept_markdown(code: Column, title: Column, kind: Column, body: Column, source_file: Column, pages: Column) -> Column:
    """A concept file: frontmatter, title, body and source section."""
    listed = F.array_join(F.transform(pages, lambda p: F.concat(F.lit("  - "), p.cast("string"))), "\n")
    return F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("type: "), kind), F.concat(F.lit('title: "'), title, F.lit('"')), F.concat(F.lit("classification_code: "), code),
        F.concat(F.lit("source_file: "), source_file), F.lit("source_pages:"), listed, F.lit("---"), F.lit(""), F.concat(F.lit("# "), title), F.lit(""), body,
        F.lit(""), F.lit("## Source"), F.lit(""), F.concat(F.lit("- "), source_file, F.lit(", pages "), F.array_join(pages.cast("array<string>"), ", ")), F.lit(""),
    )


def concept_file_name(code: Column, title: Column, topic_id: Column) -> Column:
    """slug(code)-slug(title)-ten digits of the id's hash, as a Markdown file."""
    return F.concat(slug(code, 64), F.lit("-"), slug(title, 80), F.lit("-"), F.left(F.sha2(topic_id.cast("string"), 256), F.lit(10)), F.lit(".md"))


def index_lines(current: DataFrame, changes: DataFrame) -> DataFrame:
    """An index after its lines (bundle, path, line) are replaced by key: one text a bundle, in order of path."""
    lines = current.join(changes.select("bundle", "path"), ["bundle", "path"], "left_anti").unionByName(changes)
    return lines.groupBy("bundle").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "\n").alias("text"))


def replace_partition(df: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that ``df`` has rows of, and leave all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_at", at).filter("_at = 1").drop("_at")
