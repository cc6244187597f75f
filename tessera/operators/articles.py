"""Articles and their upkeep: bodies, excerpts, repair reports, processing stages, approval content, profiles and path moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import collapsed, normalized
from tessera.operators.lifecycle import error_codes

# Metadata that a clarification never asks for.
PROHIBITED = (
    "coverage_type", "covered_rag_chunk_ids", "approved_at", "approved_by", "knowledge_version", "last_verified", "relations", "review_status",
    "revision", "source_authority", "source_pages",
)
OPEN_STAGES = ("failed", "action_required", "running", "queued")


def _quoted(value: Column) -> Column:
    """A regular expression for just this value."""
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def article_body(body: Column, title: Column) -> Column:
    """The body without repeated first-level headings of the title at its start, and without a last section named Source."""
    unix = F.regexp_replace(body, "\r\n?", "\n")
    heads = F.concat(F.lit(r"(?i)^(\s*#[ \t]+"), _quoted(collapsed(title)), F.lit(r"[ \t]*(\n|$))+"))
    start = F.when(collapsed(title) == "", unix).otherwise(F.regexp_replace(unix, heads, F.lit("")))
    last = r"(?s)^(.*)(?:^|\n)##[ \t]+([^\n]*)(?:\n.*)?$"
    cut = F.when(F.lower(collapsed(F.regexp_extract(start, last, 2))) == "source", F.regexp_extract(start, last, 1)).otherwise(start)
    return F.regexp_replace(cut, r"^\s+|\s+$", "")


def citation_excerpt(text: Column, title: Column) -> Column:
    """An excerpt in normal form, on one line, without its source section, headings of its title and heading marks."""
    plain = F.regexp_replace(normalized(text, "NFKC"), r"(?is)\s+#{2,6}\s+Source(\s.*|$)", "")
    own = F.concat(F.lit(r"(?i)(^|\s)#{1,6}\s+"), _quoted(F.trim(normalized(title, "NFKC"))), F.lit(r"(?=\s|$)"))
    plain = F.when(F.trim(title) == "", plain).otherwise(F.regexp_replace(plain, own, F.lit(" ")))
    return collapsed(F.regexp_replace(plain, r"(^|\s)#{1,6}\s+", "$1"))


def repair_report(articles: DataFrame) -> DataFrame:
    """path, hash before and after the body is normalised, and whether it changes."""
    made = articles.select("path", F.sha2("body", 256).alias("before"), F.sha2(article_body(F.col("body"), F.col("title")), 256).alias("after"))
    return made.withColumn("changed", F.col("before") != F.col("after"))


def stage_header(stages: Column) -> tuple[Column, Column, Column]:
    """Of stages (id, status) in order: the current one, the header's tone, and whether nothing is left to do."""
    has = lambda *names: F.exists(stages, lambda s: s["status"].isin(*names))
    current = F.coalesce(F.get(F.filter(stages, lambda s: s["status"].isin(*OPEN_STAGES)), 0)["id"], F.element_at(stages, -1)["id"])
    active = has("running", "queued")
    tone = F.when(has("failed"), "failed").when(has("action_required"), "attention").when(active, "active").otherwise("success")
    settled = F.forall(stages, lambda s: s["status"].isin("completed", "skipped"))
    return current, tone, ~active & (has("failed", "action_required") | settled)


def approved_content(choice: Column) -> tuple[Column, Column, Column]:
    """Title, summary and error of a topic row that is approved with its raw or its enriched content."""
    lacking = F.coalesce(F.col("enriched_title"), F.lit("")) == ""
    lacking = lacking | (F.coalesce(F.col("enriched_summary"), F.lit("")) == "")
    error = F.when(F.col("review_status") == "approved", "topic_already_approved").when((choice == "enriched") & lacking, "topic_enrichment_required_for_approval")
    pick = lambda c: F.when(error.isNull(), F.when(choice == "enriched", F.col(f"enriched_{c}")).otherwise(F.col(c)))
    return pick("title"), pick("summary"), error


def answerable(metadata: Column, allowed: tuple[str, ...]) -> Column:
    """The metadata map with the allowed fields only, less those that are never asked for."""
    names = [a for a in allowed if a not in PROHIBITED]
    return F.map_filter(metadata, lambda k, v: k.isin(*names))


def merged_retry(first: DataFrame, retry: DataFrame, most: int) -> DataFrame:
    """Evidence (query_id, key, rank) of both tries, once each, first try first, at most ``most`` a query; ``added`` marks what the retry brought."""
    both = first.withColumn("_try", F.lit(0)).unionByName(retry.withColumn("_try", F.lit(1)))
    once = both.groupBy("query_id", "key").agg(F.min(F.struct("_try", "rank")).alias("_at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_at", "key"))
    return once.select("query_id", "key", (F.col("_at._try") == 1).alias("added"), place.alias("rank")).filter(F.col("rank") <= most)


def fingerprint(*columns: str) -> Column:
    """sha256 of the named columns as one JSON object, in the given order; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def changed_since(rows: DataFrame, confirmed: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Keys whose fingerprint is not the confirmed one any more."""
    now = rows.select(key, fingerprint(*columns).alias("_now"))
    return confirmed.join(now, key).filter("_now <> fingerprint").select(key)


def library(documents: DataFrame, status: str, text: str) -> DataFrame:
    """Documents of a status (``all``: any) whose title or a tag holds the text, whatever its case."""
    asked = text.strip().lower()
    held = F.contains(F.lower("title"), F.lit(asked)) | F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(asked)))
    return documents.filter((F.lit(status) == "all") | (F.col("status") == status)).filter(F.lit(not asked) | held)


def profile_errors(files: DataFrame, types: tuple[str, ...], required: tuple[str, ...]) -> DataFrame:
    """path and errors of the files that a profile does not allow: types, and required fields that are null or blank."""
    missing = {f"missing_{f}": F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "" for f in required}
    untyped = F.coalesce(F.trim("type"), F.lit("")) == ""
    errors = error_codes(type_required=untyped, type_not_allowed=~untyped & ~F.col("type").isin(*types), **missing)
    return files.select("path", errors.alias("errors")).filter(F.size("errors") > 0)


def replaced_scope(held: DataFrame, changes: DataFrame) -> DataFrame:
    """Sessions (session_id, bundles, version) after their scope is set anew; the version goes up only if the scope changes."""
    new = changes.select("session_id", F.array_distinct("bundles").alias("_bundles"))
    rows = held.join(new, "session_id", "left")
    differs = F.col("_bundles").isNotNull() & ~F.col("_bundles").eqNullSafe(F.col("bundles"))
    return rows.select("session_id", F.coalesce("_bundles", "bundles").alias("bundles"), (F.col("version") + differs.cast("long")).alias("version"))


def moved_paths(rows: DataFrame, moves: DataFrame, column: str) -> DataFrame:
    """Rows with the column's paths replaced as ``moves`` (old, new) says; others stay."""
    held = moves.select(F.col("old").alias(column), F.col("new").alias("_new"))
    return rows.join(held, column, "left").withColumn(column, F.coalesce("_new", column)).select(rows.columns)


def page_estimates(topics: DataFrame, pages: DataFrame) -> DataFrame:
    """Estimated tokens of each document's topics: their pages joined by line ends, a token for every four characters."""
    sized = pages.select("document_id", "page", F.length("text").alias("n"))
    paged = topics.select("document_id", "topic_id", F.explode(F.array_distinct("pages")).alias("page")).join(sized, ["document_id", "page"])
    per = paged.groupBy("document_id", "topic_id").agg(F.ceil((F.sum("n") + F.count(F.lit(1)) - 1) / 4).cast("long").alias("tokens"))
    return per.groupBy("document_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("topics"))
