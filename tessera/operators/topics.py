"""Topic segmentation: repeated lines, heading candidates, sections and continuations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import SPACE, collapsed
from tessera.lineage import written

HEADING_MOST, SEEN_LINES = 90, 8
# Lines that are never headings.
NON_HEADINGS = (
    r"(?i)^page\s+\d+$", r"(?i)^effective\s+on:", r"(?i)^(description|general)$", r"^\d+(\.\d+)+$",
    r"^[A-Za-z]+\.[A-Za-z]+\.\d+$", r"\.{4,}\s*\d", r"^[A-Za-z]{1,3}$",
)


def lines_of(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def normal_line(line: Column) -> Column:
    return F.lower(collapsed(line))


def repeated_lines(pages: DataFrame) -> DataFrame:
    """Lines among the first eight of at least min(3, pages) pages of their document.

    ``pages`` has document_id, page and text. In a document of one page every
    line counts as repeated.
    """
    normal = F.filter(F.transform(F.split("text", "\r?\n"), normal_line), lambda x: (x != "") & (F.length(x) <= HEADING_MOST))
    seen = pages.select("document_id", F.explode(F.array_distinct(F.slice(normal, 1, SEEN_LINES))).alias("line"))
    counts = seen.groupBy("document_id", "line").agg(F.count(F.lit(1)).alias("n_pages"))
    sizes = pages.groupBy("document_id").agg(F.least(F.lit(3), F.count(F.lit(1))).alias("least"))
    return counts.join(sizes, "document_id").filter("n_pages >= least").select("document_id", "line", "n_pages")


def boundary_lines(pages: DataFrame, edge: int = 3) -> DataFrame:
    """Normal forms of lines that stand among the first or last three of many pages, counted with repetition.

    A line is a boundary if it is counted at least max(3, 30 % of the pages) times.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), normal_line), lambda x: x != "")
    ends = F.concat(F.slice(lines, 1, edge), F.reverse(F.slice(F.reverse(lines), 1, edge)))
    counts = pages.select("document_id", F.explode(ends).alias("line")).groupBy("document_id", "line").agg(F.count(F.lit(1)).alias("n"))
    sizes = pages.groupBy("document_id").agg(F.greatest(F.lit(3).cast("long"), F.ceil(F.count(F.lit(1)) * F.lit(0.3)).cast("long")).alias("least"))
    return counts.join(sizes, "document_id").filter("n >= least").select("document_id", "line", "n")


def without_boundaries(pages: DataFrame, edge: int = 3) -> DataFrame:
    """Pages (document_id, page, text) without running headers and footers; pages that hold nothing else are left out.

    A line goes by its place: it must be among the first or last three lines of the
    page as it stands, blank ones included, and its normal form a boundary line. All
    other lines stay as they are. Only the few lines at the edges meet the boundary
    lines, not the texts.
    """
    lines = F.split("text", "\n")
    last = F.size(lines) - 1
    at = F.array_distinct(F.concat(F.sequence(F.lit(0), F.least(F.lit(edge - 1), last)), F.sequence(F.greatest(F.lit(0), last - edge + 1), last)))
    edges = pages.select("document_id", "page", F.explode(F.transform(at, lambda i: F.struct(i.alias("at"), normal_line(F.get(lines, i)).alias("line")))).alias("_e"))
    hit = edges.select("document_id", "page", "_e.at", "_e.line").join(boundary_lines(pages, edge).select("document_id", "line"), ["document_id", "line"], "left_semi")
    gone = hit.groupBy("document_id", "page").agg(F.collect_set("at").alias("_gone"))
    held = pages.join(gone, ["document_id", "page"], "left")
    kept = F.filter(lines, lambda _, i: ~F.coalesce(F.array_contains("_gone", i), F.lit(False)))
    text = F.regexp_replace(F.array_join(kept, "\n"), f"^{SPACE}+|{SPACE}+$", "")
    return held.withColumn("text", text).filter("text <> ''").select(pages.columns)


def _confidence(line: Column) -> Column:
    """high for capitals or numbered headings, medium for short titles, else null."""
    upper = F.length(F.regexp_replace(line, "[^A-Z]", ""))
    lower = F.length(F.regexp_replace(line, "[^a-z]", ""))
    caps = (upper > 0) & (lower <= F.greatest(F.lit(1.0), upper * F.lit(0.15)))
    numbered = line.rlike(r"(?i)^(ATA|CHAPTER|SECTION|TASK)([^A-Za-z0-9_]|$)") | line.rlike(r"^\d+(\.\d+)+\s+[A-Za-z]")
    title = (F.size(F.split(line, r"\s+")) <= 8) & ~line.rlike("[.!?]$")
    return F.when(caps | numbered, "high").when(title, "medium")


def heading_candidates(pages: DataFrame) -> DataFrame:
    """document_id, page, heading and confidence: the first acceptable line among the first eight of a page."""
    repeated = repeated_lines(pages).groupBy("document_id").agg(F.collect_set("line").alias("repeated"))
    held = pages.join(repeated, "document_id", "left").withColumn("repeated", F.coalesce("repeated", F.array().cast("array<string>")))

    def acceptable(line: Column) -> Column:
        junk = F.lit(False)
        for pattern in NON_HEADINGS:
            junk = junk | line.rlike(pattern)
        return (F.length(line) <= HEADING_MOST) & ~F.array_contains("repeated", normal_line(line)) & ~junk & _confidence(line).isNotNull()

    first = F.get(F.filter(F.slice(lines_of(F.col("text")), 1, SEEN_LINES), acceptable), 0)
    found = held.select("document_id", "page", first.alias("heading")).filter("heading is not null")
    return found.withColumn("confidence", _confidence(F.col("heading")))


def heading_sections(pages: DataFrame) -> DataFrame:
    """Sections that begin at a heading and end at the last page before the next one.

    A heading equal to the one right before it is dropped. Documents without a
    heading get coarse ranges of five pages.
    """
    order = Window.partitionBy("document_id").orderBy("page")
    heads = heading_candidates(pages).withColumn("before", F.lag(normal_line(F.col("heading"))).over(order))
    heads = heads.filter(F.col("before").isNull() | (F.col("before") != normal_line(F.col("heading"))))
    heads = written(heads.withColumn("next", F.lead("page").over(order)).withColumnRenamed("page", "page_start"), "heads")
    last = pages.select("document_id", "page")
    inside = heads.join(last, "document_id").filter((F.col("page") >= F.col("page_start")) & (F.col("next").isNull() | (F.col("page") < F.col("next"))))
    sections = inside.groupBy("document_id", "page_start", "heading", "confidence").agg(F.max("page").alias("page_end"), F.count(F.lit(1)).alias("n_pages"))
    low = F.lower(F.col("heading"))
    kind = (
        F.when(low.contains("fault"), "fault_isolation").when(low.contains("procedure") | low.contains("task"), "procedure")
        .when(low.contains("ata"), "manual_section").otherwise("document_section")
    )
    sections = sections.withColumn("topic_type", kind)
    coarse = fixed_page_groups(pages.join(heads.select("document_id").distinct(), "document_id", "left_anti"))
    coarse = coarse.withColumns({"confidence": F.lit("low"), "topic_type": F.lit("coarse_range")})
    columns = ["document_id", "page_start", "page_end", "heading", "confidence", "n_pages", "topic_type"]
    return sections.select(columns).unionByName(coarse.withColumnRenamed("title", "heading").select(columns))


def fixed_page_groups(pages: DataFrame, size: int = 5) -> DataFrame:
    """Groups of five consecutive pages of a document with a page title."""
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("page")) - 1
    grouped = pages.select("document_id", "page", F.floor(number / size).alias("part"))
    spans = grouped.groupBy("document_id", "part").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count(F.lit(1)).alias("n_pages"))
    one = F.col("page_start") == F.col("page_end")
    title = F.when(one, F.concat(F.lit("Page "), "page_start")).otherwise(F.concat(F.lit("Pages "), "page_start", F.lit("-"), "page_end"))
    return spans.withColumn("title", title)


def page_windows(pages: DataFrame, most_tokens: int = 18000, most_pages: int = 20) -> DataFrame:
    """Windows of consecutive pages (document_id, page, tokens); each begins with the last page of the one before.

    A window closes before a page that would take it over a limit, so its extent
    depends on all windows before it and is found by walking the document.
    """
    import pyarrow as pa

    def walk(key: tuple, held: pa.Table) -> pa.Table:
        rows = sorted(zip(held.column("page").to_pylist(), held.column("tokens").to_pylist(), strict=True))
        windows, current, used = [], [], 0
        for page, size in rows:
            if current and (used + size > most_tokens or len(current) >= most_pages):
                windows.append(current)
                current = current[-1:]
                used = current[0][1]
            current = [*current, (page, size)]
            used += size
        if current:
            windows.append(current)
        n = len(windows)
        return pa.table({
            "document_id": pa.array([key[0].as_py()] * n, pa.int64()), "window": pa.array(range(n), pa.int32()),
            "pages": pa.array([[p for p, _ in w] for w in windows], pa.list_(pa.int64())), "tokens": pa.array([sum(t for _, t in w) for w in windows], pa.int64()),
        })

    held = pages.select(F.col("document_id").cast("long").alias("document_id"), F.col("page").cast("long").alias("page"), F.col("tokens").cast("long").alias("tokens"))
    return held.groupBy("document_id").applyInArrow(walk, "document_id long, window int, pages array<long>, tokens long")
