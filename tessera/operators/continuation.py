"""Topics that continue over a page break because both pages say so.

A break needs a forward marker among the last lines of a page and a backward
marker among the first lines of the next one. Which topics its labels fit is
decided for all topics and breaks by a join and expressions. What is left is the
growth: a topic only grows at its ends, so a break is looked at again only when an
end of a topic arrives there, in the order in which repeated sweeps over the
breaks would come to it.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalized
from tessera.lineage import written
from tessera.operators.topics import SEEN_LINES, lines_of

# The marker patterns, and words that carry no meaning in a label.
FORWARD = r"(?i)^(.*?)[\s:;,.–—-]*(?:continue|continued|continues)\s+(?:(?:on\s+)?(?:the\s+)?next\s+page|overleaf)\s*$"
BACKWARD = r"(?i)^(.*?)[\s:;,.\-–—]*[(\[]?\s*(?:continued|continuation|cont\s*['’]?\s*d)(?:\s+from\s+(?:the\s+)?previous\s+page)?\s*[)\]]?\s*$"
CONNECTORS = ("a", "an", "and", "continued", "continuation", "contd", "for", "of", "or", "the", "to")


def boundaries(pages: DataFrame) -> DataFrame:
    """document_id, from_page, forward and backward marker lines of every marked page break."""
    after = Window.partitionBy("document_id").orderBy("page")
    lines = lines_of(F.regexp_replace(normalized(F.col("text"), "NFKC"), r"[\p{Cc}\p{Cf}&&[^\n]]", " "))
    last = F.filter(F.slice(F.reverse(lines), 1, SEEN_LINES), lambda x: x.rlike(FORWARD))
    first = F.filter(F.slice(lines, 1, SEEN_LINES), lambda x: x.rlike(BACKWARD) & ~x.rlike(r"(?i)\bnext\s+page\b"))
    marked = pages.select("document_id", "page", F.get(last, 0).alias("forward"), F.get(first, 0).alias("_own"))
    marked = marked.withColumns({"backward": F.lead("_own").over(after), "_next": F.lead("page").over(after)})
    both = marked.filter("forward is not null and backward is not null and _next = page + 1")
    return both.select("document_id", F.col("page").alias("from_page"), "forward", "backward")


def label_words(text: Column) -> Column:
    """Words of letters and digits that mean something, in order."""
    return _words(normalized(F.coalesce(text, F.lit("")), "NFKC"))


def _words(text: Column) -> Column:
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*CONNECTORS))


def related(a: Column, b: Column) -> Column:
    """Whether two labels are the same, or the words of one run through the other; single words must be the whole label."""
    spaced = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    run = F.contains(spaced(a), spaced(b)) | F.contains(spaced(b), spaced(a))
    return F.when(F.least(F.size(a), F.size(b)) == 1, a == b).otherwise((F.least(F.size(a), F.size(b)) > 1) & run)


def fitting_breaks(breaks: DataFrame, topics: DataFrame) -> DataFrame:
    """document_id, topic_id and from_page of the breaks whose labels fit the topic (title, headings in normal form).

    The labels of both markers, where they have any, must go together; then each must
    go with the title or a heading, and a label of one word must be a whole heading.
    A break without labels fits every topic.
    """
    marked = breaks.select("document_id", "from_page", label_words(F.regexp_extract("forward", FORWARD, 1)).alias("_a"), label_words(F.regexp_extract("backward", BACKWARD, 1)).alias("_b"))
    marked = marked.filter((F.size("_a") == 0) | (F.size("_b") == 0) | related(F.col("_a"), F.col("_b")))
    heads = F.transform(F.coalesce("headings", F.array().cast("array<string>")), lambda h: _words(F.coalesce(h, F.lit(""))))
    named = topics.select("document_id", "topic_id", label_words(F.col("title")).alias("_title"), heads.alias("_heads"))

    def suits(label: Column) -> Column:
        known = F.concat(F.array("_title"), F.col("_heads"))
        return (F.size(label) == 0) | F.when(F.size(label) == 1, F.exists("_heads", lambda h: h == label)).otherwise(F.exists(known, lambda k: related(k, label)))

    met = marked.join(named, "document_id")
    return met.filter(suits(F.col("_a")) & suits(F.col("_b"))).select("document_id", "topic_id", "from_page")


def grown(pages: list[set[int]], fits: list[set[int]]) -> tuple[list[set[int]], list[set[int]]]:
    """The pages of each topic after growth, and the breaks at which it is one of several.

    A topic stands at a break (p, p + 1) if it ends at p, begins at p + 1, or holds
    both. A break that exactly one fitting topic stands at gives it both pages. Ends
    move up within a sweep and down for the next one.
    """
    pages = [set(own) for own in pages]
    low, high = [min(own) for own in pages], [max(own) for own in pages]

    def standing(p: int) -> list[int]:
        return [t for t, open_ in enumerate(fits) if p in open_ and (high[t] == p or low[t] == p + 1 or (p in pages[t] and p + 1 in pages[t]))]

    breaks = set().union(*fits) if fits else set()
    turns = [(0, p) for p in sorted(breaks)]
    waiting = set(turns)
    while turns:
        sweep, p = heapq.heappop(turns)
        waiting.discard((sweep, p))
        here = standing(p)
        if len(here) != 1 or {p, p + 1} <= pages[here[0]]:
            continue
        topic = here[0]
        pages[topic] |= {p, p + 1}
        low[topic], high[topic] = min(low[topic], p), max(high[topic], p + 1)
        for turn in ((sweep, p + 1), (sweep + 1, p - 1)):
            if turn[1] in breaks and turn not in waiting:
                heapq.heappush(turns, turn)
                waiting.add(turn)
    several: list[set[int]] = [set() for _ in pages]
    for p in breaks:
        here = standing(p)
        for t in here if len(here) > 1 else ():
            several[t].add(p)
    return pages, several


def resolve_continuations(pages: DataFrame, topics: DataFrame) -> DataFrame:
    """Topics (document_id, topic_id, title, headings, pages) with pages, added and ambiguous breaks; topics without pages are left out."""
    plain = topics.select(F.col("document_id").cast("long").alias("document_id"), F.col("topic_id").cast("long").alias("topic_id"), "title", "headings", F.col("pages").cast("array<long>").alias("pages")).filter(F.size("pages") > 0)
    headings = F.split(normalized(F.array_join(F.coalesce("headings", F.array().cast("array<string>")), "\x00"), "NFKC"), "\x00")
    fits = fitting_breaks(boundaries(pages), plain.withColumn("headings", headings)).groupBy("document_id", "topic_id").agg(F.collect_list(F.col("from_page").cast("long")).alias("fits"))
    held = written(plain.drop("title", "headings").join(fits, ["document_id", "topic_id"], "left"), "fits")
    # Topics that no break fits don't change, and don't meet the others of their document.
    still = held.filter("fits is null").select("document_id", "topic_id", F.array_sort(F.array_distinct("pages")).alias("pages"), *(F.array().cast("array<long>").alias(c) for c in ("added", "ambiguous")))

    def grow(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["topic_id"])
        before = [set(r["pages"]) for r in rows]
        after, several = grown(before, [set(r["fits"]) for r in rows])
        listed = pa.list_(pa.int64())
        columns = {"pages": after, "added": [a - b for a, b in zip(after, before, strict=True)], "ambiguous": several}
        ids = {c: pa.array([r[c] for r in rows], pa.int64()) for c in ("document_id", "topic_id")}
        return pa.table(ids | {c: pa.array([sorted(x) for x in v], listed) for c, v in columns.items()})

    schema = "document_id long, topic_id long, pages array<long>, added array<long>, ambiguous array<long>"
    return held.filter("fits is not null").groupBy("document_id").applyInArrow(grow, schema).unionByName(still)
