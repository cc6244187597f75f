"""Page texts from positioned text items, as PDF readers give them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import SPACE, bound, collapsed

#: Fixed value: how far an item may stand from the first item of its line.
NEAR = 2.0


def line_anchors(heights: Column, near: float = NEAR) -> Column:
    """The heights that open a line, in order: each is farther than ``near`` from all that opened one before it."""
    none = F.array().cast("array<double>")
    return F.aggregate(heights, none, lambda held, y: F.when(F.exists(held, lambda a: F.abs(a - y) <= near), held).otherwise(F.array_append(held, y)))


def page_texts(pages: DataFrame, items: DataFrame, near: float = NEAR) -> DataFrame:
    """``pages`` (document_id, page) with text and char_count (UTF-16 units).

    ``items`` has document_id, page, position (their order), x, y and text. An item
    joins the line that opened first among those within ``near`` of it, else it opens
    a line at its height. Lines go downwards, items of a line from left to right,
    ties by position; items without x or y follow as lines of their own. A word that
    a line end cuts before a small letter is joined. Blank items are left out, and a
    page without items has an empty text. The items of a page come together once,
    as its text does; only its distinct heights are compared to find its lines.
    """
    keys = ["document_id", "page"]
    held = items.withColumn("text", collapsed(F.col("text"))).filter("text <> ''")
    item = F.struct("position", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "text")
    gathered = held.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    placed = lambda i: i["x"].isNotNull() & i["y"].isNotNull()

    def in_lines(ys: Column) -> Column:
        """The items in order of reading, from the distinct heights in order of position."""
        number = lambda a: F.transform(ys, lambda y: F.array_position(F.transform(a, lambda top: F.abs(top - y) <= near), F.lit(True)))

        def row(i: Column, anchors: Column, numbers: Column) -> Column:
            line = F.get(numbers, (F.array_position(ys, i["y"]) - 1).cast("int"))
            down = F.when(placed(i), -F.get(anchors, (line - 1).cast("int"))).otherwise(F.lit(0.0))
            nth = F.when(placed(i), line).otherwise(i["position"].cast("long"))
            return F.struct(F.when(placed(i), 0).otherwise(1).alias("kind"), down.alias("down"), nth.alias("nth"), i["x"].alias("x"), i["position"].alias("position"), i["text"].alias("text"))

        return bound(line_anchors(ys, near), lambda a: bound(number(a), lambda n: F.array_sort(F.transform("_items", lambda i: row(i, a, n)))))

    heights = F.array_distinct(F.transform(F.filter("_items", placed), lambda i: i["y"]))
    same_line = lambda p, i: (i["kind"] == 0) & (p["kind"] == 0) & (p["nth"] == i["nth"])
    parted = lambda rows: F.transform(rows, lambda i, n: F.concat(F.when(n == 0, "").when(same_line(F.get(rows, n - 1), i), " ").otherwise("\n"), i["text"]))
    joined = gathered.select(*keys, F.array_join(bound(bound(heights, in_lines), parted), "").alias("text"))
    whole = F.regexp_replace(F.regexp_replace("text", r"-\n(?=[a-z])", ""), f"^{SPACE}+|{SPACE}+$", "")
    made = pages.select(*keys).join(joined, keys, "left").withColumn("text", F.coalesce(whole, F.lit("")))
    return made.withColumn("char_count", F.floor(F.octet_length(F.encode("text", "UTF-16BE")) / 2).cast("long"))
