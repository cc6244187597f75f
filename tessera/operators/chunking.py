"""Chunking of extracted pages into overlapping, self-describing pieces.

A page is cut into paragraphs at blank lines. Paragraphs are packed greedily up
to a target size, never over a maximum, and a new chunk begins with the last
paragraphs of the one before as long as these are small. Sizes are heuristic
token counts, 1.35 a word, so all sums are kept in words and turned into tokens
only when compared.

Pages of a document are gathered for packing; a document is the unit of work and
no smaller one keeps the order.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import SPACE, bound

TITLE_MOST, SECTION_MOST, HEADING_MOST = 80, 60, 120
_BLANK = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class ChunkSizes:
    """Token limits: maximum >= target > overlap >= 0."""

    most: int = 1200
    target: int = 800
    overlap: int = 120

    def __post_init__(self) -> None:
        if not (self.most >= self.target > self.overlap >= 0):
            raise ValueError("chunk sizes need maximum >= target > overlap >= 0")


@dataclass(frozen=True)
class Unit:
    """A paragraph or a part of one, with its page and its number of words."""

    page: int
    text: str
    words: int


def tokens(words: int) -> int:
    return max(1, math.ceil(words * 1.35))


def _unit(page: int, text: str) -> Unit:
    return Unit(page, text, len(text.split()))


def _line(value: str, most: int) -> str:
    return " ".join(value.split())[:most] or "Unspecified"


def heading_of(text: str) -> str | None:
    """The first line that is not blank, cut to 120 characters."""
    first = next((x.strip() for x in text.splitlines() if x.strip()), None)
    return first[:HEADING_MOST] if first else None


def header_of(title: str, units: list[Unit]) -> str:
    """The line that says which document, section and pages a chunk comes from."""
    heading = heading_of(units[0].text) or "Unspecified"
    pages = [u.page for u in units]
    span = str(min(pages)) if min(pages) == max(pages) else f"{min(pages)}-{max(pages)}"
    return f"[Document: {_line(title, TITLE_MOST)} | Section: {_line(heading, SECTION_MOST)} | Pages: {span}]\n"


def size_in_context(title: str, units: list[Unit]) -> int:
    """Tokens of the units below their header."""
    return tokens(len(header_of(title, units).split()) + sum(u.words for u in units))


def _grouped(parts: list[Unit], target: int, page: int) -> Iterator[Unit]:
    """Consecutive parts joined as long as they stay within the target."""
    run: list[Unit] = []
    for part in parts:
        if run and tokens(sum(u.words for u in run) + part.words) > target:
            yield _unit(page, " ".join(u.text for u in run))
            run = []
        run.append(part)
    if run:
        yield _unit(page, " ".join(u.text for u in run))


def _by_words(unit: Unit, most: int, target: int) -> list[Unit]:
    """The unit in runs of words that fit the target, if it does not fit whole."""
    if tokens(unit.words) <= most:
        return [unit]
    if most < tokens(1):
        raise ValueError("the chunk header leaves no room for a word")
    return list(_grouped([Unit(unit.page, w, 1) for w in unit.text.split()], target, unit.page))


def fitted(title: str, unit: Unit, sizes: ChunkSizes) -> list[Unit]:
    """The unit, or if it is too long with its header, parts of it: sentences, then runs of words."""
    whole = size_in_context(title, [unit])
    if whole <= sizes.most:
        return [unit]
    header = whole - tokens(unit.words)
    most = sizes.most - header
    if most < 1:
        raise ValueError("the chunk header exceeds the maximum")
    target = max(1, min(sizes.target - header, most))
    if tokens(unit.words) <= most:
        return [unit]
    sentences = [_unit(unit.page, s.strip()) for s in _SENTENCE.split(unit.text) if s.strip()]
    parts = [p for s in sentences for p in _by_words(s, most, target)]
    return [q for p in _grouped(parts, target, unit.page) for q in (_by_words(p, most, target) if size_in_context(title, [p]) > sizes.most else [p])]


def tail_of(units: list[Unit], overlap: int) -> list[Unit]:
    """The last units that a new chunk repeats; none if that would be all of them.

    They fit the overlap together; a single last unit may have twice the overlap.
    """
    kept = 0
    words = 0
    for unit in reversed(units):
        words += unit.words
        if tokens(words) > overlap * (1 if kept else 2) or not overlap:
            break
        kept += 1
    return [] if kept in (0, len(units)) else units[-kept:]


def chunk_pages(document: str, title: str | None, pages: list[tuple[int, str]], version: int = 1, sizes: ChunkSizes = ChunkSizes()) -> list[dict]:
    """Chunks of one document from its (page number, text) list."""
    title = title or document
    out: list[dict] = []
    seen: set[str] = set()

    def emit(units: list[Unit]) -> None:
        text = "\n\n".join(u.text for u in units)
        context = header_of(title, units) + text
        digest = hashlib.sha256(context.encode("utf-8", "surrogatepass")).hexdigest()
        if digest in seen:
            return
        seen.add(digest)
        numbers = list(dict.fromkeys(u.page for u in units))
        out.append({
            "id": f"rag_{document}_{version}_{min(numbers)}_{len(out)}_{digest[:12]}", "ordinal": len(out), "page_start": min(numbers),
            "page_end": max(numbers), "source_pages": numbers, "heading": heading_of(text), "text": text, "content_hash": digest,
            "token_count": size_in_context(title, units),
        })

    held: list[Unit] = []
    fresh = False
    units = (_unit(n, p.strip()) for n, text in pages for p in _BLANK.split(text or "") if p.strip())
    for unit in (part for whole in units for part in fitted(title, whole, sizes)):
        if fresh and size_in_context(title, [*held, unit]) > sizes.target:
            emit(held)
            held, fresh = tail_of(held, sizes.overlap), False
        if held and size_in_context(title, [*held, unit]) > sizes.most:
            if fresh:
                emit(held)
            held = []
        held, fresh = [*held, unit], True
        if size_in_context(title, held) >= sizes.most:
            emit(held)
            held, fresh = tail_of(held, sizes.overlap), False
    if fresh:
        emit(held)
    return out


_CHUNK = (
    "document_id string, id string, ordinal int, page_start int, page_end int, source_pages array<int>, heading string, "
    "text string, content_hash string, token_count int"
)


def chunk_documents(pages: DataFrame, version: int = 1, sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """Chunks of all documents in ``pages`` (document_id, title, page_number, text)."""

    def chunk(key: tuple, held: pa.Table) -> pa.Table:
        rows = sorted(zip(held.column("page_number").to_pylist(), held.column("text").to_pylist(), strict=True), key=lambda r: r[0])
        document = key[0].as_py()
        made = chunk_pages(document, held.column("title")[0].as_py(), rows, version, sizes)
        kinds = {"ordinal": pa.int32(), "page_start": pa.int32(), "page_end": pa.int32(), "source_pages": pa.list_(pa.int32()), "token_count": pa.int32()}
        columns = ["id", "ordinal", "page_start", "page_end", "source_pages", "heading", "text", "content_hash", "token_count"]
        table = {c: pa.array([m[c] for m in made], kinds.get(c, pa.string())) for c in columns}
        return pa.table({"document_id": pa.array([document] * len(made), pa.string()), **table})

    return pages.select("document_id", "title", "page_number", "text").groupBy("document_id").applyInArrow(chunk, _CHUNK)


def contextual_text(title: Column, heading: Column, page_start: Column, page_end: Column, text: Column) -> Column:
    """A text below the header line of its document, section and pages, as a Column."""
    line = lambda c, n: F.coalesce(F.nullif(F.left(F.trim(F.regexp_replace(c, SPACE + "+", " ")), F.lit(n)), F.lit("")), F.lit("Unspecified"))
    pages = F.when(page_start == page_end, page_start.cast("string")).otherwise(F.concat_ws("-", page_start, page_end))
    return F.concat(F.lit("[Document: "), line(title, TITLE_MOST), F.lit(" | Section: "), line(heading, SECTION_MOST), F.lit(" | Pages: "), pages, F.lit("]\n"), text)


def deterministic_vector(text: Column, size: int = 64) -> Column:
    """A unit vector made from sha256 of the text and a counter: bytes b become b / 127.5 - 1.

    Lambdas work out anew, for every entry, what they take from outside; so the
    digest, the raw entries and the norm are bound once a row.
    """
    blocks = -(-size // 32)
    digest = F.concat(*(F.sha2(F.concat(text, F.lit(f":{i}")), 256) for i in range(blocks)))
    byte = lambda d, i: F.conv(F.substring(d, 2 * i - 1, F.lit(2)), 16, 10).cast("double")
    norm = lambda raw: F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    made = bound(digest, lambda d: F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: byte(d, i) / 127.5 - 1.0))
    return bound(made, lambda raw: bound(norm(raw), lambda n: F.transform(raw, lambda x: x / n)))
