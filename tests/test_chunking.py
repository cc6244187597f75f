"""Chunking: the reference cases, the size limits and what no chunk may lose."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators.chunking import ChunkSizes, chunk_documents, chunk_pages, header_of, tail_of, tokens, Unit

SMALL = ChunkSizes(80, 50, 10)


def test_pages_are_covered():
    made = chunk_pages("d", "Manual", [(1, "ATA 24 ELECTRICAL POWER\nGenerator control unit overview."), (2, "Generator control unit fault isolation procedure.")])
    assert made[0]["source_pages"] == [1, 2] and (made[0]["page_start"], made[0]["page_end"]) == (1, 2)


def test_sizes_hold():
    made = chunk_pages("d", "t", [(n, f"SECTION {n}\n" + "retrieval text " * 60) for n in range(1, 9)], sizes=ChunkSizes(120, 90, 10))
    assert len(made) > 1 and all(m["token_count"] <= 120 for m in made)


def test_identity_depends_on_version():
    pages = [(1, "one two three")]
    a, b, c = chunk_pages("d", "t", pages), chunk_pages("d", "t", pages), chunk_pages("d", "t", pages, version=2)
    assert a == b and a[0]["content_hash"] == c[0]["content_hash"] and a[0]["id"] != c[0]["id"]


def test_repeated_content_takes_no_ordinal():
    made = chunk_pages("d", "t", [(1, "\n\n".join(["alpha " * 60] * 3))], sizes=ChunkSizes(100, 90, 0))
    assert [m["ordinal"] for m in made] == list(range(len(made))) and len({m["content_hash"] for m in made}) == len(made)


def test_ceil_is_double_arithmetic():
    assert tokens(180) == 244 and tokens(0) == 1


def test_tail_is_never_everything():
    units = [Unit(1, "a b", 2), Unit(1, "c d", 2)]
    assert tail_of(units, 100) == [] and tail_of(units, 3) == [units[1]] and tail_of(units, 0) == []


def test_header_is_one_line():
    assert header_of(" A  manual ", [Unit(3, "Head\nbody", 2), Unit(5, "x", 1)]) == "[Document: A manual | Section: Head | Pages: 3-5]\n"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["alpha", "beta.", "gamma", "\n\n", "delta!", "\n"]), max_size=120), min_size=1, max_size=5))
def test_no_word_is_lost_and_no_chunk_is_too_long(pages):
    held = [(n + 1, " ".join(words)) for n, words in enumerate(pages)]
    made = chunk_pages("d", "t", held, sizes=SMALL)
    assert all(m["token_count"] <= SMALL.most for m in made)
    kept = set(" ".join(m["text"] for m in made).split())
    assert kept == set(" ".join(t for _, t in held).split())


def test_distributed_chunks_equal_local_ones(spark):
    pages = [("a", "A", 1, "x y z\n\nw"), ("a", "A", 2, "more words here"), ("b", None, 1, ""), ("c", None, 1, None), ("d", "D", 7, "tail")]
    got = chunk_documents(spark.createDataFrame(pages, "document_id string, title string, page_number int, text string")).collect()
    want = [m["id"] for d in "abcd" for m in chunk_pages(d, next(p[1] for p in pages if p[0] == d), [(p[2], p[3]) for p in pages if p[0] == d])]
    assert sorted(r.id for r in got) == sorted(want)
