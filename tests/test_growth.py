"""Queries whose cost grew faster than their input, held to their results and to what they may cost."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import chunking, concepts, graph, layout, retrieval
from tessera.registry import QUERIES


def test_vectors_hash_a_text_once(spark):
    """3000 texts took over a minute when every entry hashed the text anew."""
    texts = spark.range(3000).select("id", F.concat(F.repeat(F.lit("some words "), F.lit(40)), "id").alias("text"))
    started = time.time()
    got = {r.id: r.v for r in texts.select("id", chunking.deterministic_vector(F.col("text")).alias("v")).collect()}
    assert time.time() - started < 30
    raw = b"".join(hashlib.sha256(("some words " * 40 + f"17:{i}").encode()).digest() for i in range(2))
    raw = [b / 127.5 - 1.0 for b in raw]
    norm = math.sqrt(sum(x * x for x in raw))
    assert all(abs(a - b / norm) < 1e-12 for a, b in zip(got[17], raw, strict=True))


def test_tagged_pairs_are_found_in_place_and_once(spark, monkeypatch):
    """Pairs were exploded by tag and term with both concepts beside them and shuffled to be made distinct."""
    monkeypatch.setattr(graph, "BLOCK", 16)
    monkeypatch.setattr(graph, "STRIP", 5)
    draw = random.Random(3)
    rows = [(f"p{i:03}", draw.choice([None, "", "f1", "f2", f"g{i}"]), [draw.randint(1, 9)], draw.sample(["A", "b ", "c", "", "d"], draw.randint(0, 3)), draw.sample(["x", "Y", "z", "u", "v", "w"], draw.randint(0, 4))) for i in range(90)]
    frame = spark.createDataFrame(rows, "path string, source_file string, pages array<int>, tags array<string>, terms array<string>").repartition(3)
    found = graph.discover_relations(frame)
    clean = lambda values: {v.strip().lower() for v in values}
    expected = []
    for a, b in itertools.combinations(rows, 2):
        tags, terms, same = clean(a[3]) & clean(b[3]) - {""}, clean(a[4]) & clean(b[4]), a[1] == b[1]
        close = same and abs(a[2][0] - b[2][0]) <= 3
        signals = [name for name, on in (("shared_source_file", same and a[1]), ("shared_tags", tags), ("title_description_overlap", len(terms) >= 2), ("source_page_proximity", close)) if on]
        if len(signals) >= 2:
            expected.append((a[0], b[0], signals, "supports" if close else "references", sorted(tags), sorted(terms)))
    assert len(expected) > 300
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)
    plan = graph.discover_relations(frame, matched=False)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_path" not in plan and "hashpartitioning(source#" not in plan


@pytest.mark.parametrize("within", [None, "part"])
def test_block_search_equals_the_scan(spark, monkeypatch, within):
    """More queries than a few met all rows one by one; among them are copies, nulls, zeros and vectors of other lengths."""
    draw = random.Random(9)
    vectors = [[draw.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(5)] for _ in range(150)]
    vectors[3:9] = [None, [], [0.0] * 5, [1.0, None, 1.0, 1.0, 1.0], [1.0, 2.0], [2.0, 1.0]]
    rows = [(i, f"p{i % 3}", v) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "key long, part string, v array<float>").repartition(4)
    asked = frame.filter("key % 2 = 0 or key < 9").select(F.col("key").alias("query_id"), F.col("v").alias("q"))
    for name, size in (("ROW_BLOCK", 20), ("QUERY_BLOCK", 15), ("STRIP", 4)):
        monkeypatch.setattr(retrieval, name, size)

    def score(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b or not any(a) or not any(b):
            return None
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        return round(dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))), 6)

    expected = []
    for q in (r for r in rows if r[0] % 2 == 0 or r[0] < 9):
        for part in sorted({r[1] for r in rows}) if within else [None]:
            held = [(score(q[2], v), key) for key, p, v in rows if part in (None, p)]
            best = sorted(held, key=lambda h: (h[0] is None, -(h[0] or 0), h[1]))[:7]
            expected += [(q[0], part, key, s, i + 1) for i, (s, key) in enumerate(best)]
    found = retrieval.vector_search(frame, asked, "query_id", "q", "v", "key", k=7, within=within)
    got = [(r.query_id, r.part if within else None, r.key, r.score, r["rank"]) for r in found.collect()]
    order = lambda r: (r[0], r[1] or "", r[4])
    assert sorted(got, key=order) == sorted(expected, key=order)
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()


def test_concepts_are_scored_once(spark):
    """The words of all concepts were exploded and joined anew for lexical evidence, open questions and near misses."""
    held = spark.createDataFrame([(i, f"pump {i}", "valve" if i % 2 else None, "m", "seal " * 3, "human", i) for i in range(12)], "path long, title string, description string, metadata string, body string, provenance string, content_hash long")
    vectors = held.select("path", "content_hash", F.array(F.lit(1.0), F.col("path").cast("double")).alias("vector"))
    asked = spark.createDataFrame([(1, "pump valve", [1.0, 2.0]), (2, "seal", [1.0, 3.0]), (3, "nothing known", [1.0, 3.0]), (4, "", [1.0, 3.0])], "query_id int, question string, vector array<double>")
    found = concepts.concept_evidence(asked, held, vectors)
    got = [(r.query_id, r.path, r.kind, r.mode) for r in found.orderBy("query_id", "rank").collect()]
    assert got[:4] == [(1, i, "evidence", "lexical") for i in (1, 11, 3, 5)]
    assert {g[0] for g in got} == {1, 2, 3} and {g[3] for g in got if g[0] == 3} == {"vector"}
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_term_search_counts_in_place(spark, monkeypatch):
    """Every chunk that shared a word with a query was a row of a shuffle."""
    draw = random.Random(4)
    chunks = [(i, f"b{i % 3}", draw.sample("abcdefgh", draw.randint(1, 5))) for i in range(120)]
    asked = [(q, draw.sample("abcdefghxyz", 4)) for q in range(30)]
    frame = spark.createDataFrame(chunks, "key long, part string, words array<string>").repartition(3)
    wanted = spark.createDataFrame(asked, "_id long, words array<string>").select("_id", F.explode("words").alias("word"))
    for name, size in (("WORD_BLOCK", 16), ("QUERY_BLOCK", 7), ("STRIP", 3)):
        monkeypatch.setattr(retrieval, name, size)
    found = retrieval.term_search(frame.select("key", "part"), frame.select("key", "part", F.explode("words").alias("word")), wanted, "key", "part", k=4)
    expected = []
    for q, words in asked:
        for part in ("b0", "b1", "b2"):
            hits = sorted((-len(set(words) & set(w)), key) for key, p, w in chunks if p == part and set(words) & set(w))
            expected += [(q, part, key, i + 1) for i, (_, key) in enumerate(hits[:4])]
    assert sorted(tuple(r) for r in found.select("_id", "part", "key", "rank").collect()) == sorted(expected)


def test_items_of_a_page_come_together_once(spark):
    """Items were dealt by height, then by line, then by page; white space is told as before."""
    items = spark.createDataFrame([(1, 0, 0, 5.0, 10.0, "b"), (1, 0, 1, 1.0, 11.0, "a"), (1, 0, 2, 0.0, 30.0, " top- "), (1, 0, 3, None, 1.0, "loose"), (1, 0, 4, 1.0, 28.5, "x"), (1, 0, 5, 2.0, 2.0, " 　")], "document_id long, page int, position int, x double, y double, text string")
    found = layout.page_texts(items.select("document_id", "page").distinct(), items)
    assert [(r.text, r.char_count) for r in found.collect()] == [("top- x\na b\nloose", 16)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    odd = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    space = set(" \t\n\x0b\f\r\xa0     　﻿") | {chr(c) for c in range(0x2000, 0x200B)}
    told = spark.createDataFrame([(c,) for c in odd], "c string").filter(F.col("c").rlike(f"^{text.SPACE}$")).collect()
    assert {r.c for r in told} == space


def test_fitting_breaks_are_found_once(spark, sf_dir):
    """Breaks and headings were found anew for topics that grow and for those that don't."""
    plan = QUERIES["topic_continuations"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "document_id" in plan


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_traversal_gathers_no_edges_of_the_last_hop(spark, monkeypatch, hops):
    """A query gathered the edges of all nodes within its hops, some twenty times those that its walk can follow."""
    draw = random.Random(hops)
    rows = [(draw.randrange(40), i % 5, draw.randrange(60)) for i in range(150)]
    seeds = [(q, p, draw.randrange(40)) for q in range(6) for p in range(3)]
    asked, reach = [], graph.reachable
    monkeypatch.setattr(graph, "reachable", lambda e, s, n, *a: asked.append(n) or reach(e, s, n, *a))
    edges, starts = spark.createDataFrame(rows, "source long, idx int, target long"), spark.createDataFrame(seeds, "query_id long, position int, node long")
    got = sorted(tuple(r) for r in graph.traverse(edges, starts, hops).collect())
    want = []

    def walk(query, node, depth, visited):
        for _, target in sorted((i, t) for s, i, t in rows if s == node):
            if target not in visited:
                visited.add(target)
                want.append((query, target, node, depth + 1))
                if depth + 1 < hops:
                    walk(query, target, depth + 1, visited)

    for query in range(6):
        visited: set[int] = set()
        for _, node in sorted((p, n) for q, p, n in seeds if q == query):
            if node not in visited:
                visited.add(node)
                walk(query, node, 0, visited)
    assert got == sorted(want) and max(asked) == hops - 1


def test_a_way_is_asked_once_for_all_targets_that_enter_it(spark, monkeypatch):
    """All that a target reaches was listed for every target (here 40 x 6 nodes), whatever source it was asked for."""
    held, keep = {}, graph.written
    monkeypatch.setattr(graph, "written", lambda df, label: held.setdefault(label, []).append(keep(df, label)) or held[label][-1])
    chain = [(f"m{i}", "depends_on", f"m{i + 1}") for i in range(6)] + [("s", "depends_on", "m0"), ("m6", "depends_on", "end")]
    edges = chain + [(f"t{i:02}", "depends_on", "m0") for i in range(40)]
    asked = [("end", "depends_on", f"t{i:02}") for i in range(40)] + [("m3", "depends_on", "t00"), ("t01", "depends_on", "t00"), ("m0", "depends_on", "m4"), ("m6", "depends_on", "m2"), ("x", "depends_on", "x")]
    names = "source string, relation string, target string"
    got = {(r.source, r.target) for r in graph.leads_back(spark.createDataFrame(asked, names), spark.createDataFrame(edges, names)).collect()}
    assert got == {("end", f"t{i:02}") for i in range(40)} | {("m3", "t00"), ("m6", "m2"), ("x", "x")}
    assert held["begun"][0].count() <= len(asked)


def test_like_concepts_pair_as_lists(spark):
    """A concept was compared with all others of its tag and left with every one of them as a row of its own."""
    same = spark.range(12000).select(
        F.col("id").alias("path"), F.concat(F.lit("f"), "id").alias("source_file"), F.array(F.lit(1)).alias("pages"), F.array(F.lit("t")).alias("tags"),
        F.array(F.lit("seal"), F.concat(F.lit("a"), F.col("id") % 2), F.concat(F.lit("b"), F.col("id") % 2)).alias("terms"),
    )
    found = graph.discover_relations(same, matched=False)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(others" in plan and "REPARTITION" in found._jdf.queryExecution().executedPlan().toString()
    got = found.agg(F.count("*"), F.sum(((F.col("source") < F.col("target")) & ((F.col("target") - F.col("source")) % 2 == 0)).cast("int"))).first()
    assert tuple(got) == (2 * 6000 * 5999 // 2,) * 2


@pytest.mark.parametrize("rare, space", [(1, 1 << 20), (4, 1 << 20), (10, 300), (1000, 1 << 20), (1000, 0)])
@pytest.mark.parametrize("same", [True, False])
def test_blocks_pair_as_all_pairs_do(monkeypatch, rare, space, same):
    """Holders of a term as bitmaps, as lists and as both; two blocks of a tag or one; lists cut at their bound."""
    for name, value in (("RARE", rare), ("MAP_BYTES", space), ("MOST_HOLDERS", 40), ("STRIP", 7), ("MOST_LISTED", 3), ("MOST_ROWS", 50)):
        monkeypatch.setattr(graph, name, value)
    draw = random.Random(rare + same)
    words = [f"w{min(draw.randrange(30), draw.randrange(30))}" for _ in range(400)] + [None, *(f"x{i}" for i in range(40))]
    rows = [(0 if same else draw.randrange(2), draw.randrange(150), draw.choice([None, "", "f", *map(str, range(30))]), draw.sample("abcd", draw.choice([0, 0, 1, 2])), list(set(draw.choices(words, k=draw.choice([0, 1, 3, 9]))))) for _ in range(170)]
    names = ("own", "path", "file", "earlier", "terms")
    kinds = (pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
    table = pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(zip(names, kinds, strict=True))})
    table = table.append_column("low", pa.array([0] * len(rows), pa.int32())).append_column("high", pa.array([int(not same)] * len(rows), pa.int32()))
    expected = []
    for a, b in itertools.combinations(rows, 2):
        fits = len(set(a[4]) & set(b[4]) - {None}) > 1 and not set(a[3]) & set(b[3]) and a[2] != b[2] and a[1] != b[1]
        if fits and (same or a[0] != b[0]):
            expected.append((min(a[1], b[1]), max(a[1], b[1])))
    got = []
    for paths, leads, lists in graph._pairs_across(table):
        for path, lead, others in zip(paths.to_pylist(), leads.to_pylist(), lists.to_pylist(), strict=True):
            assert 0 < len(others) <= 3
            got += [(path, other) if lead else (other, path) for other in others]
    assert len(expected) > 200 and sorted(got) == sorted(expected)
