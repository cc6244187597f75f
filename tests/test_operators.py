"""Operators against small cases with known results."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import continuation, graph, lifecycle, retrieval, routing, topics
from tessera.sources import bundles


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_text_functions(spark):
    one = spark.range(1)
    row = one.select(
        tx.keyword_terms(F.lit("What is the Generator-control unit, the unit?")).alias("terms"), tx.query_tokens(F.lit("check the é system of pumps of x")).alias("q"),
        tx.excerpt(F.lit("a  b\tc" * 60), 20).alias("cut"), tx.slug(F.lit("  Fuel & Oil!"), 64).alias("slug"), tx.heuristic_tokens(F.lit(None).cast("string")).alias("none"),
        tx.safe_path(F.lit("a/./b/../c.md")).alias("p1"), tx.safe_path(F.lit("../x.md")).alias("p2"), tx.safe_path(F.lit("/x.md")).alias("p3"),
        tx.holds_phrase(F.array(F.lit("a"), F.lit("bc")), F.array(F.lit("b"))).alias("part"),
    ).first()
    assert row.terms == ["generator", "control", "unit"] and row.q == ["pumps"]
    assert len(row.cut) <= 20 and row.cut.endswith("...") and row.slug == "fuel-oil" and row.none == 1
    assert (row.p1, row.p2, row.p3, row.part) == ("a/c.md", None, None, False)


def test_fusion_prefers_what_both_lists_have(spark):
    lists = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "b"), (1, 2, "c")], "list int, rank int, id string")
    assert [r.id for r in retrieval.fuse(lists, "id").orderBy(F.col("rrf").desc(), "id").collect()] == ["b", "a", "c"]


def test_rerank_needs_complete_scores(spark):
    results = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("p", "a", 1), ("p", "b", 2)], "query_id string, id string, rank int")
    scores = spark.createDataFrame([("q", "a", 2), ("q", "b", 3), ("q", "c", 0), ("p", "a", 1), ("p", "x", 3)], "query_id string, id string, relevance int")
    got = {(r.query_id, r.new_rank): r.id for r in retrieval.rerank(results, scores, "id").collect()}
    assert got == {("q", 1): "b", ("q", 2): "a", ("p", 1): "a", ("p", 2): "b"}


def test_keyword_search_of_stopwords_is_empty(spark):
    docs = spark.createDataFrame([(1, "the thing")], "doc_id long, text string")
    assert retrieval.keyword_search(docs, "what is the", ["doc_id"]).count() == 0


def test_sections_and_fallback(spark):
    pages = [
        (1, 1, "ATA 24 ELECTRICAL POWER\nbody of text that is long enough to be a sentence."), (1, 2, "Only a sentence, and a long one, that ends with a stop."),
        (1, 3, "SECTION 2 FAULT ISOLATION\nmore text."), (2, 1, "SOLE HEADING\n"),
    ]
    got = values(topics.heading_sections(spark.createDataFrame(pages, "document_id long, page long, text string")).select("document_id", "page_start", "page_end", "confidence", "topic_type"))
    assert got == [(1, 1, 2, "high", "manual_section"), (1, 3, 3, "high", "fault_isolation"), (2, 1, 1, "low", "coarse_range")]


def test_page_windows_overlap_by_one(spark):
    pages = spark.createDataFrame([(1, p, 10) for p in range(1, 6)], "document_id long, page long, tokens long")
    got = [r.pages for r in topics.page_windows(pages, most_tokens=30).orderBy("window").collect()]
    assert got == [[1, 2, 3], [3, 4, 5]]


def test_preflight_codes(spark):
    files = spark.createDataFrame([(f"{k}.md", k.upper()) for k in "abcdefg"], "path string, type string")
    edges = [("a", "supports", "b"), ("b", "conflicts_with", "a"), ("b", "depends_on", "c"), ("c", "depends_on", "d"), ("d", "depends_on", "e"), ("e", "supersedes", "f"), ("b", "covered_by", "a")]
    held = spark.createDataFrame([(f"{a}.md", r, f"{b}.md") for a, r, b in edges], "source string, relation string, target string")
    asked = [
        ("a.md", "supports", "b.md", "B", "r"), ("a.md", "conflicts_with", "b.md", "B", None), ("b.md", "supports", "a.md", "A", "r"), ("e.md", "depends_on", "b.md", None, "r"),
        ("e.md", "depends_on", "a.md", "", "r"), (" a.md", "routes_to", "a.md", "A", "r"), ("a.md", "supersedes", "f.md", "F", "r"), ("e.md", "supersedes", "f.md", "F", " "),
        ("a.md", "invented", "../x.md", "A", "r"), ("a.md", "references", "c.md", "X", "r"), ("a.md", "covered_by", "b.md", "B", "r"), ("x.md", "references", "c.md", "C", "r"),
    ]
    got = graph.preflight(spark.createDataFrame(asked, "source string, relation string, target string, target_type string, reason string"), held, files).collect()
    found = {(r.source, r.relation, r.target): (r.issues, r.warned, r.accepted) for r in got}
    assert len(got) == len(asked) and found == {
        ("a.md", "supports", "b.md"): (["relation_exact_duplicate"], False, False),
        ("a.md", "conflicts_with", "b.md"): (["relation_reverse_duplicate"], False, False),
        ("b.md", "supports", "a.md"): ([], True, True),
        ("e.md", "depends_on", "b.md"): (["relation_cycle_detected"], False, False),
        ("e.md", "depends_on", "a.md"): ([], False, True),
        ("a.md", "routes_to", "a.md"): (["relation_self_link", "relation_cycle_detected"], False, False),
        ("a.md", "supersedes", "f.md"): (["relation_competing_supersedes"], False, False),
        ("e.md", "supersedes", "f.md"): (["relation_reason_required", "relation_exact_duplicate"], False, False),
        ("a.md", "invented", "../x.md"): (["relation_type_not_allowed", "relation_target_invalid", "relation_target_missing"], False, False),
        ("a.md", "references", "c.md"): (["relation_target_type_mismatch"], False, False),
        ("a.md", "covered_by", "b.md"): (["relation_reverse_direction_conflict"], False, False),
        ("x.md", "references", "c.md"): (["relation_source_missing"], False, False),
    }


def test_cycles_of_any_length(spark):
    ring = [(k, "depends_on", (k + 1) % 9) for k in range(9)] + [(20, "depends_on", 3), (4, "depends_on", 30), (40, "depends_on", 40), (0, "supports", 1)]
    edges = spark.createDataFrame([(str(a), r, str(b)) for a, r, b in ring], "source string, relation string, target string")
    got = {(r.source, r.target) for r in graph.leads_back(edges, edges).collect()}
    assert got == {(str(k), str((k + 1) % 9)) for k in range(9)} | {("40", "40")}
    assert graph.leads_back(edges.limit(0), edges).count() == 0


def test_normal_forms(spark):
    row = spark.range(1).select(tx.slug(F.lit("Caf\u00e9 \u00c9a"), 64).alias("slug"), tx.normalized(F.lit("\ufb01x \u00b2"), "NFKC").alias("wide"), tx.normalized(F.lit(None).cast("string"), "NFKC").alias("none")).first()
    assert row.slug == "cafe-e-a" and row.wide == "fix 2" and row.none is None


def test_traversal_is_depth_first(spark):
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 3), (1, 0, 2), (2, 0, 3), (3, 0, 4)], "source long, idx int, target long")
    seeds = spark.createDataFrame([(7, 0, 0)], "query_id long, position int, node long")
    assert [r.node for r in graph.traverse(edges, seeds, 3).orderBy("node").collect()] == [1, 2, 3]
    cycle = spark.createDataFrame([(0, 0, 1), (1, 0, 0)], "source long, idx int, target long")
    assert [r.node for r in graph.traverse(cycle, seeds, 3).collect()] == [1]
    assert graph.traverse(edges, seeds, 0).count() == 0


def test_discovery_signals(spark):
    concepts = [
        ("brakes.md", "manual", [10], ["Safety"], ["inspection", "brake"]), ("prestart.md", "manual", [12], ["safety"], ["inspection", "start"]),
        ("other.md", "else", [40], ["x"], ["wing"]),
    ]
    got = graph.discover_relations(spark.createDataFrame(concepts, "path string, source_file string, pages array<int>, tags array<string>, terms array<string>")).collect()
    assert [(r.source, r.target, r.relation, r.signals) for r in got] == [("brakes.md", "prestart.md", "supports", ["shared_source_file", "shared_tags", "source_page_proximity"])]


def test_routes(spark):
    cases = {
        "What is the approved Thermal Regulation Protocol?": ("okf_only", False), "Search every document for calibration drift examples.": ("rag_only", False),
        "How does the approved Thermal Regulation Protocol affect the downstream subsystem?": ("okf_only", True), "Should I delete production data?": ("missing_context", False),
        "What is the live weather right now?": ("unsupported", False), "éa search é": ("rag_only", False), "research": ("missing_context", False),
    }
    rows = routing.route_questions(spark.createDataFrame([(q,) for q in cases], "question string")).collect()
    assert {r.question: (r.route, r.needs_graph) for r in rows} == cases


def test_entities_and_markers(spark):
    row = spark.range(1).select(
        routing.protected_entities(F.lit('Compare "alpha beta" with v1.2.3 and ISO 9001 of 2024-05-06')).alias("e"), routing.citation_markers(F.lit("x [1] y [12] [z]")).alias("m")
    ).first()
    assert row.e[:3] == ["alpha beta", "2024-05-06", "v1.2.3"] and "ISO 9001" in row.e and row.m == [1, 12]


def test_lifecycle_defaults(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    marks = spark.createDataFrame([(1, "retracted"), (2, "no such")], "id long, status string")
    assert values(lifecycle.only_active(rows, marks, ["id"])) == [(2,), (3,)]


def test_bundle_round_trip(spark, tmp_path):
    root = tmp_path / "bundle"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "a.md").write_text(
        '---\ntype: procedure\ntitle: "A title"\nreview_status: approved\nsource_file: m.pdf\nsource_pages:\n  - 3\n  - x\ntags:\n  - one\nrelations:\n'
        "  - relation: supports\n    target: ../b.md\n    target_type: procedure\n    reason: because\n---\n\n# A title\n\nBody.\n"
    )
    (root / "b.md").write_text("no frontmatter")
    parsed = bundles.parse_bundle(bundles.scan_bundle(spark, str(root)))
    concepts = {r.path: r for r in bundles.concept_columns(parsed).collect()}
    assert concepts["sub/a.md"].page_numbers == [3] and concepts["sub/a.md"].source_pages == ["3", "x"] and concepts["sub/a.md"].tags == ["one"] and concepts["b.md"].type is None
    assert values(bundles.edges_of(parsed).select("source", "target")) == [("sub/a.md", "b.md")]
    checked = {r.path: (r.errors, r.agent_ready, r.trust) for r in bundles.validation_errors(bundles.concept_columns(parsed)).collect()}
    assert checked == {"sub/a.md": ([], False, "missing_trust_metadata"), "b.md": (["generic_okf_type_required"], False, "invalid_generic")}


def test_partition_replacement(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    bundles.replace_partition(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    bundles.replace_partition(spark.createDataFrame([(2, "c")], "k int, v string"), path, "k")
    assert values(spark.read.parquet(path).select("k", "v")) == [(1, "a"), (2, "c")]


def test_continuations(spark):
    pages = spark.createDataFrame([
        (1, 129, "text"), (1, 130, "SMOKE FIRE FUMES\ntext\nContinued on next page"), (1, 131, "SMOKE FIRE FUMES (CONTINUED)\ntext\ncontinued overleaf"),
        (1, 132, "cont'd\ntext"), (1, 140, "Continued on next page"), (1, 142, "continued"),
    ], "document_id long, page long, text string")
    topics_ = spark.createDataFrame([(1, 1, "Smoke Fire Fumes", ["SMOKE FIRE FUMES"], [130]), (1, 2, "Other", ["OTHER"], [133])], "document_id long, topic_id long, title string, headings array<string>, pages array<long>")
    got = {r.topic_id: (r.pages, r.added, r.ambiguous) for r in continuation.resolve_continuations(pages, topics_).collect()}
    assert got == {1: ([130, 131, 132], [131, 132], []), 2: ([133], [], [])}
    two = spark.createDataFrame([(1, 1, "a", [], [140]), (1, 2, "b", None, [140])], topics_.schema)
    plain = spark.createDataFrame([(1, 140, "Continued on next page"), (1, 141, "continued")], pages.schema)
    assert values(continuation.resolve_continuations(plain, two).select("topic_id", "added", "ambiguous")) == [(1, [], [140]), (2, [], [140])]


def swept(pages, fits):
    """Sweeps over all breaks until one changes nothing."""
    pages, before = [set(p) for p in pages], None
    breaks = sorted(set().union(*fits)) if fits else []
    several = [set() for _ in pages]
    while before != pages:
        before = [set(p) for p in pages]
        for b in breaks:
            here = [t for t, p in enumerate(pages) if b in fits[t] and (max(p) == b or min(p) == b + 1 or {b, b + 1} <= p)]
            for t in here if len(here) > 1 else ():
                several[t].add(b)
            if len(here) == 1:
                pages[here[0]] |= {b, b + 1}
    return pages, several


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 12), min_size=1, max_size=3), st.sets(st.integers(0, 12))), max_size=5))
def test_growth_equals_sweeps(topics_):
    pages, fits = [p for p, _ in topics_], [f for _, f in topics_]
    assert continuation.grown(pages, fits) == swept(pages, fits)


def test_labels_that_fit(spark):
    cases = [
        (["engine", "fire"], ["engine", "fire", "drill"], True), (["engine"], ["engine", "fire"], False), (["engine"], ["engine"], True), ([], ["engine"], False),
        (["fire", "drill"], ["engine", "fire"], False), (["a1", "b"], ["a1", "b"], True), (["ab", "c"], ["xab", "c"], False),
    ]
    rows = spark.createDataFrame([(a, b) for a, b, _ in cases], "a array<string>, b array<string>")
    assert [r.x for r in rows.select(continuation.related(F.col("a"), F.col("b")).alias("x")).collect()] == [x for *_, x in cases]


def test_article_texts(spark):
    from tessera.operators import articles

    rows = [
        ("# My  A\n", "My A"), ("\n# A.b\n\n# a.B\ntext\n## Source\nx", "A.b"), ("## Source\nonly", "t"), ("text\n## Source\nx\n## Notes\ny", "t"), ("# A\\E(x\nbody", "A\\E(x"), (None, "t"), ("", ""),
    ]
    made = spark.createDataFrame(rows, "body string, title string").select(articles.article_body(F.col("body"), F.col("title")).alias("body"))
    assert [r.body for r in made.collect()] == ["# My  A", "text", "", "text\n## Source\nx\n## Notes\ny", "body", None, ""]
    excerpt = articles.citation_excerpt(F.lit("## Pump (1) ### Use it\nwell ﬁne ## Source file.pdf p. 3"), F.lit("Pump (1)"))
    assert spark.range(1).select(excerpt.alias("x")).first().x == "Use it well fine"
