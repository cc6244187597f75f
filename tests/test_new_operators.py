"""Operators against plain readings of their rules: verification, layout, lint, deletion, acceptance, cycles, stages."""

from __future__ import annotations

import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import acceptance, answers, deletion, graph, layout, lifecycle, lint, promotion, review, routed, topics, verification
from tessera.sources import bundles, plain_yaml


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- verification ------------------------------------------------------------

EVENTS = "candidate_id long, seq long, event string, message string, attempt int"


def folded(rows):
    """One event after the other, in a loop."""
    out, state = [], {}
    for c, seq, event, message, attempt in sorted(rows, key=lambda r: (r[0], r[1])):
        at = state.get(c, "queued")
        new = None
        if at != "closed":
            if event == "retry":
                new = "queued"
            elif event == "close":
                new = "closed"
            elif event == "start" and at in ("queued", "running"):
                new = "running"
            elif event == "reconcile" and at in ("queued", "running"):
                new = "queued"
            elif at == "running":
                if event == "confirm":
                    new = "confirmed"
                elif event == "filter" or (event == "error" and message in verification.FILTER_ERRORS):
                    new = "filtered"
                elif event == "error":
                    new = "failed" if message == verification.KEY_ERROR or (attempt or 1) >= 3 else "queued"
        out.append((c, seq, event, message, at, new or at, new is None))
        state[c] = new or at
    return sorted(out, key=repr)


def some_events(rng, n, candidates, gap):
    kinds = ["start", "start", "start", "confirm", "filter", "error", "error", "retry", "reconcile", "odd", None]
    rows = []
    for c in range(candidates):
        seq = 0
        for _ in range(n if c == 0 else rng.randint(0, 20)):  # the first candidate is hot
            seq += rng.randint(1, gap)
            event = rng.choice(kinds) if rng.random() < 0.995 else "close"
            message = rng.choice([*verification.FILTER_ERRORS, verification.KEY_ERROR, "timeout", "timeout"]) if event == "error" else None
            rows.append((c, seq, event, message, rng.choice([None, 1, 2, 3])))
    return rows


@pytest.mark.parametrize("gap", [1, 400])
def test_transitions_equal_a_fold(spark, gap):
    rows = some_events(random.Random(gap), 3000, 12, gap)
    moved = verification.transitions(spark.createDataFrame(rows, EVENTS).repartition(7))
    assert values(moved) == folded(rows)
    last = {}
    for c, seq, event, message, _, after, refused in sorted(folded(rows), key=lambda r: (r[0], r[1])):
        state, error, n, bad = last.get(c, ("queued", None, 0, 0))
        if refused:
            last[c] = (after, error, n, bad + 1)
        else:
            last[c] = (after, message if event == "error" else None, n + (event in ("confirm", "filter", "error")), bad)
    assert values(verification.final_states(moved)) == sorted([(c, *v) for c, v in last.items()], key=repr)


def test_a_stream_moves_like_the_batch(spark, tmp_path):
    rows = some_events(random.Random(3), 60, 8, 2)
    cut = sorted(r[1] for r in rows)[len(rows) // 2]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    frame = spark.createDataFrame(rows, EVENTS).coalesce(1)
    for part in (frame.filter(F.col("seq") <= cut), frame.filter(F.col("seq") > cut)):
        part.write.mode("append").parquet(source)
        stream = verification.stream_transitions(spark.readStream.schema(frame.schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert values(spark.read.parquet(out)) == folded(rows)


def test_no_events(spark):
    assert verification.transitions(spark.createDataFrame([], EVENTS)).count() == 0


# --- layout ------------------------------------------------------------------


def laid_out(items):
    """Items one by one: each joins the first line that is near, or opens one."""
    lines, loose = [], []
    for x, y, text in items:
        text = " ".join((text or "").split())
        if not text:
            continue
        if x is None or y is None:
            loose.append(text)
            continue
        line = next((line for line in lines if abs(line[0] - y) <= 2), None)
        if line is None:
            line = (y, [])
            lines.append(line)
        line[1].append((x, text))
    rows = [" ".join(t for _, t in sorted(parts, key=lambda p: p[0])) for _, parts in sorted(lines, key=lambda line: -line[0])]
    whole = "\n".join([*rows, *loose])
    for c in "abcdefghijklmnopqrstuvwxyz":
        whole = whole.replace("-\n" + c, c)
    return whole.strip()


def test_page_texts_equal_item_by_item(spark):
    rng = random.Random(2)
    pages = []
    for p in range(60):
        n = rng.choice([0, 1, 5, 40])
        pages.append([(rng.choice([None, 0, 1, 1, 2.5]), rng.choice([None, *[rng.choice([0, 1, 1.5, 2, 3, 4.1, 6, 100])] * 9]), rng.choice(["a", "b-", "Cd", " x  y", "", None, "-"])) for _ in range(n)])
    rows = [(p // 7, p, i, *item) for p, items in enumerate(pages) for i, item in enumerate(items)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r[:3], None if r[3] is None else float(r[3]), None if r[4] is None else float(r[4]), r[5]) for r in rows], "document_id long, page long, position long, x double, y double, text string")
    listed = spark.createDataFrame([(p // 7, p) for p in range(60)], "document_id long, page long")
    got = {r.page: (r.text, r.char_count) for r in layout.page_texts(listed, frame).collect()}
    assert got == {p: (laid_out(items), len(laid_out(items))) for p, items in enumerate(pages)}


# --- boundary lines ----------------------------------------------------------


def test_boundary_lines_go_by_their_place(spark):
    def page(i):
        return f"  Top   LINE \n\nbody {i}\ntop line\nmore\nmiddle {i}\n end\nPage foot"

    texts = [page(i) for i in range(5)] + ["Top line\nPAGE FOOT", "lone\ntop line"]
    pages = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "document_id long, page long, text string")
    got = {r.page: r.text for r in topics.without_boundaries(pages).collect()}
    want = {i: f"body {i}\ntop line\nmore\nmiddle {i}" for i in range(5)} | {6: "lone"}
    assert got == want


# --- lint --------------------------------------------------------------------

MANIFEST = "okf_version: '0.1'\nbase:\n  roots:\n    - path: knowledge\nrelations:\n  allowed:\n    - routes_to\n"
SOURCE = "---\ntype: fault_route\nrelations:\n  - relation: {}\n    target: ../manuals/mel/elt.md\n    target_type: dispatch_reference\n---\n# ELT\n"


def linted(spark, manifest, files):
    rows = [("b", p, t) for p, t in files.items()]
    frame = spark.createDataFrame(rows, "bundle_id string, path string, markdown string")
    found = lint.relation_lint(spark.createDataFrame([("b", manifest)], "bundle_id string, manifest string"), frame)
    return values(found.select("file", "relation_index", "rule"))


def test_lint_cases(spark):
    target = {"knowledge/manuals/mel/elt.md": "---\ntype: dispatch_reference\n---\n# MEL\n"}
    source = "knowledge/faults/elt.md"
    assert linted(spark, MANIFEST, {source: SOURCE.format("routes_to"), **target}) == []
    assert linted(spark, MANIFEST, {source: SOURCE.format("maybe_routes_to"), **target}) == [(source, 0, "invalid_relation")]
    other = {"knowledge/manuals/mel/elt.md": "---\ntype: training_reference\n---\n# T\n"}
    assert linted(spark, MANIFEST, {source: SOURCE.format("routes_to"), **other}) == [(source, 0, "target_type_mismatch")]
    mapping = "---\ntype: a\nrelations:\n  relation: routes_to\n  target: a.md\n---\n"
    assert linted(spark, MANIFEST, {source: mapping}) == [(source, None, "relations_not_list")]
    empty = MANIFEST.replace("\n    - routes_to", " []")
    assert linted(spark, empty, {"knowledge/index.md": "# Index\n"}) == [(None, None, "missing_allowed_relations")]
    twice = MANIFEST.replace("    - path: knowledge\n", "    - path: knowledge\n    - path: knowledge/faults\n")
    assert linted(spark, twice, {source: SOURCE.format("odd"), **target}) == [(source, 0, "invalid_relation")] * 2


def test_plain_yaml():
    assert plain_yaml.load("a:\n  - b: 1\n    c:\n      - x\n      - y: 'q: r'\n  - z # said\nd: [1, two, true]\ne:\nf: {}\n") == {"a": [{"b": 1.0, "c": ["x", {"y": "q: r"}]}, "z"], "d": [1.0, "two", True], "e": None, "f": {}}
    assert plain_yaml.load("") is None and plain_yaml.frontmatter("---\n- a\n---\n") == {} and plain_yaml.frontmatter(None) == {}


# --- lifecycle, notices, deletion ---------------------------------------------


def test_only_active_concepts_stay(spark):
    states = ["active", "archived", "deleting", "deleted", "retracted", "superseded", "Retracted", None]
    rows = spark.createDataFrame([(i,) for i in range(9)], "k int")
    marks = spark.createDataFrame(list(enumerate(states)), "k int, status string")
    assert values(lifecycle.only_active(rows, marks, ["k"])) == [(0,), (5,), (6,), (7,), (8,)]


def test_notices_by_precedence(spark):
    cited = [("rag", 1, None, None), ("rag", 2, None, None), ("rag", None, None, None), ("okf", None, None, "p"), ("okf", None, "b", None), ("okf", None, "b", "gone"), *(("okf", None, "b", s) for s in lifecycle.LIFECYCLE)]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cited)], "n int, source_type string, document_id long, bundle_id string, path string")
    states = spark.createDataFrame([("b", s, s) for s in lifecycle.LIFECYCLE], "bundle_id string, path string, status string")
    documents = spark.createDataFrame([(1, None), (2, datetime.date(2024, 1, 1))], "document_id long, deleted_at date")
    files = states.filter("status <> 'retracted'").select("bundle_id", "path")
    got = [r.notice and r.notice.split()[3] for r in answers.citation_notices(frame, states, documents, files).orderBy("n").collect()]
    assert got == [None, "no", None, "no", "no", "no", None, "now", None, "no", "retracted"]


def test_paths_from_their_folder(spark):
    cases = [("a/b.md", "c.md", "a/c.md"), ("a/b.md", "../c.md", "c.md"), ("b.md", "./x/./c.md", "x/c.md"), ("b.md", "../../c.md", "../../c.md"), ("a\\b.md", "d/../c.md", "c.md")]
    rows = spark.createDataFrame(cases, "source string, target string, want string")
    assert all(r.got == r.want for r in rows.withColumn("got", deletion.resolved_target(F.col("source"), F.col("target"))).collect())


def test_summaries_read_whole_pages(spark):
    pages = spark.createDataFrame([(1, 1, " " * 5000 + "Hydraulic pump"), (1, 2, "short" + " " * 720 + "a" * 400), (1, 3, "  "), (1, 4, "b" * 180 + " c")], "document_id long, page long, text string")
    rows = spark.createDataFrame([(i, 1, p) for i, p in enumerate([[1], [2], [3], [], [4], [9]])], "topic_id long, document_id long, pages array<long>")
    got = [r.summary for r in review.topic_summaries(rows, pages).orderBy("topic_id").collect()]
    assert got == ["Hydraulic pump", "short " + "a" * 171 + "...", review.NO_TEXT, review.NO_TEXT, "b" * 177 + "...", review.NO_TEXT]


# --- acceptance and promotion --------------------------------------------------


def test_retry_cases(spark):
    base = {"question": "official GEN OFF BUS procedure", "route": "okf_only", "needs_graph": False, "sufficiency": "weak", "enabled": ["kb_1"], "call": None, "reason": "why"}
    cases = [
        ({"retry": "official GEN OFF BUS procedure operational guidance"}, "applied"), ({"retry": "latest live weather status"}, "rejected_route_change"),
        ({"retry": "official electrical procedure guidance"}, "rejected_identifier_loss"), ({"retry": "", "reason": ""}, "malformed_response"), ({"retry": "x", "enabled": []}, "disabled"),
        ({"retry": "x", "sufficiency": "strong"}, "not_eligible"), ({"retry": None, "call": "missing_key"}, "missing_key"), ({"retry": "Official  GEN off BUS procedure"}, "rejected_equivalent_query"),
        ({"retry": "official GEN OFF BUS procedure workspace: kb_2"}, "rejected_scope_change"),
    ]
    rows = [{"query_id": i, **base, **c} for i, (c, _) in enumerate(cases)]
    schema = "query_id long, question string, route string, needs_graph boolean, sufficiency string, enabled array<string>, call string, retry string, reason string"
    got = acceptance.retry_outcomes(spark.createDataFrame(rows, schema)).orderBy("query_id").collect()
    assert [r.outcome for r in got] == [o for _, o in cases]
    assert [r.query for r in got] == [cases[0][0]["retry"], *[None] * 8]


def test_two_suggestions_of_one_edge_do_not_stand_against_each_other(spark):
    held = spark.createDataFrame(
        [(1, "topic:a", "topic:b", "supersedes", "r1", "q", None, ["s"]), (2, "topic:a", "topic:b", "supersedes", "r2", "q", None, None), (3, "topic:c", "topic:b", "supersedes", "r3", "q", None, []), (4, "topic:a", "topic:", "supports", "r", "q", None, []), (5, "topic:a", "topic:b", "supports", None, "q", None, [])],
        "position long, source string, target string, relation string, reason string, evidence_quote string, rationale string, signals array<string>",
    )
    paths = spark.createDataFrame([("a", "approved", "a.md"), ("b", "approved", "b.md"), ("c", "approved", "c.md")], "topic_id string, review_status string, exported_path string")
    none = spark.createDataFrame([], "source string, target string, relation string, status string, verification string, reason string, signals array<string>")
    files = spark.createDataFrame([("a.md", "t"), ("b.md", "t"), ("c.md", "t")], "path string, type string")
    outcomes, after = promotion.promoted(held, paths, none, none.select("source", "target", "relation"), files)
    assert values(outcomes) == [(1, "created"), (2, "created"), (3, "created"), (4, "unresolved")]
    assert values(after.select("source", "reason")) == [("a.md", "r2"), ("c.md", "r3")]


# --- cycles ------------------------------------------------------------------


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=22), st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=12))
def test_what_leads_back_equals_a_closure(spark, edges, asked):
    reach = {(a, b) for a, b in edges}
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in edges if b == c}
        if more == reach:
            break
        reach = more
    frame = lambda rows: spark.createDataFrame([(a, "depends_on", b) for a, b in rows], "source long, relation string, target long")
    want = sorted({(a, "depends_on", b) for a, b in asked if a == b or (b, a) in reach})
    assert values(graph.leads_back(frame(asked), frame(edges))) == want


# --- retrieval ---------------------------------------------------------------


def test_raw_evidence_is_fetched_only_where_it_is_due(spark):
    one = lambda *names: [(n, i + 1) for i, n in enumerate(names)]
    questions = spark.createDataFrame(
        [(1, "okf_only", False, False, one("a", "b")), (2, "okf_only", False, False, one("a", "b")), (3, "okf_only", True, False, one("a")), (4, "okf_only", False, False, one("a", "b")), (5, "unsupported", False, False, one("a")), (6, "okf_only", False, True, one("a"))],
        "query_id long, route string, needs_graph boolean, clarified boolean, bundles array<struct<bundle_id:string,rank:int>>",
    )
    approved = spark.createDataFrame([(1, "b", "p", 1, "human"), (3, "a", "p", 1, None)], "query_id long, bundle_id string, path string, place int, provenance string")
    asks = spark.createDataFrame([(4, "b"), (6, "a")], "query_id long, bundle_id string")
    led = spark.createDataFrame([(3, "a", "p", 1)], "query_id long, bundle_id string, path string, place int")  # leads only to what is there
    fetched = []

    def fetch(asked):
        fetched.extend(values(asked))
        return asked.select("query_id", "bundle_id", F.lit(7).alias("chunk_id"), F.lit(1).alias("place"), F.lit(0).alias("covered"))

    evidence, outcomes = routed.routed_retrieval(questions, approved, asks, led, fetch)
    assert sorted(fetched) == [(2, "a"), (2, "b"), (3, "a"), (6, "a")]
    got = {r.query_id: r for r in outcomes.collect()}
    assert [got[i].discovery_only for i in range(1, 7)] == [False, True, False, False, False, True] and got[2].fallback and not got[1].fallback
    assert got[4].asks == "b" and got[4].n_rag == 0 and got[5].tools == [] and got[3].tools == ["okf_retrieval", "okf_relation_traversal", "rag_retrieval"]
    assert values(evidence.filter("query_id = 3").select("new_index", "source_type", "mode")) == [(1, "okf", "direct"), (2, "rag", None)]


def test_manifest_of_a_profile(spark):
    held = spark.createDataFrame([("b", 'A "b"', ["z", "a"], ["supports"], [("type", False), ("x", True)])], "bundle_id string, name string, types array<string>, relations array<string>, fields array<struct<name:string,required:boolean>>")
    made = plain_yaml.load(bundles.manifest_text(held).first().manifest)
    assert made["base"]["name"] == 'A "b"' and made["relations"]["allowed"] == ["supports"] and list(made["profile"]["types"]) == ["a", "source_manifest", "z"]
    assert made["profile"]["types"]["a"]["required"] == ["x"] and made["profile"]["types"]["z"]["optional"][0] == "type"
