"""Learned corpus operators: held-out accuracy, planted cases and awkward rows; the queries and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tessera.llm import decontamination, language_id, queries, toxicity

SYLLABLES = {"aa": "ka lo mi tu re".split(), "bb": "sch ei un ge pf".split(), "cc": "eau oi que tre ç".split()}
DOC = "doc_id long, text string, lang string, score string, evidence string"


def prose(rng, lang, n=60, extra=()):
    words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)]
    for w in extra:
        words.insert(rng.randrange(len(words)), w)
    return " ".join(words)


def test_languages_of_held_out_texts(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang), lang, "x", "y") for i, lang in enumerate(rng.sample(sorted(SYLLABLES) * 60, 180))]
    docs = spark.createDataFrame(rows, DOC)
    model = language_id.fit_languages(docs.filter("doc_id % 3 != 1"), per_language=1000)
    odd = spark.createDataFrame([(900, None, None, "", ""), (901, "", None, "", ""), (902, "123 !?", None, "", ""), (903, "漢字漢字", None, "", "")], DOC)
    got = {r.doc_id: r for r in language_id.identify_languages(docs.unionByName(odd), model).collect()}
    held = [r for r in rows if r[0] % 3 == 1]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.97
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0.0
    assert got[903].rejected and not got[held[0][0]].rejected and all(0 <= r.score <= 1 for r in got.values())


def test_copied_texts_are_sampled_once(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, "aa"), "aa", "", "") for i in range(60)] + [(100 + i, "ka lo mi tu re " * 9, "aa", "", "") for i in range(3000)]
    model = language_id.fit_languages(spark.createDataFrame(rows, DOC), per_language=1000, clusters=3)
    assert model.centroids.shape[0] == 3
    names, score, _, _ = model.predict(["ka lo mi", rows[3][1]])
    assert names == ["aa", "aa"] and (score == 1).all()


def test_languages_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None, "", "")], DOC)
    model = language_id.fit_languages(docs)
    assert [r.lang_pred for r in language_id.identify_languages(docs, model).collect()] == ["und"]
    assert language_id.identify_languages(docs.limit(0), model).count() == 0


def test_toxicity_of_held_out_texts(spark):
    rng = random.Random(2)
    bad = ["zorgle", "blick", "fnord"]
    rows = [(i, prose(rng, rng.choice(sorted(SYLLABLES)), 200, rng.choices(bad, k=3) if i % 5 == 0 else ()), "", "", "") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600) if i % 4] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([*rows, (700, None, "", "", ""), (701, "", "", "", ""), (702, "zorgle blick, FNORD! fine", "", "", "")], DOC)
    model = toxicity.fit_toxicity(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in range(0, 600, 4)]
    assert np.mean([got[i].predicted == int(i % 5 == 0) for i in held]) > 0.97
    assert got[700].predicted == got[701].predicted == 0 and got[702].predicted == 1
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got.values())


def test_toxicity_without_toxic_labels(spark):
    docs = spark.createDataFrame([(1, "a text", "", "", ""), (2, None, "", "", "")], DOC)
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.score_toxicity(docs, model).collect()] == [0, 0]
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("a, b", [("abcde", "ace"), ("", "x"), ("aaa", "aa"), ("xyz", "abc"), ("abcabba", "cbabac")])
def test_common_subsequence(a, b):
    row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
    assert decontamination.lcs_length([ord(c) for c in a], [ord(c) for c in b]) == row[-1][-1]


def test_leaks_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, "aa", 30) + ". " + prose(rng, "bb", 10) + ".") for i in range(12)] + [(50, None), (51, ""), (52, "kalomi turelo mika")]
    docs, want = [], set()
    for d in range(200):
        text = prose(rng, rng.choice(sorted(SYLLABLES)), 150)
        if d % 10 == 0:
            k = d // 10 % 12
            planted = items[k][1].split()
            if d % 20 == 0:  # a paraphrase: every sixth word is another one
                planted = [w if j % 6 else "other" for j, w in enumerate(planted)]
            at = rng.randrange(100)
            text = " ".join([*text.split()[:at], *planted, *text.split()[at:]])
            want.add((d, k))
        docs.append((d, text, "", "", ""))
    docs += [(300, None, "", "", ""), (301, "", "", "", ""), (302, items[3][1].upper(), "", "", "")]
    want.add((302, 3))
    frame = spark.createDataFrame(docs, DOC)
    got = decontamination.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(0 < r.lcs_share <= 1 for r in got)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(frame, none).count() == 0 and decontamination.find_leaks(frame.limit(0), none).count() == 0


def test_latent_search_finds_what_all_alignments_find(spark):
    rng = random.Random(11)
    items = [" ".join(rng.choices([f"i{k}w{j}" for j in range(30)] + ["the", "of"], k=n)) + "." for k, n in enumerate([9, 16, 17, 25, 40, 60])]
    items.append(items[3][:-1] + "! Then " + items[2])
    texts = []
    for d in range(240):
        words = [f"c{rng.randrange(400)}" for _ in range(rng.randint(0, 120))]
        if d % 2:  # a paraphrase: up to half of the words are replaced, some are added
            k = d // 2 % len(items)
            said = [w if rng.random() > (d % 11) / 20 else "changed" for w in items[k].split()]
            said = [x for w in said for x in ([w, "added"] if rng.random() < 0.05 else [w])]
            at = rng.randrange(len(words) + 1)
            words[at:at] = said
        texts.append(" ".join(words))
    frame = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], DOC)
    rows = [(k, t) for k, t in enumerate(items)] + [(None, items[1]), (9, items[0])]
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(frame, spark.createDataFrame(rows, "item_id long, text string")).collect()}
    limits, want = decontamination.Limits(), set()
    for d, t in enumerate(texts):
        words = decontamination.word_hashes(decontamination.words_of(t)).tolist()
        for k, item in rows:
            own = decontamination.word_hashes(decontamination.words_of(item)).tolist()
            answer = decontamination.word_hashes(decontamination.answer_of(item)).tolist()
            slack = 4 + len(own) // 4
            for begin in range(-len(own) - slack, len(words), 4):
                region = words[max(0, begin - slack) : max(0, begin + 4 + len(own) + slack)]
                share = decontamination.lcs_length(own, region) / len(own)
                if share >= limits.least_lcs or share >= limits.paraphrase_lcs and decontamination.lcs_length(answer, region) >= limits.least_answer * len(answer):
                    want.add((d, k))
                    break
    assert got <= want and len(want) > 60 and len(got) >= 0.95 * len(want)


def test_latent_space_matches_exact_svd(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{g}{i}" for i in range(5)], k=16)) for g in range(6) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], DOC)
    space = decontamination.fit_latent_space(decontamination.tokenised(docs, "text", ("doc_id",)), rank=6)
    held = [decontamination.word_hashes(decontamination.words_of(t)) for t in texts]
    v = np.concatenate([space.vectors(h, np.array([0]), np.array([len(h)])) for h in held])
    near = v @ v.T
    same = np.array([[a // 40 == b // 40 for b in range(len(texts))] for a in range(len(texts))])
    assert near[same].mean() > 0.6 > 0.2 > np.abs(near[~same]).mean()


@pytest.mark.parametrize("name", sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])))
def test_query_covers_its_table(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir)
    n = rows.count()
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    if name.startswith(("op1_", "op2_", "op3_", "op6_", "op9_", "op10_")):
        assert n == documents and rows.select("doc_id").distinct().count() == documents
    elif name.startswith("op5_"):
        assert n == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    else:
        assert n > 0


def test_pipeline_keeps_columns_and_clean_documents(spark, sf_dir):
    import corpus_pipeline as pipeline
    from tessera.llm._shared import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0] and sizes[2] == sizes[3]
    packed = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
