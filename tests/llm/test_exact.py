"""Corpus operators against brute force, on small and on awkward inputs."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from tessera.llm import chat_format, packing, simhash_dedup, suffix_dedup, token_counts, url_reputation, winnowing

DOC = "doc_id long, text string, source string, chunk string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "s", "clash") for i, t in rows], DOC)


# --- SimHash -----------------------------------------------------------------


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))
    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            old, new = root[b], root[a]
            root = [new if r == old else r for r in root]
    return root


@pytest.mark.parametrize("text", [None, "", " \t ", "One", "one two three", "A b C d E f", "Ä É x Y", "w " * 50, "x\u00a0y z\u2003q r s"])
def test_fingerprint(text):
    assert simhash_dedup.fingerprint_of(text) == brute_fingerprint(text)


def test_components_equal_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(12)]
    texts = [None, "", "  ", *base, *base[:4]]
    for t in base:
        for _ in range(5):
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    rows = list(enumerate(texts, start=10)) + [(10, None), (None, base[0])]
    got = simhash_dedup.near_duplicates(documents(spark, rows)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(fps)
    least = {r: min((i for (i, _), q in zip(rows, root, strict=True) if q == r and i is not None), default=None) for r in set(root)}
    want = sorted((str(i), f - (1 << 64) if f >> 63 else f, least[r]) for (i, _), f, r in zip(rows, fps, root, strict=True))
    assert sorted((str(r.doc_id), r.fp, r.component_id) for r in got) == want
    assert len(set(root)) < len(root)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=6), st.integers(0, 1 << 30))
def test_every_link_is_met_in_some_bucket(seeds, seed):
    """Collisions in two parts and whole give the same components as all pairs."""
    rng = random.Random(seed)
    fps = sorted({*seeds, *(s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for s in seeds for _ in range(4))})
    values = np.array(fps, dtype=np.uint64)
    for limit in (1 << 30, 3000):
        found = list(simhash_dedup.collisions(values, np.full(len(fps), 2), np.arange(len(fps)), 64, limit))
        a = np.concatenate([x[0] for x in found]) if found else np.zeros(0, int)
        b = np.concatenate([x[1] for x in found]) if found else np.zeros(0, int)
        label = simhash_dedup.forest(len(fps), a, b).tolist()
        want = brute_components(fps)
        assert [label.index(x) for x in label] == [want.index(x) for x in want]


def test_no_documents(spark):
    assert simhash_dedup.near_duplicates(documents(spark, [])).count() == 0


# --- Suffix deduplication ----------------------------------------------------


def brute_removed(rows):
    """Kept bytes and removed runs by comparing every 50-byte string with all smaller ids."""
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], 1 << 62), 1 << 62 if i is None else i)
    out = []
    for i, t in rows:
        b, own = (t or "").encode(), 1 << 62 if i is None else i
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < own:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def suffix_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 30))) for _ in range(6)]
    rows = [(None, passages[0]), (3, None), (4, ""), (5, "x" * 49), (6, "x" * 50), (7, "x" * 400), (7, "y" * 60), (7, "y" * 60), (90, "y" * 60 + "x" * 55)]
    for i in rng.sample(range(100, 1000), 60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(20)) for _ in range(rng.randint(0, 6))]
        rows.append((i, " ".join(parts)[rng.randint(0, 5) :]))
    rows += [(2000, rows[20][1]), (2001, rows[20][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, chunk_bytes", [(1, 1 << 22), (2, 3000)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, seed, chunk_bytes):
    rows = suffix_rows(seed)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk_bytes)
    left = suffix_dedup.remove_repeats(documents(spark, rows).repartition(3)).collect()
    got = sorted(((r.doc_id, r._n_bytes, r._n_bytes - len(r._kept), len(r._spans), hashlib.sha256(bytes(r._kept)).hexdigest()) for r in left), key=str)
    assert got == brute_removed(rows)
    assert {(r.source, r.chunk) for r in left} == {("s", "clash")}


def test_cover_is_a_difference_cover():
    assert {(a - b) % suffix_dedup.MODULUS for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.MODULUS))


def test_suffixes_of_nothing(spark):
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize("texts", [
    ["".join(random.Random(i).choices("abcdefghij", k=300)) for i in range(8)], ["short", "x" * 19, "", None, "y" * 49], ["a b", "lone " * 4000], [None, ""], ["only one text, of some eighty bytes, which nothing repeats and which repeats nothing"],
    ["z" * 50, "z" * 50], ["é" * 40, "é" * 40 + "x"],
])
@pytest.mark.parametrize("parts", [1, 5])
def test_texts_without_repeats_and_short_ones_stay(spark, texts, parts):
    rows = [(i, t, 5, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int, rest long").repartition(parts)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    starts = {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = {k for at in range(len(b) - 49) if starts.get(b[at : at + 50], i) < i for k in range(at, at + 50)}
        assert bytes(got[i]["_kept"]) == bytes(x for k, x in enumerate(b) if k not in gone) and (got[i].chunk, got[i]["rest"]) == (5, i)
        for at in range(len(b) - 49):
            starts.setdefault(b[at : at + 50], i)


@given(st.lists(st.integers(0, (1 << 63) - 1), unique=True))
def test_packed_integers_come_back(values):
    ascending = np.array(sorted(values), dtype=np.uint64)
    assert suffix_dedup._unpack_sorted(suffix_dedup._pack_sorted(ascending)).tolist() == ascending.tolist()


# --- Winnowing ---------------------------------------------------------------


def brute_winnow(text, k, w):
    codes = np.array([ord(c) for c in text or ""], dtype=np.uint32)
    h = [int(x) >> winnowing.PLACE_BITS for x in winnowing.gram_hashes(codes, k)]
    chosen = set()
    for i in range(max(1, len(h) - w + 1) if h else 0):
        window = h[i : i + w]
        chosen.add(i + max(j for j, x in enumerate(window) if x == min(window)))
    return [(h[i], i) for i in sorted(chosen)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abé😀 ", max_size=150), st.integers(1, 6), st.integers(1, 9))
def test_winnow_takes_rightmost_minima(text, k, w):
    hashes, places = winnowing.winnow(text, k, w)
    assert list(zip(hashes.tolist(), places.tolist(), strict=True)) == brute_winnow(text, k, w)


@given(st.text("ab c", max_size=80), st.integers(33, 60))
def test_long_texts_are_winnowed_in_stretches(text, stretch):
    whole, parts = winnowing.winnow(text, 4, 8), winnowing.winnow(text, 4, 8, stretch - 24)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, parts, strict=True))


def test_shared_passage_is_found():
    rng = random.Random(1)
    shared = "".join(rng.choices("abcdefgh", k=winnowing.GRAM + winnowing.WINDOW - 1))
    a, b = ("".join(rng.choices("ijklmnop", k=500)) for _ in range(2))
    found = [set(winnowing.winnow(x[:200] + shared + x[200:])[0].tolist()) for x in (a, b)]
    assert found[0] & found[1]


def test_edits_follow_the_order_of_ids(spark):
    rows = [(i, t) for i, t in enumerate(["abc" * 40, None, "", "x", "é😀" * 30, "long " * 200, "long " * 200])] + [(None, "null id"), (6, "again")]
    got = winnowing.compare_with_edits(documents(spark, rows).repartition(4)).collect()
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -1), r[1] is not None, r[1] or ""))
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = (winnowing.winnow(x)[0] for x in (t, edited, n))
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), winnowing.likeness(a, b), winnowing.likeness(a, c)))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == sorted(want)
    assert winnowing.compare_with_edits(documents(spark, [])).count() == 0
    one = winnowing.compare_with_edits(documents(spark, [(1, "alone")])).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(1, 1.0)]


# --- Packing -----------------------------------------------------------------


def brute_pieces(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()


@pytest.mark.parametrize("text", [None, "", "It's  Öl—naïve\u00a0x 12³ don't", "a\x1cb c\x85d", "e\u0301 \u0301x", "a'S'll'x 'T _b_ ##'d\x7f\x80 \xd7\xb5", "caf\u00c9&&& l'\u00e9t\u00e9 \u00bd\u00b2 \u00aa\x1f\u00ad", "<|endoftext|> y<|startoftext|>z", "ΣΑΣ İ ﬁ", "字 漢字。" * 30])
def test_word_ids_equal_whole_text_ids(text):
    assert list(packing.token_bytes([text, "other", text], public_tokenizers.path("word_bpe_49k.json"))) == [brute_pieces(text), brute_pieces("other"), brute_pieces(text)]


def test_word_ids_outlive_a_full_store():
    rng, path = random.Random(6), public_tokenizers.path("word_bpe_49k.json")
    store = packing.WordIds(path, most=40)
    for _ in range(30):
        words = {"".join(rng.choices("abcdé", k=rng.randint(1, 4))) + rng.choice(["", "!", "字"]) for _ in range(30)} | {"the"}
        store.learn(words)
        assert all(store.young[w] + bytes(4) == brute_pieces(w) for w in words)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(max_codepoint=255), max_size=40))
def test_latin_texts_have_the_ids_of_the_whole(text):
    assert next(packing.token_bytes([text], public_tokenizers.path("word_bpe_49k.json"))) == brute_pieces(text)


@pytest.mark.parametrize("seed", range(4))
def test_search_beats_best_fit_where_it_is_not_optimal(seed):
    rng, lengths = random.Random(seed), []
    for _ in range(40):  # triplets that fill a bin exactly
        a, b = rng.randint(380, 490), rng.randint(250, 255)
        lengths += [a, b, 1000 - a - b]
    packer = packing.Packer(lengths, 1000, seed)
    greedy = packer.best_fit([], packer.longest_first(list(range(120))))
    found = packer.evolve([], 100, 10)
    assert sorted(i for b in found for i in b) == list(range(120)) and max(map(packer.fill, found)) <= 1000
    assert len(found) <= 41 < len(greedy)


def test_blocks_join_their_worst_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 64)
    rng = random.Random(9)
    rows = [(i, rng.choice([1100, 1500, 700, 300, 2048, 1])) for i in range(2000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, length long")).collect()
    assert sorted((r.doc_id, r.length) for r in got) == rows
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(o == sum(n for _, n in sorted(held)[:k]) for held in bins.values() for k, (o, _) in enumerate(sorted(held)))
    assert max(sum(n for _, n in held) for held in bins.values()) <= packing.CAPACITY
    packer = packing.Packer([n for _, n in rows], packing.CAPACITY, 0)
    assert len(bins) <= 1.01 * len(packer.best_fit([], packer.longest_first(list(range(2000)))))


def test_packing_is_a_partition(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "ga'm"], k=rng.choice([0, 5, 300, 900, 1500, 5000])))) for i in range(150)] + [(7, None), (None, "x"), (7, None)]
    pieces = packing.pieces_of(documents(spark, rows), public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(pieces).collect()
    want = []
    for i, t in rows:
        ids = brute_pieces(t)
        want += [(str(i), k, at // 4, len(ids[at : at + 8192]) // 4, zlib.crc32(ids[at : at + 8192])) for k, at in enumerate(range(0, len(ids), 8192))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= packing.CAPACITY
    total = sum(w[3] for w in want)
    assert len(bins) <= 1.05 * -(-total // packing.CAPACITY) + 1
    assert packing.pack(packing.pieces_of(documents(spark, []), public_tokenizers.path("word_bpe_49k.json"))).count() == 0


# --- Token counts ------------------------------------------------------------


def brute_tokens(word, scores):
    marked = token_counts.WORD_MARK + word
    best = {0: (0.0, 0)}
    for end in range(1, len(marked) + 1):
        options = [(best[s][0] + scores[marked[s:end]], best[s][1] - 1) for s in range(end) if marked[s:end] in scores]
        n = len(marked[end - 1].encode())
        options.append((best[end - 1][0] + n * token_counts.BYTE_SCORE, best[end - 1][1] - n))
        best[end] = max(options)
    return -best[len(marked)][1]


def test_shared_prefixes_do_not_change_counts():
    scores, longest = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    words = {"".join(rng.choices("theandor", k=rng.randint(1, 12))) for _ in range(300)} | {"naïve", "字", "😀x", "a" * 300}
    assert token_counts.terminal_counts(list(words), scores, longest) == {w: brute_tokens(w, scores) for w in words}


def test_counts_of_documents(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores, _ = token_counts.vocabulary(path)
    rows = [(1, "the cat the"), (2, None), (3, ""), (None, " \n"), (1, "the cat the")]
    got = sorted((str(r.doc_id), r.n_pretokens, r.n_tokens) for r in token_counts.count_tokens(documents(spark, rows), path).collect())
    assert got == sorted((str(i), len((t or "").split()), sum(brute_tokens(w, scores) for w in (t or "").split())) for i, t in rows)


# --- URLs --------------------------------------------------------------------


def test_hosts_paths_and_rules(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/")]
    urls = ["http://A.Example.COM/en/71?x", "https://other.com/en/", "no scheme", None, "ftp://u@h.net:80/p#f", "x://É.NET?q://z", "http://notnet/x", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    judged = {r.page_id: r for r in url_reputation.judge_urls(pages, pages.selectExpr("url", "cast(null as int) as outcome"), rules).collect()}
    assert [(judged[i].host, judged[i].path) for i in range(8)] == [
        ("a.example.com", "/en/71"), ("other.com", "/en/"), ("", ""), ("", ""), ("u@h.net:80", "/p"), ("É.net", ""), ("notnet", "/x"), ("b:", "//c/d"),
    ]
    assert [judged[i].rule for i in range(8)] == ["example.com/en/7", "com/en/", None, None, None, None, None, None]
    assert [judged[i].verdict for i in range(2)] == ["allow", "block"]


def test_reputation_shrinks_towards_the_domain(spark):
    rows = [("http://bad.x.com/", 0)] * 40 + [("http://good.x.com/", 1)] * 60 + [("http://y.net/", 1)] * 60 + [("http://new.x.com/", None), ("http://z.co.uk/", 1), ("http://two.x.com/", 0)]
    pages = spark.createDataFrame(rows, "url string, outcome int")
    got = {r.host: r for r in url_reputation.host_reputation(pages).collect()}
    assert got["bad.x.com"].posterior < 0.1 < got["two.x.com"].posterior < got["new.x.com"].posterior < got["good.x.com"].posterior
    assert got["z.co.uk"].domain == "z.co.uk" and got["z.co.uk"].suffix == "co.uk" and got["good.x.com"].domain == "x.com"
    assert all(r.lower <= r.posterior <= r.upper for r in got.values())
    assert url_reputation.host_reputation(pages.limit(0)).count() == 0


# --- Chats -------------------------------------------------------------------


def brute_maximal(rows):
    convs: dict = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, []).append((t is None, t or 0, r is not None, r or "", x is not None, x or ""))
    turns = {c: tuple(x[2:] for x in sorted(v)) for c, v in convs.items()}
    out = {}
    for c, v in turns.items():
        if not any(len(w) > len(v) and w[: len(v)] == v for w in turns.values()):
            out.setdefault(v, []).append(c)
    return {(min((i for i in cs if i is not None), default=None), len(v), len(cs)) for v, cs in out.items()}


def test_only_maximal_conversations_stay(spark):
    rng = random.Random(4)
    rows = []
    for c in range(60):
        story = rng.choice(["a", "b", "c"])
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, rng.choice(["user", None]) if t == 9 else "user", f"{story}{t}" if rng.random() < 0.9 else None))
    rows += rows[:5] + [(70, None, None, None), (71, 3, "user", "a0"), (None, 0, "user", "zz")]
    got = chat_format.render_chats(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, position string")).collect()
    assert {(r.conv_id, r.n_turns, r.n_logged) for r in got} == brute_maximal(rows)


def test_rendering(spark):
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 2, None, None)]
    got = chat_format.render_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert got.chat == "<|user|>\nhi\n<|end|>\n<|assistant|>\nyes\n<|end|>\n<|user|>\n\n<|end|>\n"
    assert chat_format.render_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_latin_words_need_the_model_alone(monkeypatch):
    """Pre-tokens went through the tokenizer's normal form and split a second time."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    draw, letters = random.Random(2), [chr(c) for c in range(256)]
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 60))) for _ in range(500)] + ["it's 'T x'll '' 'sa don't", "ÀÉß ªº µ ÿ \xad\x85\xa0 a\x1cb"]
    store, whole = packing.WordIds(path), Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "_word_ids", lambda _: store)
    monkeypatch.setattr(store, "encode", None)
    for t, held in zip(texts, packing.token_bytes(texts, path), strict=True):
        assert np.frombuffer(held, dtype="<u4").tolist() == [*whole.encode(t, add_special_tokens=False).ids, packing.END_ID]


def test_learnt_words_come_in_a_dictionary_of_their_own():
    """Also where the store's generations change, and whether a word is new, young or old."""
    store = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"), most=40)
    rng = random.Random(6)
    for _ in range(12):
        words = {f"{rng.choice('abé')}{'x' * rng.randint(0, 20)}" for _ in range(15)}
        held = store.learn(words)
        assert held.keys() == words and all(held[w] == store.young[w] for w in words)
    assert all(held[w] + bytes(4) == brute_pieces(w) for w in sorted(words)[:3])


def test_plain_texts_split_as_the_pattern_says():
    rng = random.Random(7)
    odd = "aB\xdf\xe9\xd7\xc9 \t\x85\xa0\x1c1\xb2'.,-\"\x00\xaa\n"
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 12))) for _ in range(3000)] + [chr(a) + chr(b) for a in range(256) for b in range(256)]
    assert all(packing._words(t) == packing._PRE_TOKEN.findall(t.lower()) for t in texts if "<|" not in t)
