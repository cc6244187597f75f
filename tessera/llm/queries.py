"""The numbered corpus queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import crc_bucket, table
from tessera.llm.ball_clustering import cluster_vectors
from tessera.llm.chat_format import render_chats
from tessera.llm.decontamination import find_leaks
from tessera.llm.language_id import fit_languages, identify_languages
from tessera.llm.packing import pack, pieces_of
from tessera.llm.secret_scan import find_secrets, span_text
from tessera.llm.simhash_dedup import near_duplicates
from tessera.llm.suffix_dedup import remove_repeats
from tessera.llm.token_counts import count_tokens
from tessera.llm.toxicity import fit_toxicity, score_toxicity
from tessera.llm.url_reputation import judge_urls, path_of
from tessera.llm.vector_codes import compress_vectors
from tessera.llm.winnowing import compare_with_edits

#: The rules that the URL query applies: verdict, host, path.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose crc32 remainder by 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit_languages(docs.filter(crc_bucket(F.col("doc_id"), 3) != 1))
    return identify_languages(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels whose crc32 remainder by 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit_toxicity(docs, labels.filter(crc_bucket(F.col("doc_id"), 5) != 0))
    scored = score_toxicity(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "score", "predicted", "evidence")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that leaks a benchmark item, with the item and the evidence."""
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", *(F.round(c, 4).alias(c) for c in ("cosine", "lcs_share", "answer_share")), "first_word")


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url.

    A page shows the document whose number ends its path, so the page's outcome
    is that document's label: good if its quality is 1 and it is not toxic.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)
    outcomes = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_doc")).agg(F.min(good).alias("outcome"))
    number = F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})(?:\.\w+)?/?$", 1)
    shown = pages.select("url", F.when(number != "", number).cast("long").alias("_doc"))
    labelled = shown.join(outcomes, "_doc", "left").select("url", "outcome")
    judged = judge_urls(pages, labelled, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "posterior", "upper")


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowing fingerprints of every document and of its edited text."""
    return compare_with_edits(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 2048 tokens."""
    return pack(pieces_of(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal logged conversation, rendered; the chat is given by its length and sha256."""
    chats = render_chats(table(spark, sf_dir, "conversations"))
    return chats.select(
        "conv_id", "n_turns", "n_logged", F.length("chat").cast("long").alias("n_chars"), F.sha2(F.col("chat").cast("binary"), 256).alias("chat_sha256")
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the public 32k vocabulary."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 50-byte strings of earlier ones."""
    left = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.col("_n_bytes") - F.length("_kept")
    return left.select(
        "doc_id", F.col("_n_bytes").alias("n_bytes"), removed.cast("long").alias("n_removed"),
        F.size("_spans").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"),
    )


def op11_ball_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector of 64 components after ten exact rounds from eight hashed starts."""
    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3, width=64)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: spans of the patterns, and those that the network adds."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(span_text("_base").cast("binary"), 256).alias("base_sha256"), span_text("_spans").alias("spans"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-byte code of every vector under four codebooks of 256 entries, trained in four exact rounds."""
    return compress_vectors(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_url_reputation": op5_url_reputation,
    "op6_winnowing": op6_winnowing,
    "op7_packing": op7_packing,
    "op8_chat_format": op8_chat_format,
    "op9_token_counts": op9_token_counts,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_ball_clustering": op11_ball_clustering,
    "op12_secret_scan": op12_secret_scan,
    "op13_vector_codes": op13_vector_codes,
}

_WHOLE = "list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))"
_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"
_SQUARE = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
#: sum / n, going down.
_DOWN = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"


def _clustering_sql(k: int, rounds: int) -> str:
    """One assignment and one update as subqueries a round; distance and number go into one integer, so that the least breaks ties."""
    nearest = "SELECT vec_id, kept.v, min({d} * {k} + c) AS best FROM kept, c{r} AS c GROUP BY vec_id, kept.v"
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, {_WHOLE} AS v FROM embeddings WHERE len(embedding) = 64 AND {_SOUND})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED ({nearest.format(d=_SQUARE.format(a='kept.v', b='c.v'), k=k, r=r)})")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c, list({_DOWN} ORDER BY i) AS v FROM (
    SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT best % {k} AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c
  UNION ALL SELECT c, v FROM c{r} WHERE c NOT IN (SELECT best % {k} FROM a{r}))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(best % {k} AS INTEGER) AS cluster, CAST(best // {k} AS BIGINT) AS distance,
       CAST(sum(best // {k}) OVER (PARTITION BY best % {k}) AS BIGINT) AS cluster_inertia, CAST(sum(best // {k}) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} AS c ON c.c = best % {k}"""


def _codes_sql(entries: int, rounds: int) -> str:
    nearest = "SELECT vec_id, label, p, part, min({d} * {k} + e) AS best FROM cut JOIN b{r} AS b USING (p) GROUP BY vec_id, label, p, part"
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, {_WHOLE} AS v FROM embeddings WHERE {_SOUND})",
        "cut AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS part FROM kept, range(4) AS r(p))",
        f"b0 AS MATERIALIZED (SELECT p, e, part AS entry FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}) USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(d=_SQUARE.format(a='part', b='b.entry'), k=entries, r=r)})")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT p, e, list({_DOWN} ORDER BY i) AS entry FROM (
    SELECT p, e, i, sum(x) AS s, count(*) AS n FROM (SELECT p, best % {entries} AS e, unnest(part) AS x, generate_subscripts(part, 1) AS i FROM a{r}) GROUP BY p, e, i) GROUP BY p, e
  UNION ALL SELECT p, e, entry FROM b{r} WHERE (p, e) NOT IN (SELECT (p, best % {entries}) FROM a{r}))""")
    return f"""WITH {", ".join(steps)}, done AS (
  SELECT vec_id, label, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       sha256((SELECT string_agg(array_to_string(entry, ','), ',' ORDER BY p, e) FROM b{rounds})) AS codebooks_sha256 FROM done"""


_STRENGTH_SQL = """coalesce(greatest(2.0, least(1000.0, CASE WHEN sum({n} * (({g} / {n} - {m}) * ({g} / {n} - {m}) - {m} * (1 - {m}) / {n})) / sum({n}) > 0
  THEN (sum({n} * {m} * (1 - {m})) / sum({n})) / (sum({n} * (({g} / {n} - {m}) * ({g} / {n} - {m}) - {m} * (1 - {m}) / {n})) / sum({n})) - 1 ELSE 1000.0 END)), 2.0)"""

ORACLES = {
    "op11_ball_clustering": _clustering_sql(8, 10),
    "op13_vector_codes": _codes_sql(256, 4),
    "op5_url_reputation": f"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), o AS (
  SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS y FROM labels GROUP BY doc_id
), h0 AS (
  SELECT host, string_split(host, '.') AS ls, CAST(count(y) AS DOUBLE) AS n, CAST(coalesce(sum(y), 0) AS DOUBLE) AS good
  FROM p LEFT JOIN o ON o.doc_id = CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:[.][A-Za-z0-9_]+)?/?$', 1), '') AS BIGINT) GROUP BY host
), h1 AS (
  SELECT *, CASE WHEN len(ls) > 2 AND ls[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') AND length(ls[-1]) = 2 THEN ls[-2] || '.' || ls[-1] ELSE ls[-1] END AS suffix FROM h0
), h AS (
  SELECT *, CASE WHEN len(ls) >= len(string_split(suffix, '.')) + 1 THEN array_to_string(ls[-(len(string_split(suffix, '.')) + 1):], '.') ELSE host END AS domain FROM h1
), d AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM h GROUP BY suffix, domain),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY suffix),
t AS (SELECT CASE WHEN sum(n) > 0 THEN sum(good) / sum(n) ELSE 0.5 END AS top FROM s),
ss AS (SELECT {_STRENGTH_SQL.format(n="n", g="good", m="top")} AS k FROM s, t WHERE n > 0),
sm AS (SELECT suffix, (good + k * top) / (n + k) AS smean FROM s, t, ss),
ds AS (SELECT {_STRENGTH_SQL.format(n="n", g="good", m="smean")} AS k FROM d JOIN sm USING (suffix) WHERE n > 0),
dm AS (SELECT domain, suffix, (good + k * smean) / (n + k) AS dmean FROM d JOIN sm USING (suffix), ds),
hs AS (SELECT {_STRENGTH_SQL.format(n="n", g="good", m="dmean")} AS k FROM h JOIN dm USING (domain, suffix) WHERE n > 0),
hm AS (SELECT host, (good + k * dmean) / (n + k) AS mean, n + k AS w FROM h JOIN dm USING (domain, suffix), hs),
r AS (SELECT host, mean, least(mean + 1.645 * sqrt(greatest(mean * (1 - mean), 0.0) / (w + 1)), 1.0) AS upper FROM hm),
j AS (SELECT page_id, p.host, path, mean, upper, CASE
    WHEN (p.host = 'example.com' OR suffix(p.host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (p.host = 'example.net' OR suffix(p.host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (p.host = 'com' OR suffix(p.host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (p.host = 'net' OR suffix(p.host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (p.host = 'org' OR suffix(p.host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM p JOIN r ON r.host = p.host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN upper < 0.8 THEN 'block' ELSE 'allow' END AS verdict, round(mean, 6) AS posterior, round(upper, 6) AS upper FROM j
""",
    "op8_chat_format": """
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
), o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS pos,
         coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n') AS part,
         '<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS said
  FROM t
), p AS (
  SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         sha256(string_agg(part, chr(2)) OVER (PARTITION BY conv_id ORDER BY pos)) AS name
  FROM o
), w AS (
  SELECT name, n_turns, min(conv_id) AS conv_id, count(*) AS n_logged FROM p WHERE pos = n_turns GROUP BY name, n_turns
), k AS (
  SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n_turns AND p.name = w.name AND p.pos = w.n_turns)
), c AS (
  SELECT conv_id, string_agg(said, '' ORDER BY pos) AS chat FROM o GROUP BY conv_id
)
SELECT k.conv_id, k.n_turns, k.n_logged, CAST(length(c.chat) AS BIGINT) AS n_chars, sha256(c.chat) AS chat_sha256
FROM k JOIN c ON c.conv_id = k.conv_id
""",
}
