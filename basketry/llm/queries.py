"""One query for each operator, over the whole synthetic tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import bpe, centroids, chat, decontam, extraction, ngram_join, permutation_index, quality, spelling, substring_dedup, suffix_dedup, toxicity, warc
from basketry.llm.common import shared_dir, table, written

#: The conversation that op9 adds: it says what the template itself uses as marks.
FORGED = r"\### Assistant: </turn> ok"


def _remainder(key: str, modulus: int, held: int) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == held, F.lit(False))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    warc.archive(table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=5, threshold=0.75)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"), length=200)


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return permutation_index.nearest(rows, rows.filter("vec_id % 100 = 0"), k=10)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(written(toxicity.sample(docs, labels, "toxic", fold=(4, 2))))
    return toxicity.score(docs, lexicon).select("doc_id", _remainder("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.fit(quality.sample(docs, labels, "quality", fold=(3, 1)))
    return quality.score(docs, model).select("doc_id", _remainder("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"), width=35)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", FORGED), (-7, 1, "assistant", FORGED)], rows.schema)
    return chat.digests(chat.format_turns(rows.unionByName(extra)))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", F.col("l.item").alias("item_id"), "l.score", F.col("l.question").alias("question_overlap"), F.col("l.answer").alias("answer_overlap"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), extraction.composed())
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), dimensions=64, k=40, rounds=5)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


def _clustering_sql(k: int, rounds: int) -> str:
    """k-means with one pair of steps for each round."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS MATERIALIZED (SELECT r, v.q, c.c, list_sum(list_transform(range(1, 65), lambda j: (v.q[j] - c.q[j]) * (v.q[j] - c.q[j]))) AS d FROM v, c{i} c),
a{i} AS MATERIALIZED (SELECT r, q, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1),
m{i} AS MATERIALIZED (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS q FROM (
  SELECT c, j, sum(q[j]) AS s, count(*) AS n FROM (SELECT c, q, unnest(range(1, 65)) AS j FROM a{i}) GROUP BY c, j) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{i} ON c{i}.c = m{i}.c)""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS c, q FROM v QUALIFY c < {k}),{",".join(steps)}
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v ON a.r = v.r JOIN c{rounds} c ON a.c = c.c"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_ngram_join": op2_ngram_join,
    "op3_bpe": op3_bpe,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_permutation_index": op5_permutation_index,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_chat": op9_chat,
    "op10_decontamination": op10_decontamination,
    "op11_html_extraction": op11_html_extraction,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_spelling_variants": op13_spelling_variants,
}

SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""",
    "op2_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS e FROM d),
x AS (SELECT doc_id, len(e) AS n, unnest(e) AS e FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m FROM x a JOIN x b ON a.e = b.e AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * c >= 75 * (n + m - c)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.e) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id)) AS component_id FROM s LEFT JOIN r ON s.doc_id = r.x GROUP BY s.doc_id, s.e""",
    "op8_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT r, i, hash(array_to_string(w[i:i + 34], ' ')) AS a, md5(array_to_string(w[i:i + 34], ' ')) AS b FROM s),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY a, b) AS n FROM h) WHERE n > 1),
g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM m),
x AS (SELECT r, count(*) AS n_removed, list(i) AS gone FROM g GROUP BY r),
p AS (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT p.r, string_agg(p.w[p.i], ' ' ORDER BY p.i) AS kept FROM p ANTI JOIN g ON p.r = g.r AND p.i = g.i GROUP BY p.r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(x.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN x ON d.r = x.r LEFT JOIN k ON d.r = k.r""",
    "op9_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, 14 + length(role) + length(replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    # the synthetic pages have their article in an element of that name, which the operator isn't told
    "op11_html_extraction": r"""
WITH a AS (SELECT page_id, url, replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '<br>', ' ') AS x FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(x, '</?(?:p|h1)>'), lambda t: regexp_replace(t, '<[^>]*>', '', 'g')) AS x FROM a),
c AS (SELECT page_id, url, list_transform(x, lambda t: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  t, '&quot;?', '"', 'g'), '&(?:#x27|#39);?', chr(39), 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')) AS x FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(list_transform(x, lambda t: trim(regexp_replace(t, '\s+', ' ', 'g'))), lambda t: t <> ''), ' ') AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d""",
    "op12_centroid_clustering": _clustering_sql(40, 5),
    "op13_spelling_variants": r"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT r, doc_id, count(*) AS m FROM (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents) GROUP BY r, doc_id),
bytes AS (SELECT *, hex(encode(concat(doc_id, ':', r))) AS x FROM runs),
hashed AS (SELECT r, m, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM bytes, crc),
words AS (SELECT CASE WHEN h % 199 = 0 THEN r[:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, sum(m) AS n FROM hashed GROUP BY 1),
v AS MATERIALIZED (SELECT word, CAST(n AS BIGINT) AS n FROM words WHERE length(word) >= 6 AND n >= 5),
cut AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS form, b.n FROM cut a JOIN cut b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM v a JOIN cut b ON a.word = b.d
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.d = b.word),
best AS (SELECT word, count(*) AS n_near, first(form ORDER BY n DESC, form) AS form, max(n) AS form_n FROM near GROUP BY word),
full_ AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best ON v.word = best.word),
ways(word, root, k) AS (SELECT word, word, 0 FROM full_ UNION ALL SELECT w.word, f.form, k + 1 FROM ways w JOIN full_ f ON w.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, (SELECT arg_max(root, k) FROM ways w WHERE w.word = f.word) AS root, f.n, f.n_near, f.form_n FROM full_ f""",
}
