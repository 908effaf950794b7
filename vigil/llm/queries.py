"""Registered queries of the subpackage and their DuckDB twins (where SQL can express one)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.llm import byte_bpe, decontaminate, importance, langid, licenses, repair, sentencepiece, simhash, suffix_tree, topk, urlfilter, variants, warc
from vigil.llm.common import fold_of, materialize, read_table


def op1_exact_topk(spark, sf):
    vectors = read_table(spark, sf, "embeddings", "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024.0)


OP1_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op2_token_files(spark, sf):
    import public_tokenizers
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    return repair.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op3_language_id(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text", "lang")
    prototypes = langid.train(docs.where(fold_of(F.col("doc_id"), 3) != 1))
    found = langid.predict(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op4_warc_index(spark, sf):
    return warc.archived_pages(read_table(spark, sf, "pages", "page_id", "url", "html"), least=1000)


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
sized AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
grouped AS (
  SELECT *, count(*) OVER (PARTITION BY payload_digest) AS n, max(page_id) OVER (PARTITION BY payload_digest) AS keep FROM sized)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id IS DISTINCT FROM keep AND keep IS NOT NULL
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM grouped
"""

def op5_license_scan(spark, sf):
    return licenses.scan(read_table(spark, sf, "documents", "doc_id", "text"), least=0.8)


def _words_sql(text):
    return f"list_filter(string_split(trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda v: v <> '')"


def _license_sql():
    values = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in t)) for t in licenses.TEMPLATES)
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t0(license, passage) AS (VALUES {values}),
t AS (SELECT license, {grams} AS g FROM (SELECT license, {_words_sql('passage')} AS w FROM t0)),
d AS (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS l, coalesce(text, '') AS body FROM documents),
p AS (SELECT doc_id, row, unnest(CASE WHEN len(l) > 1 THEN list_append(l, body) ELSE l END) AS part,
             unnest(range(len(l) + 1)) AS place_no FROM d),
g AS (SELECT doc_id, row, place_no, {grams} AS g FROM (SELECT *, {_words_sql('part')} AS w FROM p WHERE part IS NOT NULL)),
m AS (SELECT doc_id, row, place_no, license, 2 * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) AS dice
      FROM g, t WHERE len(g.g) > 0 AND len(g.g) <= 2 * len(t.g) AND len(t.g) <= 2 * len(g.g)),
r AS (SELECT *, row_number() OVER (PARTITION BY row, place_no ORDER BY dice DESC, license) AS place FROM m WHERE dice >= 0.8)
SELECT doc_id, license, count(*) AS passages, max(dice) AS dice FROM r WHERE place = 1 GROUP BY doc_id, license
"""


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op6_url_filter(spark, sf):
    return urlfilter.judge(read_table(spark, sf, "pages", "page_id", "url"), URL_RULES)


def op7_simhash_dedup(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    return simhash.near_duplicates(docs, shingle=3, radius=2)


def op8_decontamination(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    return decontaminate.contaminated(docs, read_table(spark, sf, "benchmark", "item_id", "text"), width=5, least=0.8)


def _decontamination_sql():
    grams = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))"
    return f"""
WITH b AS (SELECT DISTINCT item_id, {grams} AS g FROM (SELECT item_id, {_words_sql('text')} AS w FROM benchmark WHERE text IS NOT NULL)),
bg AS (SELECT item_id, g, unnest(g) AS s FROM b),
dg AS (SELECT doc_id, row, unnest({grams}) AS s
       FROM (SELECT doc_id, row_number() OVER () AS row, {_words_sql('text')} AS w FROM documents WHERE text IS NOT NULL)),
m AS (SELECT doc_id, row, item_id, g, count(*) / max(len(g)) AS containment FROM dg JOIN bg USING (s) GROUP BY doc_id, row, item_id, g)
SELECT doc_id, item_id, max(containment) AS containment FROM m WHERE containment >= 0.8 GROUP BY doc_id, item_id
"""


def op9_suffix_tree_scores(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text").withColumn("held_out", fold_of(F.col("doc_id"), 5) == 1)
    texts = docs.where(~F.col("held_out")).select(F.col("text").alias("body"))
    vocabulary = materialize(suffix_tree.word_counts(texts), "word-counts")
    return suffix_tree.score(docs, vocabulary, suffix_tree.train(texts, vocabulary), learned=~F.col("held_out"))


def op10_sentencepiece(spark, sf):
    import public_tokenizers
    pieces = sentencepiece.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece.round_trip(read_table(spark, sf, "documents", "doc_id", "text"), pieces)


def op11_importance_resampling(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    return importance.resample(docs, read_table(spark, sf, "benchmark", "text"), n_min=1, n_max=1, buckets=10_000, percent=10,
                               least_words=20, seed="2024")


def _crc32_sql(text):
    """CRC-32 of a text's UTF-8 bytes; ``crc_table``, the 256 values of a byte, stands in its FROM."""
    digits = f"hex(encode({text}))"
    codes = f"list_transform(range(1, len({digits}), 2), lambda i: CAST(('0x' || substr({digits}, i, 2)) AS BIGINT))"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), "
            f"lambda a, b: xor(a >> 8, crc_table.t[(xor(a, b) & 255) + 1])))")


_CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t)"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS f FROM benchmark),
df AS (SELECT r, unnest(w) AS f FROM d),
names AS (SELECT f, {_crc32_sql('f')} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM b), crc_table),
s AS (SELECT bucket, count(*) AS n FROM df JOIN names USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN names USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
    / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
weights AS (
  SELECT r, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM df JOIN names USING (f) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, r, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE)
           / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS usable FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * usable // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""


def op12_spelling_variants(spark, sf):
    counted = variants.counted_words(read_table(spark, sf, "documents", "doc_id", "text"), drop_one_in=31)
    words = materialize(counted.where((F.col("n") >= 2) & (F.char_length("word") >= 7)), "words")
    return variants.group_variants(words, dominance=10)


OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_LOWER}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
hashed AS (SELECT run, n, {_crc32_sql("id || ':' || run")} AS h FROM (SELECT id, run, count(*) AS n FROM runs GROUP BY id, run), crc_table),
spelt AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS top_n, min_by(near, (-m, near)) AS top FROM pairs GROUP BY word),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 10 * n THEN top END AS form, CASE WHEN top_n >= 10 * n THEN top_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain(word, root) AS (
  SELECT word, word FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f
JOIN (SELECT c.word, c.root FROM chain c JOIN forms g ON c.root = g.word WHERE g.form IS NULL) c ON f.word = c.word
"""


def op13_byte_bpe(spark, sf):
    import public_tokenizers
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode(read_table(spark, sf, "documents", "doc_id", "text"), ranks, public_tokenizers.PATTERN), ranks)


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_token_files, op3_language_id, op4_warc_index, op5_license_scan,
                                     op6_url_filter, op7_simhash_dedup, op8_decontamination, op9_suffix_tree_scores, op10_sentencepiece,
                                     op11_importance_resampling, op12_spelling_variants, op13_byte_bpe)}
ORACLES = {"op1_exact_topk": OP1_SQL, "op4_warc_index": OP4_SQL, "op5_license_scan": _license_sql(),
           "op8_decontamination": _decontamination_sql(), "op11_importance_resampling": OP11_SQL, "op12_spelling_variants": OP12_SQL}
