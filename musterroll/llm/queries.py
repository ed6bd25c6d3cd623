"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from musterroll.llm import (
    bpe,
    katz,
    langid,
    lexical,
    linededup,
    packing,
    pii,
    quality,
    resampling,
    simhash,
    superkmers,
    topk,
    vecdedup,
)
from musterroll.llm.common import small_batches, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    """Register under the function's name."""
    QUERIES[function.__name__] = function
    return function


def fold(doc_id: str, folds: int) -> Column:
    """The remainder that decides which documents are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def word_bpe() -> str:
    """The vocabulary file, which is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe())


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, word_bpe()).drop("text"), word_bpe())
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit_on(docs, labels, keep=fold("doc_id", 5) != 0)
    scored = quality.score(docs, model)
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLES["op4_topk"] = """
WITH usable AS (
    SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
    FROM usable q JOIN usable d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20"""


def _count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, pii.fit(docs), "text", "base", "spans")
    counts = [_count_of(k).alias(f"n_{k}") for k in pii.BASE]
    digest = F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.listed(F.col("spans")).alias("spans"))


@query
def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit_on(docs, keep=F.coalesce(fold("doc_id", 4) != 2, F.lit(True)))
    found = langid.predict(docs.drop("lang"), model, "text", "lang_pred", "score")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return katz.score(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_repeated_lines(docs, n_lines="n_lines", n_removed="n_removed")


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = superkmers.drop_repeated_windows(docs, n_words="n_words", n_removed="n_removed")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


ORACLES["op11_substring_dedup"] = r"""
WITH listed AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
    SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS window_hash
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM listed)
), firsts AS (
    SELECT window_hash, min(doc_id) AS first_doc FROM starts GROUP BY window_hash
), later AS (
    SELECT doc_id, i FROM starts JOIN firsts USING (window_hash) WHERE first_doc < doc_id
), placed AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM listed
), marked AS (
    SELECT p.doc_id, p.j, p.word,
           max(l.i) OVER (PARTITION BY p.doc_id ORDER BY p.j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
    FROM placed p LEFT JOIN later l ON p.doc_id = l.doc_id AND p.j = l.i
), joined AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed,
           coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '') AS kept
    FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM listed d LEFT JOIN joined USING (doc_id)"""


@query
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ranked = resampling.importance_ranks(docs, target)
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


#: Reflected polynomial of CRC-32.
ORACLES["op12_importance"] = r"""
WITH bytes AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
    FROM (SELECT unnest(range(256)) AS i)
), words AS (
    SELECT from_docs, id, unnest(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
    FROM (SELECT true AS from_docs, doc_id AS id, text FROM documents
          UNION ALL SELECT false, item_id, text FROM benchmark)
), per_word AS (
    SELECT from_docs, id, word, count(*) AS n FROM words GROUP BY ALL
), numbered AS (
    SELECT word, xor(list_reduce([4294967295] || list_transform(range(1, length(h), 2),
               lambda i: CAST((strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1 AS BIGINT)),
               lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT word, hex(word) AS h FROM (SELECT DISTINCT word FROM per_word)), bytes
), counted AS (
    SELECT bucket, sum(n) FILTER (from_docs) AS s, sum(n) FILTER (NOT from_docs) AS t
    FROM per_word JOIN numbered USING (word) GROUP BY bucket
), totals AS (
    SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counted
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln(
        CAST((coalesce(t, 0) + 1) * (all_s + 10000) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * (all_t + 10000) AS DOUBLE))) AS BIGINT) AS gain
    FROM counted, totals
), weighed AS (
    SELECT id AS doc_id, sum(n) AS n_features, sum(n * gain) AS weight
    FROM per_word JOIN numbered USING (word) JOIN gains USING (bucket) WHERE from_docs GROUP BY id
), scored AS (
    SELECT d.doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
           CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln(
               (CAST(('0x' || sha256('2024:' || d.doc_id)[1:8]) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM documents d LEFT JOIN weighed USING (doc_id)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
           10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS draws
    FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= draws THEN place END AS rank FROM placed"""


@query
def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_lexical"] = r"""
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), postings AS (
    SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL
), lengths AS (
    SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY doc_id
), totals AS (
    SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM lengths
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM postings, totals GROUP BY term, n_docs
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), scored AS (
    SELECT item_id, doc_id,
           CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // all_terms)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), totals
    GROUP BY item_id, doc_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""
