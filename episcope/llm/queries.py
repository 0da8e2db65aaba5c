"""Registered queries of this folder, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episcope.llm import (
    decontamination,
    embedding_links,
    exact_topk,
    language_models,
    line_templates,
    near_duplicates,
    packing,
    periodic_runs,
    pii,
    spelling,
    token_counts,
    token_files,
    toxicity,
)
from episcope.session import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query()
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as packed ids, read them back, and give each one's place and checksum."""
    import uuid

    path = f"{scratch_folder(spark)}/{spark.sparkContext.applicationId}/token-file-{uuid.uuid4().hex}"
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_token_file(table(spark, sf_dir, "documents"), path, tokenizer, end_id=2)
    return token_files.read_documents(spark, path, with_ids=False)


@query()
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 ids."""
    return packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048
    )


@query()
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts, a digest of the base spans, and all spans."""
    return pii.personal_data_digest(table(spark, sf_dir, "documents"))


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over 512 tokens."""
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512
    )


TOPK_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query(TOPK_SQL)
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates by integer inner product for every 20th vector."""
    return exact_topk.exact_topk(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64.0)


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document for toxicity with a lexicon learned outside the held-out fold."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template recurs across documents."""
    cleaned = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", "n_lines", "n_dropped")


@query()
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in which a benchmark item occurs with at most a tenth of its characters edited."""
    return decontamination.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicate documents of every document."""
    return near_duplicates.near_duplicate_classes(table(spark, sf_dir, "documents"))


@query()
def op9_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document between wanted documents and all documents."""
    return language_models.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


LINKS_SQL = """
WITH RECURSIVE numbered AS (
  SELECT row_number() OVER () AS nr, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), usable AS (
  SELECT * FROM numbered
  WHERE vec_id IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.nr AS a, b.nr AS b FROM usable a JOIN usable b ON a.nr <> b.nr AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.95
), reach(nr, other) AS (
  SELECT nr, nr FROM numbered UNION SELECT r.nr, l.b FROM reach r JOIN links l ON l.a = r.other
), component AS (
  SELECT r.nr, min(n.vec_id) AS component_id FROM reach r JOIN numbered n ON n.nr = r.other GROUP BY r.nr
), counted AS (
  SELECT a AS nr, count(*) AS n_links FROM links GROUP BY a
)
SELECT n.vec_id, coalesce(k.n_links, 0) AS n_links, c.component_id,
       n.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM numbered n JOIN component c USING (nr) LEFT JOIN counted k USING (nr)
"""


@query(LINKS_SQL)
def op11_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with cosine of at least 0.95."""
    return embedding_links.vector_links(table(spark, sf_dir, "embeddings"), threshold=0.95)


def with_repeats(docs: DataFrame) -> DataFrame:
    """Every tenth document, by hash of its id, with its words from a place on repeated with a period."""
    text = "coalesce(text, '')"
    words = docs.select("doc_id", "text", F.expr(f"regexp_extract_all({text}, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)").alias("w"))
    h, n = F.crc32(F.col("doc_id").cast("string")), F.size("w")
    g = F.floor(h / 10)
    some = F.greatest(n, F.lit(1))
    words = words.withColumn("a", (g % some).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    repeated = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[a + (i - a) % p])), ' ')")
    planted = (h % 10 == 0) & (n > 0)
    kept = docs.select("doc_id", "text").filter(~F.coalesce(h % 10 == 0, F.lit(False)))
    return kept.unionByName(words.filter(F.coalesce(h % 10 == 0, F.lit(False))).select(
        "doc_id", F.when(planted, repeated).otherwise(F.col("text")).alias("text")
    ))


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least four periods and six words in every document, and digests of them and of the rest."""
    found = periodic_runs.periodic_runs(with_repeats(table(spark, sf_dir, "documents")), exponent=4, least=6)
    best = F.expr("array_min(transform(runs, r -> struct(-r.length AS back, r.start AS start, r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = found.withColumn("best", best)
    length = -F.col("best.back")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


VARIANTS_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS u FROM documents)
  WHERE length(u) >= 6 GROUP BY ALL
), bytes AS (
  SELECT run, n, hex(encode(concat(doc_id, ':', run))) AS x FROM runs
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(range(length(x) // 2),
      lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)]))) AS h
  FROM bytes, crc
), altered AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
  FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM altered WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM pairs GROUP BY word
), first AS (
  SELECT p.word, min(p.other) AS other FROM pairs p JOIN best b ON p.word = b.word AND p.other_n = b.best_n GROUP BY p.word
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.best_n >= 5 * w.n THEN f.other END AS form, CASE WHEN b.best_n >= 5 * w.n THEN b.best_n END AS form_n
  FROM words w LEFT JOIN best b USING (word) LEFT JOIN first f USING (word)
), walk(word, root) AS (
  SELECT word, word FROM formed UNION ALL SELECT k.word, f.form FROM walk k JOIN formed f ON f.word = k.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT k.word, k.root FROM walk k JOIN formed f ON f.word = k.root WHERE f.form IS NULL
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e USING (word)
"""


def one_letter_lost(doc_id: Column, word: Column) -> Column:
    """One occurrence in 199, by hash of document and word, without one of its letters."""
    h = F.crc32(F.concat_ws(":", doc_id.cast("string"), word))
    at = (h % F.length(word)).cast("int")
    shorter = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % 199 == 0, shorter).otherwise(word)


@query(VARIANTS_SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least six letters and five occurrences, with the common word that each is a variant of."""
    counted = spelling.word_counts(table(spark, sf_dir, "documents"), one_letter_lost, shortest=6, least=5)
    return spelling.spelling_variants(counted, ratio=5)
