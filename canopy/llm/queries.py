"""The registered queries of the corpus operators, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import bpe, chat, decontaminate, language_id, lexical_search, neighbours, near_dedup, packing, pii, sharding, spelling, token_histogram, toxicity
from canopy.llm.common import documents


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.read_back(chat.format_conversations(turns.unionByName(extra))))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = documents(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trees = language_id.fit(docs, language_id.Training(keep=~language_id.held_out(F.col("doc_id"))))
    scored = language_id.identify(docs.select("doc_id", "text"), trees)
    return scored.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir).select("doc_id", "text"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("text_hash")
    )
    placed = sharding.shard(rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = bpe.lengths(documents(spark, sf_dir).select("text"), bpe.default_vocabulary()).select("n_tokens")
    return token_histogram.suffix_sums(token_histogram.histogram(counted))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    classifier = toxicity.fit(docs, documents(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, classifier)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir).select("doc_id", "text"), bpe.default_vocabulary()).drop("text")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.groups(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(documents(spark, sf_dir).select("doc_id", "text"), packing.default_vocabulary())
    packed = packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_nearest_neighbours, op3_decontamination, op4_language_id, op5_near_duplicates, op6_sharding, op7_token_counts, op8_pii, op9_toxicity, op10_bpe, op11_lexical_search, op12_spelling_variants, op13_packing)}

_OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)
), marked AS (
  SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens,
    length(replace(replace(replace(text, '\', '\\'), '<', '<<'), '#', '##')) AS text_size,
    length(replace(replace(replace(role, '\', '\\'), '<', '<<'), '#', '##')) AS role_size
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(text_size + CASE WHEN opens THEN role_size + 4 + 5 + 8 ELSE 5 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

_OP3_SQL = r"""
WITH item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, least(10, len(w)) AS size, w[i : i + least(10, len(w)) - 1] AS run
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), doc_runs AS (
  SELECT k, i, s.size, w[i : i + s.size - 1] AS run
  FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size) s
), hits AS (
  SELECT k, i, size, item FROM doc_runs JOIN windows USING (size, run)
), words_hit AS (
  SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + size)) AS p FROM hits) GROUP BY k
), items_hit AS (
  SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM hits) GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN words_hit USING (k) LEFT JOIN items_hit USING (k)
"""

_OP11_SQL = r"""
WITH doc_terms AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), sizes AS (
  SELECT k, doc_id, len(w) AS n, w FROM doc_terms WHERE len(w) > 0
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes
), postings AS (
  SELECT k, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT k, doc_id, n, unnest(w) AS term FROM sizes) GROUP BY k, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term
), item_terms AS (
  SELECT q, item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term
  FROM (SELECT row_number() OVER () AS q, * FROM benchmark)
), scored AS (
  SELECT q, any_value(item_id) AS item_id, k, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM item_terms JOIN weights USING (term) JOIN postings USING (term), totals GROUP BY q, k
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST, k) AS INTEGER) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

ORACLE_SQL = {"op11_lexical_search": _OP11_SQL, "op1_chat_formatting": _OP1_SQL, "op3_decontamination": _OP3_SQL}
