"""The queries of the training-data operators, each next to its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import language, quality, simhash, toxicity, vector_dedup, word_bpe
from tabulon.llm.byte_bpe import decoder, encode_documents
from tabulon.llm.conversation_repair import damaged, read_turns, repair_conversations
from tabulon.llm.exact_dedup import deduplicate_in_batches
from tabulon.llm.metric_trees import vector_codes
from tabulon.llm.oracles import repair_sql, vector_codes_sql
from tabulon.llm.packing import pack_documents
from tabulon.llm.preference import assembled, neighbour_pairs, preference_turns, spans_as_text
from tabulon.llm.shared import held_out, written
from tabulon.llm.token_files import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``function(spark, sf_dir)`` under a name, with the SQL of its result if there is one."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op1_best_fit_packing")
def op1(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


TOXIC_FROM, GOOD_FROM = 0.3, 0.7


@query("op2_toxicity")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.scored(docs, table(spark, sf_dir, "labels"), out="score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


@query("op3_quality_classifier")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = quality.scored(docs, table(spark, sf_dir, "labels"), out="score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


@query("op4_byte_bpe")
def op4(spark, sf_dir):
    # Stored between the two, as a corpus is: encoder and decoder then never hold memory at the same time.
    docs = written(encode_documents(table(spark, sf_dir, "documents"), RANKS, offsets=True).select("doc_id", "encoded"))
    docs = docs.withColumn("decoded", decoder(spark, RANKS)(F.col("encoded.ids")))
    return docs.select(
        "doc_id", (F.length("encoded.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("encoded.ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_simhash_dedup")
def op5(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_token_files")
def op6(spark, sf_dir):
    files = round_trip(table(spark, sf_dir, "documents"), TOKENIZER)
    return files.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op7_preference_format", r"""
WITH sides AS (
    SELECT conv_id - (conv_id & 1) AS pair_id, CASE WHEN conv_id & 1 = 0 THEN 'chosen' ELSE 'rejected' END AS side, turn, role, text,
           row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS sub
    FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
places AS (
    SELECT pair_id, turn, sub, c.side IS NOT NULL AS in_c, c.role AS c_role, c.text AS c_text, r.side IS NOT NULL AS in_r, r.role AS r_role,
           r.text AS r_text, NOT (c.side IS NOT NULL AND r.side IS NOT NULL AND c.role IS NOT DISTINCT FROM r.role
                                  AND c.text IS NOT DISTINCT FROM r.text) AS differs
    FROM (SELECT * FROM sides WHERE side = 'chosen') c FULL JOIN (SELECT * FROM sides WHERE side = 'rejected') r USING (pair_id, turn, sub)),
parted AS (
    SELECT *, bool_or(differs) OVER (PARTITION BY pair_id ORDER BY turn, sub ROWS UNBOUNDED PRECEDING) AS after FROM places),
parts AS (
    SELECT pair_id, 'prompt' AS part, turn, sub, c_role AS role, c_text AS text FROM parted WHERE NOT after
    UNION ALL SELECT pair_id, 'chosen', turn, sub, c_role, c_text FROM parted WHERE after AND in_c
    UNION ALL SELECT pair_id, 'rejected', turn, sub, r_role, r_text FROM parted WHERE after AND in_r),
said AS (
    SELECT *, floor(turn / 4096)::BIGINT AS block,
           '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered FROM parts),
ended AS (
    SELECT *, sum(length(rendered)) OVER (PARTITION BY pair_id, block, part ORDER BY turn, sub ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM said),
spans AS (SELECT *, (stop - length(rendered)) || '-' || stop AS span FROM ended)
SELECT pair_id, block, coalesce(string_agg(rendered, '' ORDER BY turn, sub) FILTER (part = 'prompt'), '') AS prompt,
       coalesce(string_agg(rendered, '' ORDER BY turn, sub) FILTER (part = 'chosen'), '') AS chosen,
       coalesce(string_agg(rendered, '' ORDER BY turn, sub) FILTER (part = 'rejected'), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY turn, sub) FILTER (part = 'chosen' AND role = 'assistant'), '') AS chosen_learnt,
       coalesce(string_agg(span, ',' ORDER BY turn, sub) FILTER (part = 'rejected' AND role = 'assistant'), '') AS rejected_learnt
FROM spans GROUP BY pair_id, block""")
def op7(spark, sf_dir):
    pairs = assembled(preference_turns(neighbour_pairs(table(spark, sf_dir, "conversations"))))
    return pairs.withColumns({c: spans_as_text(F.col(c)) for c in ("chosen_learnt", "rejected_learnt")})


@query("op8_embedding_dedup")
def op8(spark, sf_dir):
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op9_language_id")
def op9(spark, sf_dir):
    found = language.identified(table(spark, sf_dir, "documents"), out="found")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score")


@query("op10_exact_dedup", r"""
WITH rows AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM rows WINDOW g AS (PARTITION BY text_sha256)""")
def op10(spark, sf_dir):
    return deduplicate_in_batches(table(spark, sf_dir, "documents"))


@query("op11_conversation_repair", repair_sql())
def op11(spark, sf_dir):
    return repair_conversations(damaged(read_turns(table(spark, sf_dir, "conversations"))))


WORDS = public_tokenizers.path("word_bpe_49k.json")


@query("op12_word_bpe")
def op12(spark, sf_dir):
    # Stored between the two, as a corpus is: encoder and decoder then never hold memory at the same time.
    docs = written(word_bpe.encode_documents(table(spark, sf_dir, "documents"), WORDS).select("doc_id", "ids"))
    docs = docs.select("doc_id", "ids", word_bpe.decoder(spark, WORDS)(F.col("ids")).alias("decoded"))
    return docs.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_vector_codes", vector_codes_sql())
def op13(spark, sf_dir):
    return vector_codes(table(spark, sf_dir, "embeddings"))
