"""The registered query of each corpus operator, with production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm.chat import chat_digests, format_chat
from tocsin.llm.common import shared_folder
from tocsin.llm.conversation_repair import damage, repair_conversations
from tocsin.llm.embedding_dedup import near_vectors
from tocsin.llm.language_id import identify, prototypes
from tocsin.llm.license_scan import license_matches, license_sql
from tocsin.llm.near_dup import near_duplicates
from tocsin.llm.packing import pack, pieces
from tocsin.llm.piece_bpe import encode_pieces
from tocsin.llm.quality import quality_verdicts
from tocsin.llm.spelling import spelling_variants, word_counts
from tocsin.llm.sql import CONTROL_TURNS, chat_sql, near_dup_sql, near_vectors_sql, spelling_sql, substring_dedup_sql
from tocsin.llm.substring_dedup import remove_repeats
from tocsin.llm.token_output import read_tokens, write_tokens
from tocsin.llm.toxicity import fold, learn, toxicity_scores

SEQUENCE = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_table(spark, sf_dir, "documents"), length=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"))


def op3_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    write_tokens(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, folder, digest=True)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0, size=SEQUENCE)
    return pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), SEQUENCE)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(fold("doc_id", 5) != 0))
    scored = toxicity_scores(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = identify(docs, prototypes(docs.where(fold("doc_id", 3) != 1)))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80, fold=True)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), least=0.98)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.union(spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string"))
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
    return chat_digests(format_chat(turns, *vocabulary), *vocabulary)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(_table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return repair_conversations(conversations, damage(conversations))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_rans_tokens": op3_rans_tokens,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity": op5_toxicity,
    "op6_license_scan": op6_license_scan,
    "op7_language_id": op7_language_id,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_chat_format": op11_chat_format,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": substring_dedup_sql(),
    "op6_license_scan": license_sql(),
    "op9_minhash_near_dedup": near_dup_sql(),
    "op10_embedding_near_dedup": near_vectors_sql(),
    "op11_chat_format": chat_sql(),
    "op12_spelling_variants": spelling_sql(),
}
