"""Corpus pipeline: toxicity, quality rules, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) with all that the stage before kept, and returns the columns of documents, the
last one packed pieces. run() writes each stage's result to the shared folder and reads it back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm.common import Scratch
from tocsin.llm.near_dup import near_duplicates
from tocsin.llm.packing import pack, pieces
from tocsin.llm.quality import quality_verdicts
from tocsin.llm.substring_dedup import remove_repeats
from tocsin.llm.toxicity import learn, toxicity_scores

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SEQUENCE = 2048
#: No SQL for the stages: they need trained scores, sketches, a tokenizer and connected components.
ORACLE_SQL: str | None = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; all labels may be learnt from."""
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_scores(docs, model, carry=("lang", "source", "n_chars")).where("score < 0.5").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    kept = quality_verdicts(docs.select("doc_id", "lang", "source", "text", "n_chars"), carry=("text", "lang", "source", "n_chars"))
    return kept.where("kept").select(*COLUMNS)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id (none: last).

    Rows are told apart by a written key of their own, so rows of one id, or of none, are different documents.
    """
    scratch = Scratch(spark)
    rows = scratch.write(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))
    groups = near_duplicates(rows, id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    stay = groups.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(smallest).select("first.row")
    return rows.join(stay, "row", "left_semi").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that an earlier one holds; untouched texts keep their white space."""
    found = remove_repeats(docs, carry=("lang", "source", "n_chars"), as_is=True)
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    cut = pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, size=SEQUENCE)
    return pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), SEQUENCE)


STAGES = [("toxicity", toxicity), ("quality rules", quality), ("near duplicates", near_dups), ("repeated passages", repeats), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents of sf_dir."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
