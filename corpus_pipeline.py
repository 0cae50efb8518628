"""Corpus pipeline: the stages documents pass on their way to training.

Each stage takes (spark, docs, sf_dir), works on all documents its
predecessor kept, and returns them in the columns of ``documents`` (the last
returns packed pieces).  Frames between stages are stored as Parquet.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, table
from foliant.llm.decontaminate import contamination
from foliant.llm.jaccard import link_documents
from foliant.llm.lines import dedup_lines
from foliant.llm.packing import pack
from foliant.llm.toxicity import score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under one half stay."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), corpus=table(spark, sf_dir, "documents"))
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line stays once; documents of which no text is left go."""
    found = dedup_lines(docs)
    text = F.when(F.size("dropped") == 0, F.col("text")).otherwise(F.col("kept_text"))
    emptied = (F.size("dropped") > 0) & (F.trim(F.regexp_replace("kept_text", r"\s+", " ")) == "")
    n_chars = F.when(F.size("dropped") == 0, F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))
    return found.where(~F.coalesce(emptied, F.lit(False))).select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at Jaccard 0.8 of five-word shingles, one stays.

    That is the one of the least doc_id, then of the least fingerprint of the
    text; null ids come last, and of equal rows one stays.  Rows of one doc_id
    are documents of their own.  Documents without words are linked with
    nothing, so all of them stay.
    """
    found = docs.select(*COLUMNS, F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("print")).alias("row"))
    groups = link_documents(found, num=80, den=100, shingle=5, key="row")
    stay = groups.where(F.col("row") == F.col("component_id")).select("row", "n_shingles").distinct()
    own = F.when(F.col("n_shingles") == 0, F.monotonically_increasing_id())
    return found.join(stay, "row").withColumn("own", own).dropDuplicates(["row", "own"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go when a twentieth of their words lie in benchmark windows."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"), window=13)
    return found.where(~((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The stages learn, hash and tokenize; SQL has no words for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; each stage's rows are stored first."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{i}-{name}")
    return docs
