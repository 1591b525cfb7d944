"""A corpus pipeline from documents to packed sequences.

Each stage takes all that the stage before it kept, and is written as Parquet and read
again before the next one starts. All stages take texts of any length as a whole, accept
an empty table (and return one), and read only the columns of documents, so that further
columns, whatever their names, fall away at the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import line_dedup, minhash, mixing, packing, quality
from gridloom.llm.common import parts_removed, work_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer keeps.

    Null texts and texts without words go. A document on the threshold stays. Repeated rows
    are rated alike, one by one; a null id, language or source decides nothing.
    """
    return quality.rate(docs, quality.train(docs)).where("kept").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many share, ``n_chars`` counted again; documents that lose all their lines go.

    A null or empty text is one empty line and stays. Rows of one id (or with null ids) count
    as one document, of which each row loses its own lines; the largest id that has a line
    keeps it.
    """
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    out = out.where((F.col("n_dropped") < F.col("n_lines")) | (F.col("n_dropped") == 0))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    The smallest id of a group stays, once if its row is repeated; different texts of one id
    are decided by their own groups. Texts without words and rows with a null id all stay.
    """
    return minhash.near_dedup(docs.select(*COLUMNS), k=5, num=80, den=100)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source of its own, weighted last. Documents without words come with
    whole passes over their source alone. Among documents of one length a seeded hash
    decides; repeated rows share their copies.
    """
    return mixing.mixed(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens.

    A null or empty text has its end id alone; a null id stays null; repeated rows are
    documents of their own.
    """
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The scorer, MinHash, the knapsack and the packer are no SQL. Tests hold the other stages against brute-force versions, and the scorer against texts of known quality.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{work_dir(spark)}/{name}"
        with parts_removed(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
