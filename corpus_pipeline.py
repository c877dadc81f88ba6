"""A training corpus from raw documents, in five stages; each writes a table that the next one reads.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of documents, in their order, and extra columns of any name with them. Every stage
takes an empty table, nulls in any column, repeated rows and texts of any length."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseek.llm.common import discard_stored, read, remove, shared_folder
from gridseek.llm.linededup import drop_repeated_lines
from gridseek.llm.mixing import mix
from gridseek.llm.neardup import drop_near_duplicates
from gridseek.llm.packing import pack_documents
from gridseek.llm.quality import quality_filter
from gridseek.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go, those without words among them (too few). Equal rows are judged alike."""
    return quality_filter(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of near-equal lines stays; n_chars follows the text where it changed.

    A document that loses all its words goes; one that had none (null, empty) stays, with its n_chars."""
    changed = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return drop_repeated_lines(docs).withColumn("n_chars", changed)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, of equal rows one; documents without words stay.

    Copies that differ only in lines which other documents have too are shorter here, since the stage before has left
    such lines in one place: it removes most of what near copies share, and this one the copies whose lines all differ."""
    return drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it: not at all, once or twice. A null source is a source, the last."""
    return mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, with their ids: columns of the operator and ids_crc32, none of documents but doc_id. A null or empty text is its end token."""
    return pack_documents(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Buckets of signatures and merges of tokens aren't SQL; a test holds run() against a plain version, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what no later stage reads is deleted."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        discard_stored(spark)
        if before:
            remove(spark, f"{base}/{before}")
        docs, before = spark.read.parquet(f"{base}/{name}"), name
    return docs
