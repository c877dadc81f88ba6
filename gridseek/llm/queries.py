"""One query for each operator of the package, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseek.llm import sql
from gridseek.llm.ann import search
from gridseek.llm.common import read
from gridseek.llm.importance import resample
from gridseek.llm.linededup import line_report
from gridseek.llm.mixing import mix_plan
from gridseek.llm.neardup import near_duplicates
from gridseek.llm.packing import pack_documents
from gridseek.llm.preference import preference_rows, swapped_answers
from gridseek.llm.quantise import codebooks_sha256, vector_codes
from gridseek.llm.quality import Limits, quality_report
from gridseek.llm.scoring import language_scores
from gridseek.llm.sharding import SHARDS, lookup_table, place
from gridseek.llm.substring import remove_repeats
from gridseek.llm.tokencount import token_counts

#: The public tokenizer's file; a parameter of the operators.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preference_rows(swapped_answers(read(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["from"].cast("string"), x["to"].cast("string"))), ",")
    return rows.select(
        "conv_id",
        "partner",
        "n_prompt_turns",
        F.sha2("prompt", 256).alias("prompt_sha256"),
        F.sha2("chosen_text", 256).alias("chosen_sha256"),
        spans("chosen_spans").alias("chosen_spans"),
        F.sha2("rejected_text", 256).alias("rejected_sha256"),
        spans("rejected_spans").alias("rejected_spans"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_report(read(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path())


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 20 = 0"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(read(spark, sf_dir, "documents"), shard_table())


def shard_table() -> list[int]:
    return lookup_table([f"shard-{i:03d}" for i in range(SHARDS)])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(read(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(read(spark, sf_dir, "embeddings"))
    return coded.withColumn("codebooks_sha256", F.lit(codebooks_sha256(books)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_near_dedup, op2_preference, op3_packing, op4_substring_dedup, op5_nearest, op6_quality, op7_sharding, op8_mixing, op9_token_counts, op10_line_dedup, op11_language_scores, op12_resampling, op13_vector_codes)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_preference": sql.PREFERENCE, "op4_substring_dedup": sql.SUBSTRING, "op6_quality": sql.quality(Limits()), "op7_sharding": sql.sharding(shard_table()), "op8_mixing": sql.MIX, "op12_resampling": sql.RESAMPLE, "op13_vector_codes": sql.vector_codes(8, 16, 6, 4096)}
