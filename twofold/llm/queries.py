"""The operators' queries and their DuckDB SQL, for `__spark_entry__.py`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twofold.llm import bpe, decontaminate, licenses, lm, mixing, quality, simhash, suffix, toxicity, weaklabel
from twofold.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the tokeniser-fertility verdict of all documents."""
    return quality.quality_metrics(
        table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), tokenizer("byte_bpe_multi_50k.tiktoken")
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that 100-byte strings cover which start earlier."""
    cut = suffix.deduplicate(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items verified in any of the documents."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of all documents."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op5_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak-label posterior and trained quality score of all documents."""
    return weaklabel.weak_quality(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents under the piece vocabulary."""
    return bpe.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents; 3-word shingles, links of 2 bits or fewer."""
    found = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", simhash.hex16(found["fp"]).alias("fingerprint"), "component_id")


def op8_lm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    return lm.scores(table(spark, sf_dir, "documents"))


def op9_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by their nearest labelled examples."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked probabilities and the calibrated sample of all documents."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "_cell.source", "_cell.lang", "_cell.topic", F.col("_tokens").alias("n_tokens"),
        F.round("_probability", 6).alias("probability"), F.col("_sampled").alias("sampled"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_fertility": op1_quality_fertility,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_license_positions": op4_license_positions,
    "op5_weak_label_quality": op5_weak_label_quality,
    "op6_token_counts": op6_token_counts,
    "op7_simhash_multi_index": op7_simhash_multi_index,
    "op8_lm_trie": op8_lm_trie,
    "op9_toxicity_neighbours": op9_toxicity_neighbours,
    "op10_mixing_weights": op10_mixing_weights,
}

ORACLE_SQL: dict[str, str] = {
    "op4_license_positions": licenses.license_sql(),
    "op10_mixing_weights": mixing.mix_sql(),
}
