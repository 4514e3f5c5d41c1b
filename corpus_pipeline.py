"""The corpus pipeline: documents in, a clean, deduplicated, decontaminated and weighted sample out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns what it keeps with the columns of
documents, but for the last, which adds weights. `run` applies them in turn. No stage of it can be told in SQL alone.

Defined results of every stage: a null text counts as an empty one; an empty table gives an empty result; very long texts are read
whole; columns other than those a stage works on pass through whatever their names and values, nulls included. What a stage says of
nulls, empty texts, ties and repeated rows beyond that stands with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twofold.llm import decontaminate, mixing, quality, simhash, suffix
from twofold.llm.common import quoted, table, written

#: Columns that the last stage adds.
MIXTURE = ("topic", "n_tokens", "probability", "weight")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the tokeniser-fertility bands. Null and empty texts fail the base rules and go;
    a null language takes the band of the text's script; repeated rows and ties are judged one by one, and alike."""
    return quality.keep_good(
        docs, public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of exact and near copies; rows are told apart by id and text, so that another text of a
    shared id stays and an exact repeat of a row goes. Null texts and texts without words are copies of each other; a null id comes
    last in a group, and of rows that tie in id and text any one stays."""
    return simhash.keep_first_of_groups(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes or more that start earlier, in the order of the ids (a null id first). No row
    goes: a text that is wholly cut, and a null one, is empty. Rows of one id count as one document, and equal rows are cut alike."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = suffix.deduplicate(docs, rest=rest, whole_chars=True)
    text = F.col("kept").cast("string")
    made = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")}
    return cut.select(*[made[c].alias(c) if c in made else F.col("rest").getField(c).alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is verified. Null and empty texts hold none and stay; repeated rows are judged alike."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The calibrated sample, with each document's tokens, probability and weight. Null sources and languages are a value of their
    own; rows of one id stay or go together; input columns named like one that is added (MIXTURE) give way to it."""
    docs = docs.drop(*MIXTURE, *mixing.ADDED)
    mixed = mixing.mix(docs).where("_sampled")
    return mixed.select(
        *[F.col(quoted(c)) for c in docs.columns], F.col("_cell.topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
        F.round("_probability", 6).alias("probability"), F.round(1 / F.col("_probability"), 6).alias("weight"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", mixture),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if n + 1 == len(STAGES) else written(out, f"stage{n + 1}")
    return docs
