"""The operators on the given tables: one query each, with production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from signalharm.llm import (
    alignment,
    decontaminate,
    exact_topk,
    importance,
    mixing,
    neighbours,
    secrets,
    simhash,
    substring_dedup,
    suffix_dedup,
    token_counts,
    token_files,
    toxicity,
)
from signalharm.llm.common import shared_path, table
from signalharm.llm.sql import CONTAMINATION, IMPORTANCE, MIXTURE, REPEATED_PASSAGES, REPEATED_STRINGS, TOP_SCORES


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    vocabulary = tokenizer_file("byte_bpe_50k.tiktoken")
    return secrets.find_secrets(table(spark, sf, "documents"), vocabulary, public_tokenizers.PATTERN)


def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeated_strings(table(spark, sf, "documents"))


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.toxicity(docs, *toxicity.fit(docs, table(spark, sf, "labels")))


def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(table(spark, sf, "documents"))


def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op8_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.remove_repeated_passages(table(spark, sf, "documents"))


def op10_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf, "documents"), path, tokenizer_file("byte_bpe_50k.json"))
    return token_files.token_digests(spark, path)


def op11_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return exact_topk.top_scores(table(spark, sf, "embeddings"))


def op12_alignment(spark: SparkSession, sf: str) -> DataFrame:
    paths = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    return alignment.align_tokenizers(table(spark, sf, "documents"), *paths)


def op13_importance(spark: SparkSession, sf: str) -> DataFrame:
    return importance.draw(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secrets,
        op2_suffix_dedup,
        op3_toxicity,
        op4_token_counts,
        op5_mixing,
        op6_decontamination,
        op7_simhash,
        op8_neighbours,
        op9_substring_dedup,
        op10_token_files,
        op11_exact_topk,
        op12_alignment,
        op13_importance,
    )
}

ORACLES: dict[str, str] = {
    "op2_suffix_dedup": REPEATED_STRINGS,
    "op5_mixing": MIXTURE,
    "op6_decontamination": CONTAMINATION,
    "op9_substring_dedup": REPEATED_PASSAGES,
    "op11_exact_topk": TOP_SCORES,
    "op13_importance": IMPORTANCE,
}
