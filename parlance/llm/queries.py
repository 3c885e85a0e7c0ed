"""The opN_<name> queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import fst_tokens, katz, media, mixing, quality, secrets, sharding, simhash, tiling, urls
from parlance.llm.common import spread, table


#: Tokenizer file of op1, by its name in the public_tokenizers package of every machine.
TOKENIZER = "byte_bpe_50k.json"


def op1_fst_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return fst_tokens.count_tokens(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(TOKENIZER))


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(spread(table(spark, sf_dir, "documents")))


def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spread(table(spark, sf_dir, "documents")))


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected documents with expected grade and tail probability."""
    return quality.graded(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"), only_kept=True)


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(spread(table(spark, sf_dir, "pages")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(spread(table(spark, sf_dir, "documents")))


def op7_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(spread(table(spark, sf_dir, "documents")))


def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents with the benchmark items that they hold."""
    return tiling.contaminated(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(spread(table(spark, sf_dir, "documents")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fst_tokens": op1_fst_tokens,
    "op2_katz": op2_katz,
    "op3_histogram_sort": op3_histogram_sort,
    "op4_ordinal_quality": op4_ordinal_quality,
    "op5_url_rules": op5_url_rules,
    "op6_secret_scan": op6_secret_scan,
    "op7_png_media": op7_png_media,
    "op8_string_tiling": op8_string_tiling,
    "op9_pareto_mix": op9_pareto_mix,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op5_url_rules": urls.ORACLE,
    "op9_pareto_mix": mixing.ORACLE,
}
