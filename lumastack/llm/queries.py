"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collision_counting, debruijn, language_id, mixing, packing, prefix_trie, ranked_search, sharding, simhash, suffix_groups, telephony, url_filter, vector_files
from .common import read
from .sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "public_tokenizer"]


def public_tokenizer(name: str = packing.TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(read(spark, sf_dir, "pages"))


def op2_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(read(spark, sf_dir, "documents"))


def op3_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(read(spark, sf_dir, "documents"))


def op4_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.telephony_columns(read(spark, sf_dir, "documents"))


def op5_debruijn_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeated_windows(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_lyndon_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_groups.remove_repeated_bytes(read(spark, sf_dir, "documents"))


def op7_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(read(spark, sf_dir, "documents"))


def op8_approximation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_files.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizer())


def op11_interval_maxima_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item; see ``ranked_search.ranked_search`` for nulls, ties and repeats."""
    return ranked_search.ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_screened_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the rebuilt conversations' trie; see ``prefix_trie.prefix_trie``."""
    return prefix_trie.rebuilt_trie(read(spark, sf_dir, "conversations"))


def op13_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found of every vector whose id is divisible by 100; see ``collision_counting.nearest``."""
    return collision_counting.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_redirect_equivalence,
        op2_bounded_ring,
        op3_compression_language,
        op4_telephony_audio,
        op5_debruijn_compaction,
        op6_lyndon_suffix_groups,
        op7_low_discrepancy_mix,
        op8_approximation_files,
        op9_simhash_bk_trees,
        op10_minimum_bin_slack,
        op11_interval_maxima_search,
        op12_screened_prefix_trie,
        op13_collision_counting,
    )
}
