"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, content, decontaminate, exact, orchard, packing, quality, sharding, simhash, substring, suffixes, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op3_count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeated(_documents(spark, sf_dir))


def op4_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.compression_bands(docs, quality.fit_bands(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(_documents(spark, sf_dir), benchmark).drop("items")


def word_bpe() -> str:
    """The vocabulary file that the queries pack with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), word_bpe())


def op7_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_matrices(_documents(spark, sf_dir), word_bpe())


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(_pages(spark, sf_dir)))


def op8_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(_documents(spark, sf_dir))


def op9_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(_documents(spark, sf_dir))


def op10_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.extract(_pages(spark, sf_dir))


def op11_shared_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.alignment_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_documents(spark, sf_dir))


def op13_orchard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.cluster_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_simhash": op1_simhash, "op2_best_fit": op2_best_fit, "op3_count_min": op3_count_min, "op4_compression": op4_compression, "op5_wu_manber": op5_wu_manber, "op6_warc_derivatives": op6_warc_derivatives, "op7_token_matrices": op7_token_matrices,
    "op8_kd_tree": op8_kd_tree, "op9_suffix_family": op9_suffix_family, "op10_tree_model": op10_tree_model,
    "op11_shared_cuts": op11_shared_cuts, "op12_exact": op12_exact, "op13_orchard": op13_orchard,
}
SQL: dict[str, str] = {"op3_count_min": substring.SQL, "op5_wu_manber": decontaminate.SQL, "op9_suffix_family": suffixes.SQL, "op12_exact": exact.SQL, "op13_orchard": orchard.SQL}
